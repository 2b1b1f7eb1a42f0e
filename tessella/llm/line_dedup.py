"""Line dedup over a sharded minimal perfect hash: documents look their lines up
in arrays of fingerprints and document counts."""

from __future__ import annotations

import hashlib
import io
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, map_batches, unused

WHITE = b" \t\n\x0b\x0c\r"
#: Distinct lines that one shard of the index holds, about.
SHARD_LINES = 250_000
#: Bytes of index that are broadcast at once; a larger index is probed in blocks.
BLOCK_BYTES = 48 << 20
#: Lines of fewer documents get no place in the arrays. A line of one document
#: can't repeat, and most distinct lines are such; all counts from two on are
#: looked up, whatever the least count of a drop is.
INDEX_FROM = 2
_GAMMA = 2.0


def line_key(line: bytes) -> bytes:
    """White space off both ends, A-Z lower-cased; other bytes stay."""
    return line.strip(WHITE).lower()


def _hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit halves of a 128-bit hash of each key."""
    digest = xxhash.xxh3_128_digest
    flat = np.frombuffer(b"".join(map(digest, keys)), dtype="<u8").reshape(-1, 2)
    return np.ascontiguousarray(flat[:, 0]), np.ascontiguousarray(flat[:, 1])


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A finaliser in the splitmix64 form."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: a cascade of bit levels.

    A key that is alone in its place of a level sets the bit there; the others
    go down a level. A key's number is the rank of its bit over all levels.
    """

    def __init__(self, words: list[np.ndarray], ranks: list[np.ndarray], sizes: list[int], n: int):
        self.words, self.ranks, self.sizes, self.n = words, ranks, sizes, n

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        words, ranks, sizes, left, total = [], [], [], keys.astype(np.uint64), 0
        while len(left):
            size = max(64, int(len(left) * _GAMMA))
            place = (_mix(left, len(sizes) + 1) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            bits = np.zeros((size + 63) // 64, dtype=np.uint64)
            ones = np.flatnonzero(alone)
            np.bitwise_or.at(bits, ones >> 6, np.uint64(1) << (ones & 63).astype(np.uint64))
            counts = np.bitwise_count(bits).astype(np.int64)
            ranks.append((total + np.cumsum(counts) - counts).astype(np.uint32))
            total += int(counts.sum())
            words.append(bits)
            sizes.append(size)
            left = left[~alone[place]]
        return cls(words, ranks, sizes, total)

    def number(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, below n; -1 for a key that no level holds.
        A key outside the set may get any number."""
        out = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        for level, (bits, rank, size) in enumerate(zip(self.words, self.ranks, self.sizes)):
            if not len(left):
                break
            place = (_mix(keys[left], level + 1) % np.uint64(size)).astype(np.int64)
            word, bit = bits[place >> 6], (place & 63).astype(np.uint64)
            hit = ((word >> bit) & np.uint64(1)).astype(bool)
            below = word & ((np.uint64(1) << bit) - np.uint64(1))
            number = rank[place >> 6].astype(np.int64) + np.bitwise_count(below).astype(np.int64)
            out[left[hit]] = number[hit]
            left = left[~hit]
        return out


class LineShard:
    """One shard of the index: perfect hash, fingerprints and document counts.

    ``key`` places a line, ``mark`` (the other half of its hash) is the
    fingerprint. Lines that share the key half are kept in a small list.
    """

    def __init__(self, hash_: PerfectHash, marks: np.ndarray, counts: np.ndarray, rest: np.ndarray):
        self.hash, self.marks, self.counts, self.rest = hash_, marks, counts, rest

    @classmethod
    def build(cls, keys: np.ndarray, marks: np.ndarray, counts: np.ndarray) -> LineShard:
        keys, marks = keys.astype(np.uint64), marks.astype(np.uint64)
        counts = np.minimum(counts, 2**32 - 1).astype(np.uint32)
        unique, first = np.unique(keys, return_index=True)
        hash_ = PerfectHash.build(unique)
        number = hash_.number(unique)
        put_marks, put_counts = np.zeros(hash_.n, dtype=np.uint64), np.zeros(hash_.n, dtype=np.uint32)
        put_marks[number], put_counts[number] = marks[first], counts[first]
        others = np.setdiff1d(np.arange(len(keys)), first)
        rest = np.stack([keys[others], marks[others], counts[others].astype(np.uint64)])
        return cls(hash_, put_marks, put_counts, rest)

    def count(self, keys: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """Documents that hold each line, 0 for lines that are not indexed."""
        out = np.zeros(len(keys), dtype=np.int64)
        if self.hash.n:
            number = self.hash.number(keys)
            known = number >= 0
            same = np.zeros(len(keys), dtype=bool)
            same[known] = self.marks[number[known]] == marks[known]
            out[same] = self.counts[number[same]]
        for key, mark, count in self.rest.T:
            out[(keys == key) & (marks == mark)] = int(count)
        return out

    def dump(self) -> bytes:
        put = io.BytesIO()
        arrays = {f"w{i}": x for i, x in enumerate(self.hash.words)} | {f"r{i}": x for i, x in enumerate(self.hash.ranks)}
        np.savez(put, sizes=np.array(self.hash.sizes, dtype=np.int64), n=self.hash.n, marks=self.marks, counts=self.counts, rest=self.rest, **arrays)
        return put.getvalue()

    @classmethod
    def load(cls, blob: bytes) -> LineShard:
        z = np.load(io.BytesIO(blob))
        sizes = [int(x) for x in z["sizes"]]
        levels = range(len(sizes))
        return cls(PerfectHash([z[f"w{i}"] for i in levels], [z[f"r{i}"] for i in levels], sizes, int(z["n"])), z["marks"], z["counts"], z["rest"])


def count_lines(docs: DataFrame, text: str = "text", min_chars: int = 1, distinct_texts: bool = False) -> DataFrame:
    """h1, h2, n: documents that hold each distinct line key of ``min_chars``
    code points or more. Counts are added up per batch and per task before the
    shuffle, so a line that a third of the documents hold is no hot key. With
    ``distinct_texts`` equal texts count as one document."""
    at = docs.columns.index(text)

    def keyed(lines: Iterable[bytes]) -> list[bytes]:
        return [k for k in lines if k and (min_chars <= 1 or len(k.decode()) >= min_chars)]

    def count(batches):
        for batch in batches:
            held: Counter[bytes] = Counter()
            for value in batch.column(at).to_pylist():
                held.update(set(map(line_key, (value or "").encode().split(b"\n"))))
            keys = keyed(held)
            if keys:
                h1, h2 = _hashes(keys)
                n = np.fromiter(map(held.__getitem__, keys), dtype=np.int64, count=len(keys))
                yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(n)], names=["h1", "h2", "n"])

    def pair(batches):
        for batch in batches:
            keys, texts, sizes = [], [], []
            for raw in {v.encode() for v in batch.column(at).to_pylist() if v}:
                own = keyed(set(map(line_key, raw.split(b"\n"))))
                keys += own
                texts.append(xxhash.xxh3_64_intdigest(raw))
                sizes.append(len(own))
            if keys:
                h1, h2 = _hashes(keys)
                t = np.repeat(np.array(texts, dtype=np.uint64), sizes)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (h1, h2, t)], names=["h1", "h2", "t"])

    if distinct_texts:
        return map_batches(docs, pair, "h1 long, h2 long, t long").distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    return map_batches(docs, count, "h1 long, h2 long, n long").groupBy("h1", "h2").agg(F.sum("n").alias("n"))


def build_index(docs: DataFrame, text: str = "text", min_chars: int = 1, distinct_texts: bool = False, from_docs: int = INDEX_FROM) -> DataFrame:
    """shard, shards, lines, bytes, blob: the index over the distinct lines of
    ``from_docs`` documents or more with their document counts, one row per
    shard. It serves any least count from there on; a line without a place in it is turned away by the
    64-bit fingerprint."""
    lines = checkpoint(count_lines(docs, text, min_chars, distinct_texts).where(F.col("n") >= from_docs))
    shards = max(1, -(-lines.count() // SHARD_LINES))

    def build(batches):
        parts: dict[int, list] = {}
        for batch in batches:
            h1, h2 = (batch.column(i).to_numpy().view(np.uint64) for i in (0, 1))
            shard = (h1 >> np.uint64(32)) % np.uint64(shards)
            for s in np.unique(shard):
                own = shard == s
                parts.setdefault(int(s), []).append((h1[own], h2[own], batch.column(2).to_numpy()[own]))
        for s, kept in parts.items():
            shard_ = LineShard.build(*(np.concatenate(x) for x in zip(*kept)))
            blob = shard_.dump()
            yield pa.RecordBatch.from_pylist([{"shard": s, "shards": shards, "lines": sum(len(k[0]) for k in kept), "bytes": len(blob), "blob": blob}])

    shard = F.pmod(F.shiftrightunsigned("h1", 32), F.lit(shards))
    dealt = lines.repartition(shards, shard)
    return checkpoint(dealt.mapInArrow(build, "shard long, shards long, lines long, bytes long, blob binary"))


class _Block:
    """Some shards of the index, and the places of the lines that they drop."""

    def __init__(self, blobs: dict[int, bytes], shards: int, min_docs: int):
        self.blobs, self.shards, self.min_docs = blobs, shards, min_docs
        self.index: dict[int, LineShard] | None = None

    def __getstate__(self):
        return self.__dict__ | {"index": None}

    def drops(self, values: list[str | None]) -> list[list[int]]:
        if self.index is None:
            self.index = {s: LineShard.load(b) for s, b in self.blobs.items()}
        keys, ends = [], []
        for value in values:
            keys += map(line_key, (value or "").encode().split(b"\n"))
            ends.append(len(keys))
        if not keys:
            return []
        h1, h2 = _hashes(keys)
        shard = (h1 >> np.uint64(32)) % np.uint64(self.shards)
        hit = np.zeros(len(keys), dtype=bool)
        for s, part in self.index.items():
            own = np.flatnonzero(shard == s)
            if len(own):
                hit[own] = part.count(h1[own], h2[own]) >= self.min_docs
        starts = [0, *ends[:-1]]
        places = np.flatnonzero(hit)
        low, high = np.searchsorted(places, starts), np.searchsorted(places, ends)
        return [(places[a:b] - s).tolist() for a, b, s in zip(low, high, starts)]


def with_drops(docs: DataFrame, index: DataFrame, fn, schema: T.StructType, min_docs: int = 10, text: str = "text") -> DataFrame:
    """``fn(batch, drops)`` over the batches of ``docs``: ``drops`` has the
    places of each text's lines to drop, from 0: those whose count in the
    ``index`` is ``min_docs`` or more.

    The index is broadcast while it fits into BLOCK_BYTES. A larger one is
    taken in blocks of that size, one pass over the documents each, with the
    places found so far kept in a table in between; no block is skipped.
    """
    sizes = index.select("shard", "shards", "bytes").orderBy("shard").collect()
    blocks: list[list[int]] = [[]]
    held = 0
    for row in sizes:
        if blocks[-1] and held + row["bytes"] > BLOCK_BYTES:
            blocks.append([])
            held = 0
        blocks[-1].append(row["shard"])
        held += row["bytes"]
    shards = sizes[0]["shards"] if sizes else 1
    context = docs.sparkSession.sparkContext
    rows, (place,) = docs, unused(docs, "drop")
    at, names = rows.columns.index(text), rows.columns
    for k, block in enumerate(blocks):
        blobs = {r["shard"]: bytes(r["blob"]) for r in index.where(F.col("shard").isin(block)).select("shard", "blob").collect()} if block else {}
        shared = context.broadcast(_Block(blobs, shards, min_docs))

        def drops_of(batch: pa.RecordBatch, shared=shared) -> list[list[int]]:
            own = shared.value.drops(batch.column(at).to_pylist())
            if len(batch.schema.names) == len(names):
                return own
            return [a + b for a, b in zip(batch.column(len(names)).to_pylist(), own)]

        if k + 1 == len(blocks):

            def last(batches, drops_of=drops_of):
                for batch in batches:
                    drops = drops_of(batch)
                    yield fn(pa.RecordBatch.from_arrays(batch.columns[: len(names)], names=names), drops)

            return map_batches(rows, last, schema)

        def mark(batches, drops_of=drops_of):
            for batch in batches:
                drops = pa.array(drops_of(batch), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], drops], names=[*names, place])

        marked = T.StructType([*docs.schema.fields, T.StructField(place, T.ArrayType(T.IntegerType()))])
        rows = checkpoint(map_batches(rows, mark, marked))
    raise AssertionError("there is always a block")


def _kept(value: str, drop: list[int]) -> str:
    if not drop:
        return value
    gone = set(drop)
    return "\n".join(x for i, x in enumerate(value.split("\n")) if i not in gone)


def drop_repeated_lines(docs: DataFrame, min_docs: int = 10, text: str = "text", min_chars: int = 1, distinct_texts: bool = False) -> DataFrame:
    """``docs`` with the lines that ``min_docs`` documents or more hold removed
    from every document, the other lines joined by a newline. Same rows and
    columns, whatever they are called; ``n_chars``, where there is one, follows
    the text. A null text stays null and an empty one empty: its only line has
    an empty key, which is never dropped. A document may end with an empty text.
    Rows count as documents, so repeated rows count each; with
    ``distinct_texts`` rows of equal texts count as one, so that copies of a
    document, however many, don't lose it by themselves."""
    at = docs.columns.index(text)
    n_at = next((i for i, f in enumerate(docs.schema.fields) if f.name == "n_chars" and f.dataType == T.LongType()), None)

    def fn(batch: pa.RecordBatch, drops: list[list[int]]) -> pa.RecordBatch:
        texts = [v if v is None else _kept(v, d) for v, d in zip(batch.column(at).to_pylist(), drops)]
        arrays = list(batch.columns)
        arrays[at] = pa.array(texts, type=batch.column(at).type)
        if n_at is not None:
            olds = batch.column(n_at).to_pylist()
            arrays[n_at] = pa.array([o if not d or t is None else len(t) for o, d, t in zip(olds, drops, texts)], type=pa.int64())
        return pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

    return with_drops(docs, build_index(docs, text, min_chars, distinct_texts, min(INDEX_FROM, min_docs)), fn, docs.schema, min_docs, text)


def line_digest(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 per row of ``docs``; a null text
    counts as empty: one line, none dropped. An empty table gives no rows."""

    def fn(batch: pa.RecordBatch, drops: list[list[int]]) -> pa.RecordBatch:
        values = [v or "" for v in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([v.count("\n") + 1 for v in values], type=pa.int64()),
                pa.array([len(d) for d in drops], type=pa.int64()),
                pa.array([hashlib.sha256(_kept(v, d).encode()).hexdigest() for v, d in zip(values, drops)], type=pa.string()),
            ],
            names=["doc_id", "n_lines", "n_dropped", "kept_sha256"],
        )

    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    rows = docs.select("doc_id", "text")
    return with_drops(rows, build_index(rows, from_docs=min(INDEX_FROM, min_docs)), fn, schema, min_docs)
