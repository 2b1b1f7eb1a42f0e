"""Near-duplicate classes by Order MinHash, verified by banded alignment.

Candidates share a sketch: minima among five-word shingles, each labelled with
the number of its occurrence, kept in text order. Candidates are verified by
aligning their words: the similarity of two texts is the number of words that
align in order over the number in either, so it is sensitive to edits and to
order. One minus it is a metric (the normalised distance of longest common
subsequences), which the exact handling of large buckets uses. A link is a
similarity of 0.8 or more between candidates; classes are the connected
components of the links.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint_in_loop as checkpoint
from .common import map_batches, materialise, unused

SHINGLE = 5
MIN_SIMILARITY = 0.8
#: Sketches per text, and minimum shingles in each, kept in text order. A pair of
#: texts that have a share J of their shingles in common has a sketch in common
#: with probability 1 - (1 - J^4)^32: 0.988 at 0.6, over 0.9999999 at 0.8.
SKETCHES = 32
MINIMA = 4
#: Texts of so many words or fewer have too few shingles for that; of these all
#: pairs of the least similarity are candidates.
SHORT_WORDS = 24
#: Texts and words of a candidate component, or of a bucket, that one task resolves.
TASK_TEXTS = 4096
TASK_WORDS = 3_000_000
#: Edges (two numbers each) that one task joins up.
TASK_EDGES = 500_000
#: Rows of a narrow side (a text's or document's number) that are broadcast.
BROADCAST_ROWS = 1_000_000
#: Parts that the texts of one hub are dealt over.
SALTS = 32
CHUNK_CHARS = 400_000

_SEEDS = np.array([(0xD6E8FEB86659FD93 * (2 * j + 1)) & (2**64 - 1) for j in range(64)], dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_WORD: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def _word_points() -> np.ndarray:
    """Whether each code point is a letter or digit."""
    if not _WORD:
        table = np.zeros(0x110000, dtype=bool)
        table[[c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalnum()]] = True
        _WORD.append(table)
    return _WORD[0]


_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        size = max(n, CHUNK_CHARS + 1024)
        with np.errstate(over="ignore"):
            up = np.cumprod(np.full(size, _BASE, dtype=np.uint64))
            down = np.cumprod(np.full(size, _INVERSE, dtype=np.uint64))
        _POWERS[:] = [(up, down)]
    return _POWERS[0]


def word_hashes(texts: Sequence[str | None]) -> list[np.ndarray]:
    """Hashes of each text's words: case-folded runs of letters and digits. The
    low six bits are the word's length, 63 at most. Words are found and hashed
    for all texts in one vectorised pass."""
    points = [np.frombuffer((t or "").casefold().encode("utf-32-le"), dtype=np.uint32) for t in texts]
    sizes = np.array([len(p) + 1 for p in points], dtype=np.int64)
    flat = np.zeros(int(sizes.sum()), dtype=np.uint32)
    ends = np.cumsum(sizes)
    for p, end, size in zip(points, ends, sizes):
        flat[end - size : end - 1] = p
    inside = _word_points()[flat]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    low, high = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(len(flat) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * up[: len(flat)])])
        hashes = _mix((sums[high] - sums[low]) * down[low] + (high - low).astype(np.uint64))
        hashes = hashes & ~np.uint64(63) | np.minimum(high - low, 63).astype(np.uint64)
    at = np.searchsorted(low, np.concatenate([[0], ends]))
    return [hashes[a:b] for a, b in zip(at[:-1], at[1:])]


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of the consecutive five words, in order; of a shorter text one
    hash of all its words; none without words."""
    n = min(SHINGLE, len(words))
    if not n:
        return np.zeros(0, dtype=np.uint64)
    m = len(words) - n + 1
    h = np.full(m, n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = (h ^ words[k : k + m]) * _STEP
            h ^= h >> np.uint64(29)
    return h


def labelled(grams: np.ndarray) -> np.ndarray:
    """Shingle hashes with the number of the occurrence mixed in: all distinct."""
    order = np.argsort(grams, kind="stable")
    ordered = grams[order]
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return grams
    at = np.arange(len(grams))
    first = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), at, 0))
    number = np.empty(len(grams), dtype=np.uint64)
    number[order] = (at - first).astype(np.uint64)
    with np.errstate(over="ignore"):
        return np.where(number > 0, _mix(grams + number * _STEP), grams)


def sketch(grams: np.ndarray) -> np.ndarray:
    """SKETCHES hashes: of the MINIMA labelled shingles of least rank, in text order."""
    if not len(grams):
        return np.zeros(0, dtype=np.uint64)
    labels = labelled(grams)
    keep = min(MINIMA, len(grams))
    out = np.empty(SKETCHES, dtype=np.uint64)
    block = max(1, 1_000_000 // len(grams))
    with np.errstate(over="ignore"):
        for a in range(0, SKETCHES, block):
            seeds = _SEEDS[a : min(a + block, SKETCHES), None]
            rank = (labels[None, :] ^ seeds) * _STEP
            rank ^= rank >> np.uint64(32)
            rank *= np.uint64(0xD6E8FEB86659FD93)
            least = np.argpartition(rank, keep - 1, axis=1)[:, :keep] if keep < len(grams) else np.tile(np.arange(keep), (len(seeds), 1))
            least.sort(axis=1)
            h = seeds[:, 0].copy()
            for k in range(keep):
                h = _mix(h + labels[least[:, k]] * _STEP)
            out[a : a + len(seeds)] = h
    return out


def runs(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n consecutive words; of a shorter text none."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.full(m, 0xA0761D6478BD642F + n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = _mix(h ^ words[k : k + m])
    return h


def short_keys(words: np.ndarray) -> np.ndarray:
    """Keys of a short text. An alignment of L words that leaves D words of two
    texts out falls into D + 1 stretches at most, so one of them has L / (D + 1)
    words or more. Where the similarity is 0.8 or more and one text has up to
    SHORT_WORDS words, that is three words, or two of texts of up to five, or the
    whole of a single word."""
    if len(words) < 2:
        return runs(words, 1)
    return np.unique(np.concatenate([runs(words, 3), runs(words, 2)]) if len(words) <= 5 else runs(words, 3))


def candidate_keys(words: np.ndarray, least: float = MIN_SIMILARITY) -> np.ndarray:
    """What two texts must share one of to be aligned: sketches and, of texts
    that may be within ``least`` of a short one, runs of words."""
    keys = sketch(shingles(words))
    return np.concatenate([keys, short_keys(words)]) if len(words) * least <= SHORT_WORDS else keys


def aligned(a: np.ndarray, b: np.ndarray, reach: int) -> int:
    """Longest common subsequence within ``reach`` diagonals off the main one:
    bit vectors, a row of the table for each word of ``a``."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b, n = a[head:], b[head:], n - head
    differ = np.flatnonzero(a[len(a) - n :] != b[len(b) - n :])
    tail = n - 1 - int(differ[-1]) if len(differ) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    places: dict[int, int] = {}
    for k, word in enumerate(b.tolist()):
        places[word] = places.get(word, 0) | 1 << k
    every = row = (1 << len(b)) - 1
    for i, word in enumerate(a.tolist()):
        same = places.get(word)
        if same is None:
            continue
        if reach < len(b):
            low = max(0, i - reach)
            same &= (1 << (i + reach + 1 - low)) - 1 << low
        same &= row
        row = ((row + same) | (row - same)) & every
    return head + tail + len(b) - row.bit_count()


class Sequenced:
    """A text's words in order, and labelled and sorted for common counts."""

    def __init__(self, words: np.ndarray):
        self.n, self.words = len(words), words
        self.bag = np.sort(labelled(words))


def similarity(a: Sequenced, b: Sequenced, least: float = MIN_SIMILARITY) -> float:
    """Aligned words over the words of either text; exact where it is ``least``
    or more, else an upper bound under ``least`` or the exact value.

    An alignment of L words leaves n1 + n2 - 2L out, so it stays that near to the
    main diagonal; no more of the table is looked at than ``least`` needs.
    """
    if not a.n or not b.n:
        return 0.0
    n, low = a.n + b.n, min(a.n, b.n)
    if low < least * (n - low):
        return low / (n - low)
    common = len(np.intersect1d(a.bag, b.bag, assume_unique=True))
    if common < least * (n - common):
        return common / (n - common)
    both = aligned(a.words, b.words, int(n - 2 * least / (1 + least) * n + 1e-6))
    return both / (n - both)


def text_number(text: Column, again: Sequence[int] = ()) -> Column:
    """64-bit number of a text; the few texts whose numbers meet (``again``)
    take one of another seed. Null for a null text."""
    number = F.xxhash64(text)
    if again:
        number = F.when(number.isin(list(again)), F.xxhash64(F.lit("again"), text)).otherwise(number)
    return F.when(text.isNotNull(), number)


def _meeting(docs: DataFrame, text: str) -> list[int]:
    """Numbers that two different texts share, by a second hash: about
    texts^2 / 2^65 of them, none below a billion texts."""
    t = F.col(f"`{text}`")
    pairs = docs.where(t.isNotNull()).select(F.xxhash64(t).alias("t"), F.xxhash64(F.lit(1), t).alias("u"))
    return [r["t"] for r in pairs.groupBy("t").agg(F.min("u").alias("a"), F.max("u").alias("b")).where("a <> b").collect()]


def _per_text(rows: DataFrame, fields: list[T.StructField], fn) -> DataFrame:
    """t and ``fields`` from (t, text) rows; a text that a batch repeats is taken once."""
    schema = T.StructType([T.StructField("t", T.LongType()), *fields])

    def run(batches):
        for batch in batches:
            own = dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            numbers, texts = list(own), list(own.values())
            start = 0
            while start < len(texts):
                stop, chars = start, 0
                while stop < len(texts) and (stop == start or chars < CHUNK_CHARS):
                    chars += len(texts[stop])
                    stop += 1
                made = [fn(w) for w in word_hashes(texts[start:stop])]
                arrays = [pa.array(numbers[start:stop], pa.int64())]
                arrays += [pa.array([m[i] for m in made], kind) for i, kind in enumerate(_kinds(fields))]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)
                start = stop

    return map_batches(rows, run, schema)


def _kinds(fields: list[T.StructField]) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in fields]


def _join_up(batches):
    """Least labels of all components of (a, b) rows, by union-find."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    for at in range(0, len(nodes), 50_000):
        own = nodes[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([find(x) for x in own], pa.int64())], names=["node", "label"])


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each node's component.

    Up to TASK_EDGES edges, one task on an executor joins them up. Beyond, least
    labels spread over the edges and jump along them until none changes; labels
    and edges stay distributed, and each round is cut with a checkpoint.
    """
    edges = checkpoint(edges.select("a", "b").where("a <> b").distinct())
    if edges.count() <= TASK_EDGES:
        return checkpoint(map_batches(edges.repartition(1), _join_up, "node long, label long"))
    both = checkpoint(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = checkpoint(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("least"))
        spread = labels.join(near, labels["node"] == near["a"], "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("least", "label")).alias("label"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        now = checkpoint(spread.join(jump, F.col("label") == F.col("via"), "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label")))
        labels = now.select("node", "label")
        if now.where("label <> old").isEmpty():
            return labels


def _bounded(df: DataFrame) -> DataFrame:
    """``df`` (narrow rows) marked for broadcast if it has BROADCAST_ROWS at
    most; else a shuffled join takes it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _spread(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table``, which has one row per key (narrow). A key
    may hold any share of ``rows``: a table of BROADCAST_ROWS at most is
    broadcast and ``rows`` stay where they are; a larger one takes a sort-merge
    join, of which adaptive execution splits the partitions that a key fills."""
    table = checkpoint(table)
    return rows.join(_bounded(table), key, how)


def _resolve(min_similarity: float):
    """Links of one bounded group of texts, enough to connect what any of its
    links connects. A text's common words with all others come out of one pass
    over the group's words; only pairs that share a bucket, aren't
    connected yet and could be similar enough are aligned."""

    def run(table: pa.Table) -> pa.Table:
        numbers = table.column("t").to_pylist()
        words = [np.frombuffer(w, dtype=np.uint64) for w in table.column("words").to_pylist()]
        keys = table.column("keys").to_pylist()
        sizes = np.array([len(x) for x in words])
        vocabulary, ids = np.unique(np.concatenate([labelled(w) for w in words]), return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        buckets: dict[int, list[int]] = {}
        for i, own in enumerate(keys):
            for key in own:
                buckets.setdefault(key, []).append(i)
        part = np.arange(len(numbers))
        mark = np.zeros(len(vocabulary), dtype=np.int32)
        ordered: dict[int, Sequenced] = {}
        links = []
        for i in range(1, len(numbers)):
            near = np.zeros(i, dtype=bool)
            for key in keys[i]:
                own = buckets[key]
                near[own[: bisect_left(own, i)]] = True
            near &= part[:i] != part[i]
            if not near.any():
                continue
            mine = ids[starts[i] : starts[i] + sizes[i]]
            mark[mine] = 1
            common = np.add.reduceat(mark[ids[: starts[i]]], starts[:i])
            mark[mine] = 0
            for j in np.flatnonzero(near & (common >= min_similarity * (sizes[:i] + sizes[i] - common))):
                if part[i] != part[j]:
                    for k in (i, int(j)):
                        if k not in ordered:
                            ordered[k] = Sequenced(words[k])
                    if similarity(ordered[i], ordered[int(j)], min_similarity) >= min_similarity:
                        links.append((numbers[j], numbers[i]))
                        part[part == part[i]] = part[j]
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return run


def _star(members: DataFrame, words: DataFrame, min_similarity: float) -> tuple[DataFrame, DataFrame]:
    """One round for components too large for a task. Each bucket's least text
    is its hub; every other text is aligned with its hubs (a join on one text
    each, no pairs of members). Gives the links, and the (t, key) rows that may
    still hold links: texts that are not linked to the hub, and linked ones that
    the triangle inequality allows to be near an unlinked one."""
    least = 1 - 2 * (1 - min_similarity)
    of_hub = checkpoint(_spread(members, members.groupBy("key").agg(F.min("t").alias("hub")), "key").where("t <> hub"))
    pairs = of_hub.select("t", "hub").distinct()
    mine = pairs.join(words, "t")
    other = words.select(F.col("t").alias("hub"), F.col("words").alias("hub_words"))

    def run(batches):
        for batch in batches:
            t, hub = batch.column(0), batch.column(1)
            held: dict[int, Sequenced] = {}
            out = []
            for h, own, its in zip(hub.to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if h not in held:
                    if len(held) > 64:
                        held.clear()
                    held[h] = Sequenced(np.frombuffer(its, dtype=np.uint64))
                out.append(similarity(Sequenced(np.frombuffer(own, dtype=np.uint64)), held[h], least))
            yield pa.RecordBatch.from_arrays([t, hub, pa.array(out, pa.float64())], names=["t", "hub", "s"])

    scored = checkpoint(map_batches(_hub_words(mine, other), run, "t long, hub long, s double"))
    links = scored.where(F.col("s") >= min_similarity).select(F.col("hub").alias("a"), F.col("t").alias("b"))
    known = checkpoint(of_hub.join(scored, ["t", "hub"]))
    far = known.where((F.col("s") < min_similarity) & (F.col("s") >= least)).groupBy("key").agg(F.max("s").alias("fringe"))
    open_ = _spread(known, far, "key", "left").where((F.col("s") < min_similarity) | (F.col("s") <= F.col("fringe") + (1 - min_similarity)))
    return links, _shared(open_.select("t", "key"))


def _hub_words(mine: DataFrame, other: DataFrame) -> DataFrame:
    """(t, hub, words, hub_words): each hub's words beside those of its texts,
    which are dealt over SALTS parts, for most texts may have the same hub."""
    part = F.pmod(F.xxhash64("t"), F.lit(SALTS))
    hubs = other.join(mine.select("hub").distinct(), "hub", "left_semi")
    copies = hubs.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return mine.withColumn("salt", part).join(copies, ["hub", "salt"]).select("t", "hub", "words", "hub_words")


def _split(members: DataFrame, words: DataFrame, min_similarity: float) -> DataFrame:
    """The buckets of ``members`` cut up by their texts' rarer words, the order
    being that of how many of these texts hold a word. Two texts that are similar
    enough have the least share of either's words in common, and the rarest of
    these is among as many of both texts' rarest as that share leaves; texts that
    only share a passage or a line have none there. Gives (t, key) rows as before."""

    def run(batches):
        for batch in batches:
            own = [labelled(np.frombuffer(w, dtype=np.uint64)) for w in batch.column(1).to_pylist()]
            sizes = [len(x) for x in own]
            t = np.repeat(batch.column(0).to_numpy(), sizes)
            keep = [n - int(np.ceil(min_similarity * n - 1e-9)) + 1 for n in sizes]
            yield pa.RecordBatch.from_arrays([pa.array(t, pa.int64()), pa.array(np.repeat(keep, sizes), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint64), *own]).view(np.int64))], names=["t", "keep", "label"])

    texts = words.join(members.select("t").distinct(), "t", "left_semi").select("t", "words")
    labels = checkpoint(map_batches(texts, run, "t long, keep int, label long"))
    holders = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    ranked = _spread(labels, holders, "label").groupBy("t", "keep").agg(F.sort_array(F.collect_list(F.struct("n", "label"))).alias("order"))
    first = ranked.select("t", F.explode(F.slice("order", F.lit(1), F.col("keep"))).alias("x")).select("t", F.col("x.label").alias("label"))
    return _shared(members.join(first, "t").select("t", F.xxhash64("key", "label").alias("key")))


def _shared(rows: DataFrame) -> DataFrame:
    """The distinct (t, key) rows of keys that two texts or more hold."""
    ends = rows.groupBy("key").agg(F.min("t").alias("low"), F.max("t").alias("high")).where("low <> high").select("key")
    return checkpoint(rows.join(ends, "key").select("t", "key").distinct())


def text_links(docs: DataFrame, again: Sequence[int], text: str = "text", min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """(a, b): links between different texts, enough to connect all that are
    connected by links between texts that share a candidate key."""
    spark = docs.sparkSession
    value = F.col(f"`{text}`")
    rows = docs.select(text_number(value, again).alias("t"), value.alias("text")).where("t is not null")
    made = _per_text(rows, [T.StructField("keys", T.ArrayType(T.LongType()))], lambda w: (candidate_keys(w, min_similarity).view(np.int64).tolist(),))
    sketches = materialise(made)
    members = _shared(sketches.select("t", F.explode("keys").alias("key")))
    wanted = checkpoint(members.select("t").distinct())
    own = rows.join(_bounded(wanted), "t", "left_semi").dropDuplicates(["t"])
    words = materialise(_per_text(own, [T.StructField("words", T.BinaryType())], lambda w: (w.tobytes(),)))
    sizes = checkpoint(words.select("t", (F.octet_length("words") / 8).cast("long").alias("n")))
    links = spark.createDataFrame([], "a long, b long")
    split = False
    while not members.isEmpty():
        hubs = members.groupBy("key").agg(F.min("t").alias("b"))
        label = components(_spread(members, hubs, "key").where("t <> b").select(F.col("t").alias("a"), "b").distinct())
        label = checkpoint(label.select(F.col("node").alias("t"), F.col("label").alias("component")))
        fits = (F.col("texts") <= TASK_TEXTS) & (F.col("words") <= TASK_WORDS) | (F.col("texts") == 2)
        total = label.join(sizes, "t").groupBy("component").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("words"))
        label = checkpoint(_spread(label, total.where(~fits).select("component", F.lit(True).alias("large")), "component", "left"))
        keys = members.groupBy("t").agg(F.collect_set("key").alias("keys"))
        small = label.where("large is null").select("t", "component").join(keys, "t").join(words, "t").select("component", "t", "keys", "words")
        links = checkpoint(links.union(small.groupBy("component").applyInArrow(_resolve(min_similarity), "a long, b long")))
        large = label.where("large").select("t")
        if large.isEmpty():
            break
        # Larger components: bucket by bucket where a bucket fits into a task,
        # else by hubs. What a first round of hubs leaves open are different
        # texts with something in common, so their buckets are cut up once.
        members = checkpoint(members.join(large, "t", "left_semi"))
        held = members.join(sizes, "t").groupBy("key").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("words"))
        held = checkpoint(_spread(members, held.where(~fits).select("key", F.lit(True).alias("large")), "key", "left"))
        own = held.where("large is null").select("t", "key").join(words, "t").select("key", "t", F.array("key").alias("keys"), "words")
        links = checkpoint(links.union(own.groupBy("key").applyInArrow(_resolve(min_similarity), "a long, b long")))
        more, members = _star(checkpoint(held.where("large").select("t", "key")), words, min_similarity)
        links = checkpoint(links.union(more))
        if not split and not members.isEmpty():
            members, split = _split(members, words, min_similarity), True
    return links


def classify(docs: DataFrame, id_column: str = "doc_id", text: str = "text", min_similarity: float = MIN_SIMILARITY) -> tuple[DataFrame, DataFrame, list[int]]:
    """(t, label, class_id, class_size) of the texts of every class of several
    rows, sizes counted in rows; (doc_id, t) of every row with a text; and the
    numbers to take again."""
    again = _meeting(docs, text)
    ids = docs.select(F.col(f"`{id_column}`").alias("doc_id"), text_number(F.col(f"`{text}`"), again).alias("t")).where("t is not null")
    links = checkpoint(text_links(docs, again, text, min_similarity))
    label = components(links).select(F.col("node").alias("t"), "label")
    per_text = ids.groupBy("t").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n"))
    per_text = checkpoint(per_text.join(label, "t", "left").withColumn("label", F.coalesce("label", "t")))
    per_class = per_text.groupBy("label").agg(F.min("low").alias("class_id"), F.sum("n").alias("class_size")).where("class_size > 1")
    return checkpoint(_spread(per_text.select("label", "t"), per_class, "label").select("t", "label", "class_id", "class_size")), ids, again


def near_classes(docs: DataFrame, id_column: str = "doc_id", text: str = "text", min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """doc_id, class_id, class_size for every row.

    ``class_id`` is the least doc_id of the class, ``class_size`` its rows.
    Equal texts are one class, also empty ones and texts without words; a null
    text is alone: its own doc_id, size 1. A class without any doc_id has a null class_id. Repeated rows are members each. An empty
    table gives no rows; extra columns are not read.
    """
    classes, ids, _ = classify(docs, id_column, text, min_similarity)
    several = _spread(ids, classes.select("t", F.struct("class_id", "class_size").alias("own")), "t", "left")
    alone = F.struct(F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    some = several.select("doc_id", F.when(F.col("own").isNotNull(), F.col("own")).otherwise(alone).alias("own")).select("doc_id", "own.class_id", "own.class_size")
    none = docs.where(F.col(f"`{text}`").isNull()).select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{id_column}`").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return some.union(none)


def keep_one(docs: DataFrame, id_column: str = "doc_id", text: str = "text", min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """``docs`` with one row per class, all columns as they were: the row of
    least doc_id. Rows with a null text stay. Of rows that share class and
    doc_id one stays. Texts are not shuffled while the rows to drop can be
    broadcast, and only repeated ids are looked at again."""
    classes, ids, again = classify(docs, id_column, text, min_similarity)
    inside = checkpoint(_spread(ids, classes, "t"))
    gone = checkpoint(inside.where(~F.col("doc_id").eqNullSafe(F.col("class_id"))).select("doc_id", "t").distinct())
    stay = inside.where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    twice = checkpoint(stay.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("label").join(classes, "label").select("t", "label"))
    at_t, at_label, gone_t, gone_id = unused(docs, "t", "label", "gone_t", "gone_id")
    rows = docs.withColumn(at_t, text_number(F.col(f"`{text}`"), again))
    drop = _bounded(gone.select(F.col("doc_id").alias(gone_id), F.col("t").alias(gone_t)))
    left = rows.join(drop, (F.col(at_t) == F.col(gone_t)) & F.col(f"`{id_column}`").eqNullSafe(F.col(gone_id)), "left_anti")
    plain = [F.col(f"`{c}`") for c in docs.columns]
    if twice.isEmpty():
        return left.select(*plain)
    marked = left.join(_bounded(twice.select(F.col("t").alias(gone_t), F.col("label").alias(at_label))), F.col(at_t) == F.col(gone_t), "left")
    once = marked.where(F.col(at_label).isNotNull()).dropDuplicates([at_label])
    return marked.where(F.col(at_label).isNull()).select(*plain).union(once.select(*plain))
