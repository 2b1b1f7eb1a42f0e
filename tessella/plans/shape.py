"""Content-defined chunks of an ordered table and the tree of digests above them.

The shape is metadata: queries never read it. Chunks end where a hash of their
bytes falls below the hazard of a log-normal length, so equal rows give equal
chunks whatever was stored before. Digests are Merkle digests: of rows and row
numbers in leaves, of child digests above, with the level in every digest.

The rule is sequential, for a chunk begins where the one before ended, yet the
work is not. Every task chunks its stretch of the sorted files as if a chunk
began there; what its stretch leaves open goes to the next one as its start, and
the stretches are chunked again until no start changes. Chunkings from different
starts soon have an end in common and are the same from there on, so the second
pass nearly always is the last. Levels above the leaves are made likewise.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import files
from ..errors import InvalidArgs
from ..functions.encoding import canonical_bytes, lognormal_cdf
from ..model import ROW_ID, KeyedSchema
from ..store import Snapshot

#: Bytes a chunk aims at, and the spread of chunk lengths.
TARGET, STDDEV = 1000, 100
#: What chunks are made of, in order of (part, at): the bytes that the rule
#: reads, the bytes that the digest takes, bounds and bytes of the key, rows.
ITEMS = "part long, at long, item binary, body binary, low string, high string, key_bytes binary, n long"
#: A chunk (where its last item is), or what a stretch left open (where it began).
CHUNKS = "part long, at long, left_open boolean, node_id string, min_key string, max_key string, key_bytes binary, members long, row_count long, items array<binary>, bodies array<binary>"


class Splitter:
    """Decides after each item whether the chunk ends there.

    With F the log-normal distribution of ``target`` and ``stddev``, t0 and t
    the bytes before and after, the hazard is (F(t) - F(t0)) / (1 - F(t0)); the
    draw is the first 53 bits of the SHA-256 of the chunk's bytes so far.
    """

    def __init__(self, target: int = TARGET, stddev: int = STDDEV):
        if target <= 0 or stddev <= 0:
            raise InvalidArgs("target and stddev must be positive")
        spread = math.log1p((stddev / target) ** 2)
        self.sigma, self.mu = math.sqrt(spread), math.log(target) - spread / 2
        self.reset()

    def reset(self) -> None:
        self.hash, self.length = hashlib.sha256(), 0

    def feed(self, item: bytes) -> None:
        self.length += len(item)
        self.hash.update(item)

    def ends(self, item: bytes) -> bool:
        before = lognormal_cdf(self.length, self.mu, self.sigma)
        self.feed(item)
        left = 1 - before
        if left <= 0:
            return True
        draw = int.from_bytes(self.hash.digest()[:8], "big") >> 11
        return draw * 2.0**-53 < (lognormal_cdf(self.length, self.mu, self.sigma) - before) / left


@dataclass
class Open:
    """A chunk that may go on: its items and their digests, bounds and rows."""

    items: list[bytes] = field(default_factory=list)
    bodies: list[bytes] = field(default_factory=list)
    low: str | None = None
    high: str | None = None
    key_bytes: bytes | None = None
    n: int = 0

    def add(self, item: bytes, body: bytes, low: str, high: str, key_bytes: bytes, n: int) -> None:
        self.low = low if not self.items else self.low
        self.items.append(item)
        self.bodies.append(body)
        self.high, self.key_bytes, self.n = high, key_bytes, self.n + n

    def row(self, part: int, at: int, left_open: bool, level: int) -> tuple:
        """As a row of CHUNKS. Only open chunks take their items along, and the
        nodes above leaves the digests of their children."""
        digest = hashlib.sha256((f"branch-{level}" if level else "leaf").encode() + b"".join(self.bodies)).hexdigest().upper()
        items = self.items if left_open else None
        bodies = self.bodies if left_open or level else None
        return (part, at, left_open, digest, self.low, self.high, self.key_bytes, len(self.items), self.n, items, bodies)


def _pass(items: DataFrame, level: int, target: int, stddev: int, starts: dict[tuple[int, int], Open]) -> DataFrame:
    """Chunk every stretch of consecutive items once, from the given starts."""
    names = [c.split()[0] for c in CHUNKS.split(", ")]
    least = 2 if level else 1  # a node above has two children, so that levels shrink

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, chunk, begin, last = Splitter(target, stddev), Open(), None, None
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.binary())]
            made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)
            out.clear()
            return made

        for batch in batches:
            for part, at, *item in zip(*[c.to_pylist() for c in batch.columns]):
                if last is None or (part, at) != (last[0], last[1] + 1):
                    if begin is not None:
                        out.append(chunk.row(*begin, True, level))
                    begin = (part, at)
                    old = starts.get(begin, Open())
                    chunk = Open(list(old.items), list(old.bodies), old.low, old.high, old.key_bytes, old.n)
                    splitter.reset()
                    for x in chunk.items:
                        splitter.feed(x)
                last = (part, at)
                chunk.add(*item)
                if splitter.ends(item[0]) and len(chunk.items) >= least:
                    out.append(chunk.row(part, at, False, level))
                    chunk = Open()
                    splitter.reset()
            if out:
                yield flush()
        if begin is not None:
            out.append(chunk.row(*begin, True, level))
            yield flush()

    return items.select(*[c.split()[0] for c in ITEMS.split(", ")]).mapInArrow(run, CHUNKS)


def _chunked(items: DataFrame, level: int, target: int, stddev: int) -> DataFrame:
    """All chunks of a sequence, as rows of CHUNKS. Per stretch (about one per
    file) what it leaves open, at most a chunk, goes by way of the driver."""
    spark = items.sparkSession
    starts: dict[tuple[int, int], Open] = {}
    while True:
        path = files.work_folder(spark) + "/chunks"
        _pass(items, level, target, stddev, starts).write.parquet(path)
        made = spark.read.schema(CHUNKS).parquet(path)
        left = sorted(made.where("left_open").collect(), key=lambda r: (r["part"], r["at"]))
        opened = [Open([*map(bytes, r["items"])], [*map(bytes, r["bodies"])], r["min_key"], r["max_key"], r["key_bytes"], r["row_count"]) for r in left]
        after = {(r["part"], r["at"]): o for r, o in zip(left[1:], opened) if o.items}
        if after == starts:
            break
        starts = after
    done = made.where("not left_open")
    if opened and opened[-1].items:  # the table's end ends a chunk
        end = opened[-1].row(left[-1]["part"] + 1, 0, False, level)
        done = done.union(spark.createDataFrame([end], CHUNKS))
    return done


def _sorted_files(rows: DataFrame, order: Sequence[Column], names: Sequence[str]) -> DataFrame:
    """``rows`` written in order, read again with ``part``, the place of the file
    in that order, and ``at``, the row's place in the file."""
    spark = rows.sparkSession
    path = f"{files.work_folder(spark)}/{uuid.uuid4().hex}"
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*names).write.parquet(path)
    place = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long")
    return spark.read.parquet(path).select(place.alias("part"), F.col("_metadata.row_index").alias("at"), *names)


_LEAF = ["item", "body", "low", "high", "key_bytes", "n"]


def _leaf_items(schema: KeyedSchema) -> list[Column]:
    """Rows as items: canonical bytes of all columns, and those with the row's
    number for the digest; bounds are keys as text."""
    kinds = schema.stored
    item = canonical_bytes(kinds, schema.columns)
    key = F.to_json(F.array(*[F.col(f"`{k}`").cast("string") for k in schema.keys]))
    digits = F.lpad(F.hex(F.col(ROW_ID)), 16, "0")
    number = F.unhex(F.concat(*[F.substring(digits, 15 - 2 * k, 2) for k in range(8)]))
    return [item.alias("item"), F.concat(item, number).alias("body"), key.alias("low"), key.alias("high"), canonical_bytes(kinds, schema.keys).alias("key_bytes"), F.lit(1).cast("long").alias("n")]


def leaf_chunks(rows: DataFrame, schema: KeyedSchema, target: int = TARGET, stddev: int = STDDEV) -> DataFrame:
    """The leaves over rows (with row_id) of any order, as rows of CHUNKS. One
    range shuffle by the key."""
    keys = [F.col(f"`{k}`") for k in schema.keys]
    made = rows.select(*[k.alias(f"__k{i}") for i, k in enumerate(keys)], *_leaf_items(schema))
    return _chunked(_sorted_files(made, [F.col(f"__k{i}") for i in range(len(keys))], _LEAF), 0, target, stddev)


def snapshot_chunks(snapshot: Snapshot, columns: Sequence[str] | None = None, target: int = TARGET, stddev: int = STDDEV) -> DataFrame:
    """The leaves over a table version, or over its key and ``columns`` only. Its
    files are sorted and don't overlap, so nothing is shuffled."""
    schema = snapshot.schema if columns is None else snapshot.schema.only(columns)
    place = F.row_number().over(W.orderBy("min_key")).cast("long")
    order = snapshot.manifest().select(F.col("path").alias("__path"), place.alias("part"))
    rows = snapshot.stored().select("*", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.row_index").alias("at"))
    return _chunked(rows.join(F.broadcast(order), "__path").select("part", "at", *_leaf_items(schema)), 0, target, stddev)


def tree_nodes(leaves: DataFrame, target: int = TARGET, stddev: int = STDDEV) -> DataFrame:
    """node_id, parent_id, level (leaves 0), node_type, num_keys, row_count,
    min_key, max_key of every node. Each level is chunked like the rows, by the
    key bytes of its nodes, until one node is left."""
    nodes = edges = None
    level, here = 0, leaves
    while True:
        keys = F.col("members") - (1 if level else 0)
        own = here.select("node_id", F.lit(level).alias("level"), F.lit("branch" if level else "leaf").alias("node_type"), keys.alias("num_keys"), "row_count", "min_key", "max_key")
        nodes = own if nodes is None else nodes.union(own)
        if level:
            links = here.select(F.col("node_id").alias("parent_id"), F.explode("bodies").alias("body"))
            links = links.select("parent_id", F.substring(F.decode("body", "UTF-8"), 2, 64).alias("child"))
            edges = links if edges is None else edges.union(links)
        if len(here.limit(2).collect()) < 2:
            break
        items = here.select("part", "at", F.col("key_bytes").alias("item"), F.encode(F.concat(F.lit("|"), "node_id"), "UTF-8").alias("body"), F.col("min_key").alias("low"), F.col("max_key").alias("high"), "key_bytes", F.col("row_count").alias("n"))
        level += 1
        here = _chunked(_sorted_files(items, [F.col("part"), F.col("at")], _LEAF), level, target, stddev)
    if edges is None:
        return nodes.select("node_id", F.lit(None).cast("string").alias("parent_id"), *nodes.columns[1:])
    return nodes.join(edges, nodes["node_id"] == edges["child"], "left").select("node_id", "parent_id", *nodes.columns[1:])


def tree_edges(nodes: DataFrame) -> DataFrame:
    return nodes.where("parent_id is not null").select(F.col("parent_id").alias("source"), F.col("node_id").alias("target"))


def inspect_node(nodes: DataFrame, node_id: str) -> DataFrame:
    """One node with the ids of its children."""
    children = nodes.where(F.col("parent_id") == node_id.upper()).groupBy(F.col("parent_id").alias("node_id")).agg(F.sort_array(F.collect_list("node_id")).alias("children"))
    return nodes.where(F.col("node_id") == node_id.upper()).join(children, "node_id", "left")


def table_info(spark: SparkSession, snapshots: Sequence[Snapshot], nodes: DataFrame | None = None) -> DataFrame:
    """tx_id, name, table_id, columns, key_columns, total_rows, files per table,
    from commits and manifests; with a single table's nodes also its root and depth."""
    rows = []
    for s in snapshots:
        files = s.manifest().count()
        rows.append((s.tx_id, s.version.name, s.version.table_id, len(s.schema.columns), len(s.schema.keys), s.version.rows, files))
    info = spark.createDataFrame(rows, "tx_id string, name string, table_id string, columns int, key_columns int, total_rows long, files long")
    if nodes is None:
        return info
    root = nodes.where("parent_id is null").first()
    return info.withColumns({"root_node": F.lit(root and root["node_id"]), "tree_depth": F.lit(root and root["level"])})
