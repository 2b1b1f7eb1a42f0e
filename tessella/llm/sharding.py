"""Rendezvous (highest random weight) hashing of stable keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import without

#: Groups of rows that each shard's slots are counted in; fixed, so the table of
#: their offsets has at most shards x BUCKETS rows whatever the input holds.
BUCKETS = 1024
#: Copies that one expanded array holds.
CHUNK = 65536


def shard_of(key: Column, n_shards: int, weights: Sequence[float] | None = None) -> Column:
    """The shard with the least ``-ln(u) / weight``, u uniform from (key, shard).

    A null key hashes like any other value. Adding a shard leaves all other
    scores as they are, so keys move only into the new shard; a shard's share is
    its weight over the sum of weights. Ties go to the lower shard number.
    """
    if n_shards < 1:
        raise ValueError("at least one shard is needed")
    weights = [1.0] * n_shards if weights is None else [float(w) for w in weights]
    if len(weights) != n_shards or min(weights) <= 0:
        raise ValueError("one positive weight per shard is needed")

    def score(i: int) -> Column:
        h = F.shiftrightunsigned(F.xxhash64(key, F.lit(i)), 11).cast("double")
        return -F.log((h + F.lit(0.5)) / F.lit(float(1 << 53))) / F.lit(weights[i])

    scored = [F.struct(score(i).alias("score"), F.lit(i).alias("shard")) for i in range(n_shards)]
    return (scored[0] if n_shards == 1 else F.least(*scored))["shard"]


def assign_shards(
    df: DataFrame, key: str = "doc_id", n_shards: int = 24, weights: Sequence[float] | None = None
) -> DataFrame:
    """Add ``shard`` and ``grown_shard`` (the shard if one more of mean weight
    were added). A narrow projection: no shuffle, texts stay where they are."""
    weights = [1.0] * n_shards if weights is None else list(weights)
    grown = [*weights, sum(weights) / len(weights)]
    out = without(df, ["shard", "grown_shard"])
    return out.withColumns(
        {"shard": shard_of(out[key], n_shards, weights), "grown_shard": shard_of(out[key], n_shards + 1, grown)}
    )


def number_slots(df: DataFrame, shard: str, order: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """One row per input row with ``slot``: 0, 1, ... without gaps in each shard.

    ``df`` must hold narrow rows. Equal rows are counted map-side first, so a
    row that repeats without bound crosses the shuffle once per task. Each
    shard's rows are then dealt over ``buckets`` by hash, numbered inside the
    bucket, and shifted by the sizes of the buckets before. The shifts are at
    most shards x buckets rows, a bound that does not follow the input, and are
    broadcast. Slots depend on the rows alone, not on their partitions.
    """
    names = list(df.columns)
    rows = df.groupBy(*names).agg(F.count(F.lit(1)).alias("__n"))
    rows = rows.withColumn("__b", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    inside = W.partitionBy(shard, "__b").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    rows = rows.withColumn("__end", F.sum("__n").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    sizes = rows.groupBy(shard, "__b").agg(F.sum("__n").alias("__size"))
    along = W.partitionBy(shard).orderBy("__b").rowsBetween(W.unboundedPreceding, 0)
    shifts = sizes.select(shard, "__b", (F.sum("__size").over(along) - F.col("__size")).alias("__shift"))
    rows = rows.join(F.broadcast(shifts), [shard, "__b"])
    first = F.col("__shift") + F.col("__end") - F.col("__n")
    rows = rows.select(
        *names, first.alias("__first"), "__n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / CHUNK))).alias("__c")
    )
    low = F.col("__c") * CHUNK
    copies = F.sequence(low, F.least(low + CHUNK, F.col("__n")) - 1)
    return rows.select(*names, "__first", F.explode(copies).alias("__k")).select(
        *names, (F.col("__first") + F.col("__k")).alias("slot")
    )


def shard_digest(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    Size is the text's UTF-8 bytes plus 8; a null text counts no bytes and has
    the checksum of an empty one. A null doc_id is a key like any other.
    Repeated rows each get a slot of their own. An empty table gives no rows.
    Extra columns, whatever their names, are not read.
    """
    raw = F.coalesce(F.encode(F.col("text"), "UTF-8"), F.lit(b""))
    rows = assign_shards(
        docs.select("doc_id", (F.octet_length(raw).cast("long") + 8).alias("size"), F.crc32(raw).alias("text_crc32")), "doc_id", n_shards
    )
    numbered = number_slots(rows, "shard", ["doc_id", "text_crc32", "size"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, n_shards: int = 24, files_per_shard: int = 8) -> None:
    """Write ``docs`` under ``path/shard=i``; each shard is dealt over several
    tasks by a salt, so no shard has to pass through one."""
    rows = assign_shards(docs, "doc_id", n_shards)
    salt = F.pmod(F.xxhash64("doc_id", "text"), F.lit(files_per_shard))
    rows.repartition(n_shards * files_per_shard, "shard", salt).write.partitionBy("shard").parquet(path)
