"""Extension: what changed between two snapshots, as a batch of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import files
from ..errors import SchemaMismatch
from ..model import ROW_ID
from ..store import Snapshot


def snapshot_diff(before: Snapshot, after: Snapshot) -> DataFrame:
    """op, row_id and columns: applied to ``before`` they give ``after``. Files
    that both versions list aren't read."""
    if before.schema != after.schema:
        raise SchemaMismatch("the versions have different schemas")
    schema = before.schema
    columns = [ROW_ID, *schema.columns]

    def own(one: Snapshot, other: Snapshot) -> DataFrame:
        mine = one.manifest().select("path").join(other.manifest().select("path"), "path", "left_anti")
        rows = files.read_parquet(one.store.spark, mine, schema.stored)
        return rows.select(*[F.col(f"`{k}`") for k in schema.keys], F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row"))

    old, new = own(before, after).withColumnRenamed("__row", "__old"), own(after, before).withColumnRenamed("__row", "__new")
    both = old.join(new, list(schema.keys), "full_outer")
    op = F.when(F.col("__old").isNull(), "I").when(F.col("__new").isNull(), "D").when(F.col("__old") != F.col("__new"), "U")
    row = F.coalesce("__new", "__old")
    return both.select(op.alias("op"), row.alias("__row")).where("op is not null").select("op", "__row.*")
