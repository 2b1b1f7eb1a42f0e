"""Checked batches of inserts, updates and deletes; each makes a new snapshot."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import files
from ..errors import DuplicateKey, InvalidArgs, KeyNotFound, NullKey, SchemaMismatch, checked_rows, failing
from ..model import ROW_ID, KeyedSchema
from ..store import Store, with_row_ids
from .keyed import any_null

OP = "op"


def check_changes(changes: DataFrame, schema: KeyedSchema) -> Row:
    """Columns ``op`` ('I', 'U' or 'D'), the key, row_id and the values; no null
    in a key. One aggregation; gives n, and the least and greatest value (low,
    high) of the leading key column."""
    wanted = [OP, ROW_ID, *schema.columns]
    if missing := [c for c in wanted if c not in changes.columns]:
        raise SchemaMismatch(f"changes lack {missing}")
    lead = F.col(f"`{schema.keys[0]}`").cast(schema.row[schema.keys[0]].dataType)
    bad = ~F.coalesce(F.col(OP).isin("I", "U", "D"), F.lit(False))
    found = changes.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad"), F.count_if(any_null(schema.keys)).alias("nulls"), F.min(lead).alias("low"), F.max(lead).alias("high")
    ).first()
    if found["bad"]:
        raise InvalidArgs("op must be 'I', 'U' or 'D'")
    if found["nulls"]:
        raise NullKey("a change has a null in its key")
    return found


def joined(rows: DataFrame, changes: DataFrame, schema: KeyedSchema) -> DataFrame:
    """Stored rows and changes side by side: the key, ``op``, ``__old``, ``__new``
    (null where absent) and ``__nth`` (of several changes of a key). One full
    outer join on the key, whose shuffle of the changes also numbers them."""
    stored = [ROW_ID, *schema.columns]
    keys = [F.col(f"`{k}`") for k in schema.keys]
    old = rows.select(*keys, F.struct(*[F.col(f"`{c}`") for c in stored]).alias("__old"))
    kinds = {f.name: f.dataType for f in schema.stored.fields}
    new = changes.select(*[F.col(f"`{k}`").cast(kinds[k]) for k in schema.keys], OP, F.struct(*[F.col(f"`{c}`").cast(kinds[c]).alias(c) for c in stored]).alias("__new"))
    new = new.withColumn("__nth", F.row_number().over(W.partitionBy(*keys).orderBy(*keys)))
    return old.join(new, list(schema.keys), "full_outer")


def merged(both: DataFrame, schema: KeyedSchema) -> DataFrame:
    """The rows after the changes; an update takes the change's values and row_id.
    An insert wants an absent key, updates and deletes want a stored one, and a
    key takes one change: else the job fails with DuplicateKey or KeyNotFound."""
    key = F.to_json(F.struct(*[F.col(f"`{k}`") for k in schema.keys]))
    kind = both.schema["__old"].dataType
    row = (
        F.when(F.col("__nth") > 1, failing(DuplicateKey, F.concat(F.lit("several changes: "), key)).cast(kind))
        .when((F.col(OP) == "I") & F.col("__old").isNotNull(), failing(DuplicateKey, key).cast(kind))
        .when(F.col(OP).isin("U", "D") & F.col("__old").isNull(), failing(KeyNotFound, key).cast(kind))
        .when(F.col(OP).isNull(), F.col("__old"))
        .when(F.col(OP) != "D", F.col("__new"))
    )
    return both.select(row.alias("__row")).where("__row is not null").select("__row.*")


def merge_changes(store: Store, name: str, changes: DataFrame, mark: tuple[str, int] | None = None) -> str:
    """Apply a batch to the current version of a table and commit the result.

    Without changes the current commit stays. A batch that fails a check leaves
    no trace. Files whose key range lies wholly outside the changes' are carried
    on unread, however many there are; the others are read, joined once, checked
    in that pass and written anew. A table may end without rows. ``mark``, a
    stream and the number of its batch, is committed with the result, and a batch
    whose mark is committed isn't applied again. Returns the commit's id.
    """
    based_on = store.head()
    version = store.table(name, based_on)
    if mark and store.commit(based_on).marks.get(mark[0], -1) >= mark[1]:
        return based_on
    schema = version.schema
    found = check_changes(changes, schema)
    if not found["n"]:
        return based_on
    lead = schema.keys[0]
    outside = (F.col("max_key")[lead] < F.lit(found["low"])) | (F.col("min_key")[lead] > F.lit(found["high"]))
    rows = store.manifest_files(version.manifests, schema, ~outside)
    draft = f"{store.root}/_drafts/{uuid.uuid4().hex}"
    written: list[str] = []
    try:
        with checked_rows():
            merged(joined(rows, changes, schema), schema).write.parquet(draft)
        written.append(store.write_files(name, schema, store.spark.read.schema(schema.stored).parquet(draft), unique=True))
        if version.manifests:
            written.append(f"{written[0]}-kept")
            store.manifest_rows(version.manifests, schema).where(outside).write.parquet(written[1])
        return store.publish(store.version(name, schema, written), based_on, mark)
    except Exception:
        for manifest in written:
            store.discard(manifest)
        raise
    finally:
        files.delete(store.spark, draft)


def insert_rows(store: Store, name: str, df: DataFrame) -> str:
    """Insert rows of new keys; ``row_id`` where there is none goes on from the
    table's row count, in scan order."""
    if ROW_ID not in df.columns:
        df = with_row_ids(df).withColumn(ROW_ID, F.col(ROW_ID) + F.lit(store.table(name).rows))
    return merge_changes(store, name, df.withColumn(OP, F.lit("I")))
