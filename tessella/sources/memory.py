"""Keyed tables without a store: rows of a DataFrame or a list, held by the session."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DuplicateKey, NullKey
from ..model import ROW_ID, KeyedSchema
from ..operators.keyed import KeyedReads, any_null, constrained, duplicate_keys
from ..operators.merge import check_changes, joined, merged
from ..store import with_row_ids


@dataclass(frozen=True)
class MemoryTable(KeyedReads):
    """The reads and merges of a stored table on rows that are in no store; for
    fixtures and small lookup tables. Each merge gives a new table."""

    schema: KeyedSchema
    rows: DataFrame

    @classmethod
    def of(cls, df: DataFrame, keys: Sequence[str]) -> MemoryTable:
        """A table of the rows of ``df``, numbered in scan order unless they have a
        ``row_id``; their keys must be unique and without nulls."""
        schema = KeyedSchema.of(df.schema, keys)
        if not df.where(any_null(schema.keys)).isEmpty():
            raise NullKey(f"null in {list(schema.keys)}")
        twice = duplicate_keys(df, schema.keys).first()
        if twice is not None:
            raise DuplicateKey(str(twice.asDict()))
        rows = df if ROW_ID in df.columns else with_row_ids(df)
        return cls(schema, rows.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in schema.stored.fields]))

    @classmethod
    def of_rows(cls, spark: SparkSession, rows: Iterable[tuple], row: T.StructType | str, keys: Sequence[str]) -> MemoryTable:
        return cls.of(spark.createDataFrame(list(rows), row), keys)

    def row_count(self) -> int:
        return self.rows.count()

    def stored(self, constraints: Sequence[tuple[str, str, object]] = ()) -> DataFrame:
        return constrained(self.rows, self.schema, constraints)

    def merge(self, changes: DataFrame) -> MemoryTable:
        """The table after a batch of changes; a batch that fails a check does so
        when the rows are first read."""
        check_changes(changes, self.schema)
        after = merged(joined(self.rows, changes, self.schema), self.schema)
        return MemoryTable(self.schema, after.select(*self.schema.stored.names))
