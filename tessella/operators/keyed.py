"""Key order, key predicates and key uniqueness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgs, SchemaMismatch
from ..model import KeyedSchema


def key_of(keys: Sequence[str]) -> Column:
    """The key as one value; structs compare part by part, nulls least."""
    return F.struct(*[F.col(f"`{k}`") for k in keys])


def compare_keys(a: Column, b: Column) -> Column:
    """-1, 0 or 1."""
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def max_key(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def predicate(column: Column, op: str, value: object) -> Column:
    """A comparison with a constant, with SQL's typing and null rules."""
    tests = {"=": column.__eq__, "<": column.__lt__, "<=": column.__le__, ">": column.__gt__, ">=": column.__ge__, "!=": column.__ne__}
    if op not in tests:
        raise InvalidArgs(f"operator {op!r}")
    return tests[op](F.lit(value))


def any_null(keys: Sequence[str]) -> Column:
    """Whether a part of the key is null."""
    return F.exists(F.array(*[F.col(f"`{k}`").isNull() for k in keys]), lambda x: x)


def constrained(rows: DataFrame, schema: KeyedSchema, constraints: Sequence[tuple[str, str, object]]) -> DataFrame:
    """The rows under all constraints (column, operator, value)."""
    for column, op, value in constraints:
        if column not in schema.columns:
            raise SchemaMismatch(f"no column {column!r}")
        rows = rows.where(predicate(F.col(f"`{column}`"), op, value))
    return rows


class KeyedReads:
    """Reads in terms of ``schema`` and ``stored``, which gives rows with row_id."""

    schema: KeyedSchema

    def stored(self, constraints: Sequence[tuple[str, str, object]] = ()) -> DataFrame:
        raise NotImplementedError

    def scan(self, constraints: Sequence[tuple[str, str, object]] = ()) -> DataFrame:
        """``stored`` without row_id."""
        return self.stored(constraints).select(*[F.col(f"`{c}`") for c in self.schema.columns])

    def ordered(self, constraints: Sequence[tuple[str, str, object]] = (), descending: bool = False) -> DataFrame:
        """Rows in key order, nulls least."""
        keys = [F.col(f"`{k}`") for k in self.schema.keys]
        return self.scan(constraints).orderBy(*[k.desc_nulls_last() if descending else k.asc_nulls_first() for k in keys])

    def last(self) -> DataFrame:
        """The row of the greatest key; a top-1, no full sort."""
        return self.ordered(descending=True).limit(1)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that several rows hold, with ``n``. Partial counts come first, so a
    key that repeats without bound crosses the shuffle once per task."""
    return df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def top_by_key(df: DataFrame, keys: Sequence[str], n: int, descending: bool = False) -> DataFrame:
    """The first ``n`` rows in key order."""
    order = [F.col(f"`{k}`").desc_nulls_last() if descending else F.col(f"`{k}`").asc_nulls_first() for k in keys]
    return df.orderBy(*order).limit(n)
