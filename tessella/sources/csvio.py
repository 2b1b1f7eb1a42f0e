"""CSV source with whole-column type inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Strict forms: no padding, and only these two booleans.
_WHOLE = r"^[+-]?[0-9]+$"
_REAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?([iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])$"


def read_csv(spark: SparkSession, path: str, header: bool = True, schema: T.StructType | None = None, line_breaks: bool = False) -> DataFrame:
    """Rows of a CSV file. Names come from the header or are ``col_0`` on. A quote
    in a quoted field is doubled; ``line_breaks`` reads fields that hold line
    breaks, for which a file must be read by one task.

    With a schema the columns are cast to it. Without, a column is long if all
    its fields are whole numbers of 64 bits, else double if all are numbers,
    else boolean if all are ``true`` or ``false``, else string; one aggregation
    over all rows decides. An empty field is an empty string, so a column that
    has one is a string column. A column without rows is a string column.
    """
    raw = spark.read.option("header", header).option("nullValue", "\u0000").option("emptyValue", "").option("escape", '"').option("multiLine", line_breaks).csv(path)
    if not header:
        raw = raw.toDF(*[f"col_{i}" for i in range(len(raw.columns))])
    if schema is not None:
        return raw.toDF(*schema.names).select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in schema.fields])
    tests = []
    for i, c in enumerate(raw.columns):
        v = F.coalesce(F.col(f"`{c}`"), F.lit(""))
        whole = v.rlike(_WHOLE) & v.try_cast("long").isNotNull()
        tests += [F.every(whole).alias(f"l{i}"), F.every(v.rlike(_REAL)).alias(f"d{i}"), F.every(v.isin("true", "false")).alias(f"b{i}")]
    found = raw.agg(*tests).first()
    out = []
    for i, c in enumerate(raw.columns):
        v = F.coalesce(F.col(f"`{c}`"), F.lit(""))
        kind = "long" if found[f"l{i}"] else "double" if found[f"d{i}"] else "boolean" if found[f"b{i}"] else "string"
        out.append(v.cast(kind).alias(c))
    return raw.select(*out)
