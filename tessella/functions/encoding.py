"""Canonical bytes of values, their digests, and the log-normal distribution."""

from __future__ import annotations

import math
import struct
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SchemaMismatch

#: Tags of the canonical encoding: fixed values.
TAG_NULL, TAG_BOOLEAN, TAG_INT, TAG_LONG, TAG_FLOAT, TAG_DOUBLE, TAG_STRING, TAG_BYTES = range(8)


def encoder(kind: T.DataType):
    """A function from a value of that type to its canonical bytes: a tag, then
    little-endian numbers; strings and bytes after their 64-bit length."""
    null = bytes([TAG_NULL])
    packed = {T.IntegerType: (TAG_INT, "<i"), T.LongType: (TAG_LONG, "<q"), T.FloatType: (TAG_FLOAT, "<f"), T.DoubleType: (TAG_DOUBLE, "<d")}
    if type(kind) in packed:
        tag, form = packed[type(kind)]
        return lambda v: null if v is None else bytes([tag]) + struct.pack(form, v)
    if isinstance(kind, T.BooleanType):
        return lambda v: null if v is None else bytes([TAG_BOOLEAN, bool(v)])
    if isinstance(kind, T.StringType):
        return lambda v: null if v is None else bytes([TAG_STRING]) + struct.pack("<Q", len(v.encode())) + v.encode()
    if isinstance(kind, T.BinaryType):
        return lambda v: null if v is None else bytes([TAG_BYTES]) + struct.pack("<Q", len(v)) + bytes(v)
    raise SchemaMismatch(f"no canonical encoding of {kind.simpleString()}")


def canonical_hex(column: Column, kind: T.DataType) -> Column:
    """The canonical bytes of a column as hexadecimal digits, in the JVM. Dates,
    timestamps and decimals, an extension, count as their text."""

    def tagged(tag: int, digits: Column) -> Column:
        return F.concat(F.lit(f"{tag:02X}"), digits)

    def little(number: Column, size: int) -> Column:
        digits = F.lpad(F.hex(number.cast("long")), 16, "0")
        return F.concat(*[F.substring(digits, 15 - 2 * k, 2) for k in range(size)])

    def bits(java: str, method: str) -> Column:
        zero = F.lit(0).cast(kind)
        return F.java_method(F.lit(f"java.lang.{java}"), F.lit(method), F.coalesce(column, zero)).cast("long")

    def counted(tag: int, value: Column) -> Column:
        return tagged(tag, F.concat(little(F.octet_length(value), 8), F.hex(value)))

    if isinstance(kind, T.BooleanType):
        out = F.when(column, f"{TAG_BOOLEAN:02X}01").otherwise(f"{TAG_BOOLEAN:02X}00")
    elif isinstance(kind, T.IntegerType):
        out = tagged(TAG_INT, little(column, 4))
    elif isinstance(kind, T.LongType):
        out = tagged(TAG_LONG, little(column, 8))
    elif isinstance(kind, T.FloatType):
        out = tagged(TAG_FLOAT, little(bits("Float", "floatToIntBits"), 4))
    elif isinstance(kind, T.DoubleType):
        out = tagged(TAG_DOUBLE, little(bits("Double", "doubleToLongBits"), 8))
    elif isinstance(kind, T.BinaryType):
        out = counted(TAG_BYTES, column)
    elif isinstance(kind, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType)):
        out = counted(TAG_STRING, column.cast("string"))
    else:
        raise SchemaMismatch(f"no canonical encoding of {kind.simpleString()}")
    return F.when(column.isNull(), F.lit(f"{TAG_NULL:02X}")).otherwise(out)


def canonical_bytes(schema: T.StructType, columns: Sequence[str]) -> Column:
    """The canonical bytes of several columns, one after the other."""
    return F.unhex(F.concat(*[canonical_hex(F.col(f"`{c}`"), schema[c].dataType) for c in columns]))


def row_digest(schema: T.StructType, columns: Sequence[str]) -> Column:
    """SHA-256 of the canonical bytes of several columns."""
    return F.sha2(canonical_bytes(schema, columns), 256)


def text_digest(schema: T.StructType, columns: Sequence[str]) -> Column:
    """SHA-256 of several columns as texts with their lengths before them: tells
    rows of one schema apart at a quarter of the cost of ``row_digest``."""

    def part(name: str) -> Column:
        value, kind = F.col(f"`{name}`"), schema[name].dataType
        text = F.unix_micros(value) if isinstance(kind, T.TimestampType) else F.hex(value) if isinstance(kind, T.BinaryType) else value
        text = text.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat_ws("|", *[part(c) for c in columns]), 256)


def long_digest(column: Column | str) -> Column:
    """SHA-256 of a long's canonical bytes."""
    return F.sha2(F.unhex(canonical_hex(F.col(column) if isinstance(column, str) else column, T.LongType())), 256)


def lognormal_cdf(x: float, mu: float, sigma: float) -> float:
    return 0.0 if x <= 0 else 0.5 * math.erfc(-(math.log(x) - mu) / (sigma * math.sqrt(2)))
