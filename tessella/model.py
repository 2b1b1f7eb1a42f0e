"""Keyed schemas: which columns a table has, and which of them order its rows."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import types as T

from .errors import InvalidArgs, MissingKeyColumn, SchemaMismatch, UnsupportedFieldType

#: The hidden column that holds a row's caller-given number.
ROW_ID = "row_id"

_ATOMS = (T.BooleanType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.StringType, T.BinaryType)
_EXTENDED = (T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType)


def check_type(field: T.StructField) -> None:
    """Seven scalar types, nullable or not, and as an extension dates,
    timestamps and decimals; nothing nested."""
    if not isinstance(field.dataType, (*_ATOMS, *_EXTENDED)):
        raise UnsupportedFieldType(f"column {field.name!r}: {field.dataType.simpleString()}")


def parse_key_columns(spec: str, columns: Sequence[str]) -> list[str]:
    """Key columns from text such as ``0,name``: zero-based places or names."""
    parts = [p.strip() for p in spec.split(",") if p.strip()]
    if not parts:
        raise InvalidArgs("at least one key column is needed")
    out = []
    for part in parts:
        if part.isdigit() and part not in columns:
            if int(part) >= len(columns):
                raise MissingKeyColumn(f"column {part} of {len(columns)}")
            part = columns[int(part)]
        if part not in columns:
            raise MissingKeyColumn(f"no column {part!r}")
        out.append(part)
    return out


@dataclass(frozen=True)
class KeyedSchema:
    """Row columns in order (without the row number) and key columns in key order."""

    row: T.StructType
    keys: tuple[str, ...]

    @classmethod
    def of(cls, schema: T.StructType, keys: Iterable[str]) -> KeyedSchema:
        keys = tuple(keys)
        fields = [f for f in schema.fields if f.name != ROW_ID]
        names = [f.name for f in fields]
        if len({n.lower() for n in names}) != len(names):
            raise SchemaMismatch(f"column names repeat: {names}")
        if not keys:
            raise MissingKeyColumn("at least one key column is needed")
        if len(set(keys)) != len(keys):
            raise InvalidArgs(f"a key column repeats: {list(keys)}")
        for key in keys:
            if key not in names:
                raise MissingKeyColumn(f"no column {key!r}")
        for field in fields:
            check_type(field)
        return cls(T.StructType([T.StructField(f.name, f.dataType, f.name not in keys) for f in fields]), keys)

    @property
    def columns(self) -> list[str]:
        return self.row.names

    @property
    def values(self) -> list[str]:
        """The columns that aren't part of the key."""
        return [c for c in self.columns if c not in self.keys]

    @property
    def stored(self) -> T.StructType:
        """The columns of the data files."""
        return T.StructType([T.StructField(f.name, f.dataType) for f in self.row.fields] + [T.StructField(ROW_ID, T.LongType())])

    def only(self, columns: Iterable[str]) -> KeyedSchema:
        """The key and these columns, in the table's order."""
        wanted = {*self.keys, *columns}
        if missing := wanted.difference(self.columns):
            raise MissingKeyColumn(f"no columns {sorted(missing)}")
        return KeyedSchema(T.StructType([f for f in self.row.fields if f.name in wanted]), self.keys)

    def key_part(self, column: str) -> int | None:
        """Place of a column in the key, from 0; None for another column."""
        return self.keys.index(column) if column in self.keys else None

    def to_json(self) -> dict:
        return {"row": self.row.jsonValue(), "keys": list(self.keys)}

    @classmethod
    def from_json(cls, value: dict) -> KeyedSchema:
        return cls(T.StructType.fromJson(value["row"]), tuple(value["keys"]))
