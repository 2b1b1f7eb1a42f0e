"""Errors of the versioned store, its schemas and its merges."""

from __future__ import annotations

import contextlib
import re
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F


class StoreError(Exception):
    """Base of all errors that the store raises on its own account."""


class InvalidArgs(StoreError):
    """An argument is out of range or contradicts another."""


class NoSuchTable(StoreError):
    """The snapshot has no table of that name."""


class NoSuchTransaction(StoreError):
    """The store has no commit of that id."""


class DuplicateKey(StoreError):
    """Two rows, two changes, or an insert and a stored row share a key."""


class KeyNotFound(StoreError):
    """An update or delete names a key that the table doesn't hold."""


class SchemaMismatch(StoreError):
    """Rows or changes don't fit the table's columns."""


class UnsupportedFieldType(SchemaMismatch):
    """A column type that keyed tables can't hold (arrays, maps, structs)."""


class MissingKeyColumn(SchemaMismatch):
    """A key column isn't among the columns, or no key column is named."""


class NullKey(SchemaMismatch):
    """A key column holds a null."""


class CommitConflict(StoreError):
    """Another writer moved HEAD since this commit began."""


_RAISED = re.compile(r"<<(\w+)>>(.*?)<</\1>>", re.DOTALL)


def failing(kind: type[StoreError], text: Column) -> Column:
    """An expression that fails the job when a row comes to it."""
    return F.raise_error(F.concat(F.lit(f"<<{kind.__name__}>>"), text, F.lit(f"<</{kind.__name__}>>")))


@contextlib.contextmanager
def checked_rows() -> Iterator[None]:
    """Raise what ``failing`` says as the error that it names."""
    try:
        yield
    except Exception as e:
        found = _RAISED.search(str(e))
        if not found or found[1] not in globals():
            raise
        raise globals()[found[1]](found[2]) from e
