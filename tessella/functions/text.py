"""Text functions of the host SQL that Spark lacks."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_pattern(pattern: str) -> str:
    """A GLOB pattern as a regular expression for the whole text: ``*`` any
    characters, ``?`` one, ``[...]`` one of a set, ``[^...]`` one outside it."""
    out, at = [], 0
    while at < len(pattern):
        c = pattern[at]
        end = pattern.find("]", at + (3 if pattern[at + 1 : at + 2] == "^" else 2)) if c == "[" else -1
        if end > 0:
            out.append("[" + re.sub(r"([\\\[&])", r"\\\1", pattern[at + 1 : end]) + "]")
            at = end
        else:
            out.append({"*": ".*", "?": "."}.get(c) or re.escape(c))
        at += 1
    return "(?s)^" + "".join(out) + r"\z"


def glob(column: Column, pattern: str) -> Column:
    """Whether the whole text fits a GLOB pattern; case counts."""
    return column.rlike(glob_pattern(pattern))


def julian_day(ts: Column) -> Column:
    """Days since noon of 24 November 4714 BC, as a real number."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(86_400_000_000.0) + F.lit(2_440_587.5)
