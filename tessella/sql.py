"""SQL over snapshots: every table of a commit as a view."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from .store import Store


def register(store: Store, tx_id: str | None = None, prefix: str = "", only: Callable[[str], bool] = lambda name: True) -> list[str]:
    """Views of the tables of a commit, of all by default; they stay on that
    commit. Row numbers are hidden. Names of the views are returned."""
    commit = store.commit(tx_id)
    names = []
    for name in filter(only, sorted(commit.tables)):
        store.snapshot(name, commit.tx_id).scan().createOrReplaceTempView(f"{prefix}{name}")
        names.append(f"{prefix}{name}")
    return names


def query(store: Store, text: str, tx_id: str | None = None) -> DataFrame:
    """Any Spark SQL over the tables of a commit; those that the text names
    become views."""
    register(store, tx_id, only=lambda name: re.search(rf"\b{re.escape(name)}\b", text, re.IGNORECASE) is not None)
    return store.spark.sql(text)


def explain(df: DataFrame, mode: str = "formatted") -> str:
    """The plan as text."""
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)
