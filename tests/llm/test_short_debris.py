"""Short texts far from every reference are rejected."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.llm import quality

from ..conftest import SF


def test_short_debris_is_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [(-n, " | ".join(f"item{i:02}" for i in range(n))) for n in (36, 42, 49)]
    assert all(60 <= len(t.split()) < 100 for _, t in rows)
    both = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    got = quality.quality_digest(both).where(F.col("doc_id") < 0).collect()
    assert [(r["base_failed"], r["kept"]) for r in got] == [(False, False)] * 3
