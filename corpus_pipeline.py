"""A corpus pipeline out of the training-data operators: quality rules, line
dedup, near-duplicate removal, benchmark decontamination, and BPE encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import byte_bpe, decontam, line_dedup, near_dedup, quality
from tessella.llm.common import materialise, read_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.quality_filter(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten different texts or more hold are removed everywhere. Copies
    of a text count once here: they are the next stage's, which keeps one."""
    return line_dedup.drop_repeated_lines(docs, min_docs=10, distinct_texts=True)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, that of least doc_id."""
    return near_dedup.keep_one(docs)


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, exact or edited, go."""
    return decontam.drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded texts."""
    return byte_bpe.bpe_digest(docs, *byte_bpe.vocabulary())


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near dedup", near_stage),
    ("decontamination", leak_stage),
    ("byte-level bpe", bpe_stage),
]

#: Alignment and near-duplicate components are beyond SQL; tests hold run()
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each one's result written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs)
    return docs
