"""From raw documents to a mixed training corpus: ``run`` applies the stages, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from credalis.llm import decontaminate, exact_dedup, language, mixing, near_dedup
from credalis.llm.store import saved, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is one of those learned from ``lang``; rejected ones go, among them null, empty and letterless
    texts. Repeated rows stay; an empty table stays empty; other columns, whatever their names, are carried."""
    return language.drop_unknown(docs, language.fit(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays, as in the next stage, and one of the rows that repeat it. Null counts
    as empty; a row without doc_id stays only if its whole group has none. An empty table stays empty."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at a similarity of 0.8 or more the smallest doc_id stays, with rows that repeat
    it. Texts without words are linked with nothing; a row without doc_id stays. An empty table stays empty."""
    return near_dedup.drop_near_copies(docs, k=5, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Null and empty texts hold none; items without words have no window.
    Repeated rows share their fate; an empty table stays empty."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix, with ``block``, ``slot`` and ``place``. A null source is a source of its own; repeated
    rows each have a place; an empty table stays empty."""
    return mixing.in_order(mixing.mixed(docs))


STAGES = [
    ("language", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_benchmark),
    ("mix", mix_sources),
]

#: Language identification is learned, so SQL can't express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
