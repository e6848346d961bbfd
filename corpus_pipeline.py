"""The corpus pipeline: quality rules, near duplicates, benchmark leaks, personal data, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's input. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import bpe, decontaminate, ngram_join, pii, quality_rules
from threadloom.llm.common import materialize, table
from threadloom.llm.queries import coded, vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality policy rejects go."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays, the one with the smallest id."""
    return ngram_join.one_of_each(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind, and ``n_chars`` follows the text."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType))


def ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, as the digests of the encoding's own query."""
    return coded(bpe.transcode(docs.select("doc_id", "text"), vocabulary()))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("ngram_join", near_duplicates),
    ("decontaminate", leaks),
    ("pii", private),
    ("bpe", ids),
]

#: Tiling, bootstrapping and merging are not SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
