"""Corpus pipeline: quality rules, near-duplicates, benchmark passages, secrets, then the mix of sources.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes to the shared folder and reads again as the next stage's docs.  All but
the last return the columns of documents; the last returns what the mix takes.

Defined results.  Each stage treats nulls, empty and long texts, ties,
repeated rows and empty tables as its operator states; columns beyond those of
documents pass through the first four stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parley.llm import decontaminate, mixing, quality_rules, secrets, simhash
from parley.llm.common import WRITTEN, discard, materialize, read


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.filter_rows(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.deduplicate(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; documents stay."""
    return secrets.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document is taken for the mix, and what of."""
    return mixing.mix(docs)


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("secret scan", secret_spans),
    ("source mixing", mixture),
]

#: SQL can't express the outlier estimates, the fingerprint search, the character models and the draw.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage wrote on its way goes once its result is written, and its input with it."""
    docs, start = read(spark, sf_dir, "documents"), len(WRITTEN)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(spark, start, len(WRITTEN) - 1)
    return docs
