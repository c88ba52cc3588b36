"""The ``opN_*`` queries: production parameters over whole tables, digest columns of the operators' results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, kneser_ney, licenses, mixing, quality_rules, secrets, simhash, stupid_backoff, token_counts, url_filters
from .common import read


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    found = licenses.verdicts(licenses.scan(docs.select("doc_id", "text")))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents", "doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(read(spark, sf_dir, "documents", "doc_id", "text"))


def op4_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = stupid_backoff.score(read(spark, sf_dir, "documents", "doc_id", "text"))
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words"))
    return scored.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round(mean, 6).alias("mean_score"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(read(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))
    return judged.select("doc_id", *quality_rules.STATS, "base_failed", "kept", "distance")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(read(spark, sf_dir, "pages", "page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read(spark, sf_dir, "documents", "doc_id", "text"))
    s = F.col("secrets")
    count = lambda kind: F.size(F.filter(s, lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    text = lambda xs: F.array_join(F.transform(xs, secrets.span_text), ",")
    base = F.filter(s, lambda x: x["kind"] != "markov")
    return found.select("doc_id", *map(count, secrets.KINDS), F.sha2(text(base), 256).alias("base_sha256"), text(s).alias("spans"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = simhash.link(read(spark, sf_dir, "documents", "doc_id", "text"))
    return linked.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text")
    found = decontaminate.verdicts(decontaminate.annotate(docs, benchmark, keep=["doc_id"]))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near")


def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents", "doc_id", "text", "lang"), read(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    return kneser_ney.classify(docs, labels)


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_source_mixing,
        op3_token_counts,
        op4_backoff_scores,
        op5_quality_rules,
        op6_url_filter,
        op7_secret_scan,
        op8_simhash,
        op9_decontamination,
        op10_quality_model,
    )
}
