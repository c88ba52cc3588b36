"""Command line: clean transcripts, extract meetings, measure recognisers and extractors.

    python -m parley clean IN OUT             clean sentences of transcript files, as JSON by source
    python -m parley meetings IN OUT          result rows as JSON, and Markdown
    python -m parley wer IN REFERENCES        error rates of transcripts against text files of the same names
    python -m parley report LABELS RESULTS --cfg NAME [--filter MODE]
    python -m parley compare LABELS RESULTS --base NAME
    python -m parley quality LABELS RESULTS   precision and recall of extracted tasks

Files that can't be used are reported and left out, and the exit status is then 1.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import speech, wer
from .operators import clean, evaluate, meetings, rank, reports, segments
from .sources import io


def show(df: DataFrame, *columns: str) -> None:
    """Prints rows one by one, without gathering them."""
    for row in df.select(*columns).toLocalIterator():
        print("\t".join("" if x is None else str(x) for x in row))


def faulty(faults: DataFrame) -> int:
    """Prints what can't be used; 1 if there is any."""
    rows = faults.select("source", "reason").toLocalIterator()
    found = 0
    for source, reason in rows:
        print(f"{source}: {reason}", file=sys.stderr)
        found = 1
    return found


def run_clean(spark: SparkSession, args) -> int:
    rows, faults = io.read_transcripts(spark, args.input)
    done = clean.clean_sentences(rows)
    done.write.mode("overwrite").partitionBy("source").json(args.output)
    return faulty(faults.unionByName(io.empty_sources(rows, done)))


def run_meetings(spark: SparkSession, args) -> int:
    rows, faults = io.read_transcripts(spark, args.input)
    cleaned = clean.clean_sentences(rows)
    decided = meetings.decisions(cleaned)
    found = meetings.results(cleaned, rank.summaries(cleaned, decided), decided)
    io.write_json(found, f"{args.output}/json", "overwrite")
    meetings.markdown(found).write.mode("overwrite").partitionBy("source").text(f"{args.output}/markdown")
    return faulty(faults.unionByName(io.empty_sources(rows, cleaned)))


def run_wer(spark: SparkSession, args) -> int:
    rows, faults = io.read_transcripts(spark, args.input)
    pairs, missing = reports.with_reference(rows, io.read_references(spark, args.labels))
    plain = pairs.select(F.col("source").alias("id"), F.col("source").alias("nhom"), wer.normalised("dap_an").alias("text"), wer.normalised("du_doan").alias("du_doan"))
    seconds = [F.lit(0.0).alias(c) for c in ("do_dai", "thoi_gian")]
    scored = evaluate.scored(plain.select("id", "nhom", "text"), plain.select("id", "du_doan", *seconds))
    show(evaluate.totals(scored).orderBy("is_total", "nhom"), "nhom", "n", "sub", "del", "ins", "wer")
    return faulty(faults.unionByName(missing))


def recognised(spark: SparkSession, args) -> tuple[DataFrame, DataFrame]:
    """Labels and results in comparable words; ``filter``: stored segments are filtered anew."""
    labels = spark.read.json(args.labels).withColumn("text", wer.normalised_for_scoring("text"))
    labels = labels if "ord" in labels.columns else labels.withColumn("ord", F.monotonically_increasing_id())
    results = spark.read.parquet(args.results)
    if args.filter:
        results = results.withColumn("du_doan", segments.rescore(F.col("chi_tiet"), args.filter)[0])
    return labels, results.withColumn("du_doan", wer.normalised_for_scoring("du_doan"))


def run_report(spark: SparkSession, args) -> int:
    labels, results = recognised(spark, args)
    scored = evaluate.scored(labels, results.filter(F.col("cfg") == args.cfg))
    show(reports.report(scored).orderBy("section", "no"), "section", "line")
    return 0


def run_compare(spark: SparkSession, args) -> int:
    labels, results = recognised(spark, args)
    scored = evaluate.scored(labels, results)
    show(reports.comparison(scored).orderBy("is_total", "nhom", "wer"), "nhom", "cfg", "n", "errors", "wer")
    base = scored.filter(F.col("cfg") == args.base).select("id", "ord", "n", F.col("errors").alias("a"), F.coalesce(*[F.col(c) for c in ("nguon", "nhom") if c in labels.columns], F.col("id")).alias("cluster"))
    pairs = scored.filter(F.col("cfg") != args.base).select("id", "cfg", F.col("errors").alias("b")).join(base, "id")
    show(evaluate.bootstrap(pairs), "cfg", "diff", "low", "high", "verdict")
    return 0


def run_quality(spark: SparkSession, args) -> int:
    labels = io.read_labels(spark, args.labels)
    made = spark.read.json(args.results).select("source", F.col("tasks").alias("xs"))
    show(evaluate.precision_recall(evaluate.task_outcomes(labels, made), "tap").orderBy("tap"), "tap", "precision", "recall", "recall_undated")
    return faulty(labels.join(made, "source", "left_anti").select("source", F.lit("no result").alias("reason")))


COMMANDS = {"clean": run_clean, "meetings": run_meetings, "wer": run_wer, "report": run_report, "compare": run_compare, "quality": run_quality}


def parser() -> argparse.ArgumentParser:
    made = argparse.ArgumentParser(prog="parley", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = made.add_subparsers(dest="command", required=True)
    for name in ("clean", "meetings"):
        one = commands.add_parser(name)
        one.add_argument("input")
        one.add_argument("output")
    one = commands.add_parser("wer")
    one.add_argument("input")
    one.add_argument("labels")
    for name in ("report", "compare", "quality"):
        one = commands.add_parser(name)
        one.add_argument("labels")
        one.add_argument("results")
        one.add_argument("--filter", choices=speech.PROMPT_MODES)
        if name != "quality":
            one.add_argument("--cfg" if name == "report" else "--base", required=True)
    return made


def main(words: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(words)
    return COMMANDS[args.command](spark or SparkSession.builder.appName("parley").getOrCreate(), args)


if __name__ == "__main__":
    sys.exit(main())
