"""Transcripts as a stream: tasks of each meeting as its sentences arrive.

An extension of the batch operators.  Each micro-batch of clean sentences is
added to a store under its batch number, and the tasks of the meetings that it
touches are made anew from the store by the batch operator, so that a
meeting's latest version equals the batch result whatever the order of
arrival.  A batch that is run again overwrites its own files only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from .. import schema
from ..operators import meetings


def read_sentences(spark: SparkSession, path: str, **options) -> DataFrame:
    """Clean sentences from JSON lines as files arrive."""
    return spark.readStream.schema(schema.CLEAN).options(**options).json(path)


def tasks(sentences: DataFrame, store: str) -> DataStreamWriter:
    """A writer that keeps ``store``/sentences and ``store``/tasks up to date; start it with a checkpoint and a trigger."""

    def update(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{store}/sentences/batch={number}")
        touched = spark.read.parquet(f"{store}/sentences/batch={number}").select("source").distinct()
        known = spark.read.parquet(f"{store}/sentences").filter(F.col("batch") <= number).drop("batch").dropDuplicates(["source", "stt"])
        made = meetings.tasks(known.join(touched, "source", "left_semi"))
        made.write.mode("overwrite").parquet(f"{store}/tasks/version={number}")

    return sentences.writeStream.foreachBatch(update)


def latest(spark: SparkSession, store: str) -> DataFrame:
    """Each meeting's tasks of its latest version."""
    rows = spark.read.parquet(f"{store}/tasks")
    last = rows.groupBy("source").agg(F.max("version").alias("version"))
    return rows.join(last, ["source", "version"])
