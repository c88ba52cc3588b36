"""Readers and writers of the transcript formats, and adapters from other tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema

AUDIO_SUFFIXES = (".wav", ".mp3", ".m4a", ".flac", ".ogg", ".aac", ".wma", ".mp4", ".webm")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): each file's text without a byte-order mark."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return rows.withColumn("value", F.regexp_replace("value", "^﻿", ""))


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """(source, text): reference texts, a file each."""
    return whole_files(spark, path).select(stem(F.col("path")).alias("source"), F.col("value").alias("text"))


def _records(spark: SparkSession, path: str, required: dict[str, str]) -> DataFrame:
    """Records of JSON arrays with their place in the file and what is wrong with them; kept as VARIANT to see true types."""
    rows = whole_files(spark, path).select(stem(F.col("path")).alias("source"), F.try_parse_json("value").alias("v"))
    kind = F.schema_of_variant("v")
    rows = rows.withColumn("bad", F.when(F.col("v").isNull(), "not JSON").when(~F.startswith(kind, F.lit("ARRAY<")), "not a list").when(F.expr("try_variant_get(v, '$[0]', 'variant')").isNull(), "empty"))
    items = F.expr("case when bad is null then try_cast(v as array<variant>) end")
    rows = rows.select("source", "bad", F.posexplode_outer(items).alias("pos", "r"))
    fault = F.col("bad")
    for name, sql_type in required.items():
        got = F.expr(f"schema_of_variant(try_variant_get(r, '$.{name}', 'variant'))")
        ok = {"string": F.col("_t") == "STRING", "double": F.col("_t").rlike("^(BIGINT|DOUBLE|DECIMAL)"), "int": F.col("_t") == "BIGINT", "boolean": F.col("_t") == "BOOLEAN"}[sql_type]
        rows = rows.withColumn("_t", got)
        fault = F.coalesce(fault, F.when(F.col("_t").isNull() | ~ok, F.concat(F.lit(f"row "), F.col("pos").cast("string"), F.lit(f": {name}"))))
        rows = rows.withColumn("bad", fault).withColumn(name, F.expr(f"try_variant_get(r, '$.{name}', '{sql_type}')"))
        fault = F.col("bad")
    if {"start", "end"} <= set(required):
        rows = rows.withColumn("bad", F.coalesce("bad", F.when((F.col("start") > F.col("end")) | F.isnan("start") | F.isnan("end"), F.concat(F.lit("row "), F.col("pos").cast("string"), F.lit(": start > end")))))
    return rows.drop("_t", "r")


def read_transcripts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, faults): transcripts of the valid files, and one reason for each file that is not."""
    rows = _records(spark, path, {"speaker": "string", "start": "double", "end": "double", "text": "string"})
    faults = rows.filter("bad is not null").groupBy("source").agg(F.min_by("bad", "pos").alias("reason"))
    good = rows.join(faults, "source", "left_anti")
    return good.select("source", F.col("pos").cast("int").alias("pos"), "speaker", "start", "end", "text"), faults


def read_clean(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, faults) of clean-sentence files."""
    fields = {"stt": "int", "speaker": "string", "start": "double", "end": "double", "goc": "string", "sach": "string", "tach_tu": "string", "xa_giao": "boolean"}
    rows = _records(spark, path, fields)
    faults = rows.filter("bad is not null").groupBy("source").agg(F.min_by("bad", "pos").alias("reason"))
    return rows.join(faults, "source", "left_anti").select("source", F.col("pos").cast("int").alias("pos"), *fields), faults


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(source, label) of a file that maps file names to labels; an absent key of lich_hop stays apart from a null one."""
    rows = whole_files(spark, path).select(F.explode(F.from_json("value", f"map<string,{schema.LABELS}>")).alias("source", "label"))
    return rows


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """Records that name their audio, of a file that is a JSON array or else JSON lines."""
    text = whole_files(spark, path)
    whole = text.select(F.from_json("value", "array<map<string,string>>").alias("xs"))
    lines = text.filter(~F.startswith(F.trim("value"), F.lit("["))).select(F.transform(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != ""), lambda x: F.from_json(x, "map<string,string>")).alias("xs"))
    records = whole.filter("xs is not null").unionByName(lines).select(F.explode("xs").alias("r"))
    return records.filter(F.coalesce(F.col("r")["audio"], F.lit("")) != "")


def read_rows_without_audio(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows of numbered Parquet files without their audio column; row_idx = file number * 1e6 + row."""
    number = F.element_at(F.map_from_arrays(F.array(*[F.lit(p.rsplit("/", 1)[-1]) for p in paths]), F.array(*[F.lit(i) for i in range(len(paths))])), F.col("_metadata.file_name"))
    df = spark.read.parquet(*paths)
    return df.select(*[c for c in df.columns if c != "audio"], (number * 1_000_000 + F.col("_metadata.row_index")).alias("row_idx"))


def read_audio(spark: SparkSession, paths: list[str], wanted: DataFrame) -> DataFrame:
    """(row_idx, audio) of the wanted rows only."""
    number = F.element_at(F.map_from_arrays(F.array(*[F.lit(p.rsplit("/", 1)[-1]) for p in paths]), F.array(*[F.lit(i) for i in range(len(paths))])), F.col("_metadata.file_name"))
    rows = spark.read.parquet(*paths).select((number * 1_000_000 + F.col("_metadata.row_index")).alias("row_idx"), "audio")
    return rows.join(wanted.select("row_idx"), "row_idx", "left_semi")


def pending_audio(listing: DataFrame, done: DataFrame, forced: DataFrame | None = None) -> DataFrame:
    """(path) of audio files without an output of the same stem, and those asked for by name."""
    audio = listing.filter(F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(*AUDIO_SUFFIXES))
    todo = audio.withColumn("stem", stem(F.col("path"))).join(done.select(stem(F.col("path")).alias("stem")).distinct(), "stem", "left_anti").select("path")
    return todo if forced is None else todo.unionByName(forced.select("path")).distinct()


def colliding_stems(paths: DataFrame) -> DataFrame:
    """(stem, n) of lower-cased stems that several paths share."""
    return paths.groupBy(F.lower(stem(F.col("path"))).alias("stem")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def first_text(*columns: str) -> Column:
    """The first of the columns that holds more than white space, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(F.col(c)), F.lit("")) for c in columns])


def labels_with_audio(labels: DataFrame, listing: DataFrame) -> DataFrame:
    return labels.join(listing.select(F.col("path").alias("tep")), "tep", "left_semi")


def channel_of(path: Column) -> Column:
    """The folder of a clip, which stands for its channel."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise(stem(path))


def from_conversations(conversations: DataFrame) -> DataFrame:
    """Transcript rows: a turn every four seconds, three seconds long."""
    start = F.col("turn") * 4.0
    return conversations.select(
        F.col("conv_id").cast("string").alias("source"), F.col("turn").cast("int").alias("pos"), F.col("role").alias("speaker"), start.alias("start"), (start + 3.0).alias("end"), "text"
    )


# ---- sinks -----------------------------------------------------------------------------------


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object a line; the committer makes the write atomic.  Sources without rows are never written."""
    df.write.mode(mode).json(path)


def write_clips(clips: DataFrame, path: str) -> None:
    """Labelled clips (id, .., audio): the sound and its label apart, so that labels are read without it."""
    clips.select("id", "audio").write.mode("overwrite").parquet(f"{path}/audio")
    clips.drop("audio").write.mode("overwrite").json(f"{path}/labels")


def meeting_json(results: DataFrame) -> DataFrame:
    """(source, json) of result rows."""
    return results.select("source", F.to_json(F.struct(*results.columns), {"ignoreNullFields": "false"}).alias("json"))


def append_results(results: DataFrame, path: str) -> None:
    """Adds results by configuration; with ``missing`` a run can be taken up again."""
    results.write.mode("append").partitionBy("cfg").parquet(path)


def missing(labels: DataFrame, results: DataFrame, cfg: str) -> DataFrame:
    """Labels that a configuration has no result for."""
    return labels.join(results.filter(F.col("cfg") == cfg).select("id"), "id", "left_anti")


def empty_sources(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Sources that gave nothing: they go to an error table instead of a file."""
    return inputs.select("source").distinct().join(outputs.select("source").distinct(), "source", "left_anti").withColumn("reason", F.lit("no sentence left"))
