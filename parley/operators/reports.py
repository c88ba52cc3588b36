"""Reports of an evaluation as tables, and the joins and choices that they need.

A report is a table of lines (section, no, line), so that a caller can write it
as text or query it; every section is an aggregate or a top list of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import evaluate

# ---- fixed values ---------------------------------------------------------------------------
TOP_FILTERED, FEW_WORDS = 15, 1000
LONGEST_TURN = 25.0
SILENT, UNSURE, COMPRESSED, LOW_LOGPROB = 0.6, -0.7, 2.4, -1.0
FLAGS = ("no speech", "loop", "retried", "unsure")
# ---- end of fixed values --------------------------------------------------------------------


# ---- joins -----------------------------------------------------------------------------------


def against_parts(long: DataFrame, short: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Long texts against the clips that they were joined from: (pairs, incomplete).

    ``long``: (id, parts, n, errors), ``short``: (id, n, errors).  A long text counts only where each of its parts has a
    result: its row then has n_parts, n_short and errors_short; the others' ids are returned apart.
    """
    wanted = long.select(F.col("id").alias("long_id"), F.size("parts").alias("n_parts"), F.explode("parts").alias("id"))
    found = wanted.join(short.select("id", F.col("n").alias("ns"), F.col("errors").alias("es")), "id")
    sums = found.groupBy("long_id", "n_parts").agg(F.count(F.lit(1)).alias("c"), F.sum("ns").alias("n_short"), F.sum("es").alias("errors_short"))
    whole = sums.filter("c = n_parts").select(F.col("long_id").alias("id"), "n_parts", "n_short", "errors_short")
    pairs = long.select("id", "n", "errors").join(whole, "id")
    return pairs, long.filter(F.size("parts") > 0).select("id").join(whole.select("id"), "id", "left_anti")


def with_reference(transcripts: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Transcripts (source, pos, text) joined by name to reference texts (source, text): (pairs, faults).

    A transcript without reference text, or the other way round, or with a blank one, is a fault and not an error.
    """
    said = transcripts.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("du_doan"))
    both = said.join(references.select("source", F.col("text").alias("dap_an")), "source", "full")
    blank = F.trim(F.coalesce("dap_an", F.lit(""))) == ""
    fault = F.when(F.col("dap_an").isNull(), "no reference").when(F.col("du_doan").isNull(), "no transcript").when(blank, "blank reference")
    judged = both.withColumn("reason", fault)
    return judged.filter("reason is null").drop("reason"), judged.filter("reason is not null").select("source", "reason")


def source_sentences(tasks: DataFrame, sentences: DataFrame) -> DataFrame:
    """Tasks with the first sentence of their meeting that starts when they do; tasks without one stay, with null."""
    first = sentences.groupBy("source", "start").agg(F.min_by("sach", "pos").alias("sentence"), F.min("pos").alias("pos"))
    return tasks.join(first, ["source", "start"], "left")


# ---- choices ---------------------------------------------------------------------------------


def retry_window(before: Column, start: Column, end: Column, after: Column, most: float = LONGEST_TURN) -> Column:
    """struct(start, end) in which a failed turn is heard again: with both neighbours, the next, the one before, or neither,
    whichever comes first that is no longer than ``most``; null neighbours are none."""
    lo, hi = F.coalesce(before, start), F.coalesce(after, end)
    options = [F.struct(a.alias("start"), b.alias("end")) for a, b in ((lo, hi), (start, hi), (lo, end))]
    fits = [F.when(o["end"] - o["start"] <= most, o) for o in options]
    return F.coalesce(*fits, F.struct(start.alias("start"), end.alias("end")))


def best_hearing(hearings: DataFrame, *keys: str) -> DataFrame:
    """(keys, no): of hearings (keys, no, words, good) in order the first after number 0 that is good, else the one with
    most words, of equal ones the first."""
    tried = F.min(F.when(F.col("good") & (F.col("no") > 0), F.col("no")))
    return hearings.groupBy(*keys).agg(F.coalesce(tried, F.max_by("no", F.struct("words", -F.col("no")))).alias("no"))


def flags(segment: Column) -> Column:
    """Signs of trouble of a segment: text where the model hears no speech, loops, retries, low confidence."""
    tests = (
        (segment["no_speech_prob"] > SILENT) & (segment["avg_logprob"] < UNSURE), segment["compression_ratio"] > COMPRESSED,
        F.coalesce(segment["temperature"], F.lit(0.0)) > 0, segment["avg_logprob"] < LOW_LOGPROB,
    )
    return F.array_compact(F.array(*[F.when(t, F.lit(name)) for t, name in zip(tests, FLAGS, strict=True)]))


def shared_deadlines(tasks: DataFrame) -> DataFrame:
    """(source, deadline, tasks, owners) of deadlines that several tasks of a meeting have."""
    plain = F.trim(F.regexp_replace(F.lower("deadline"), r"\s+", " "))
    rows = tasks.withColumn("deadline", plain).filter("deadline <> ''")
    return rows.groupBy("source", "deadline").agg(F.count(F.lit(1)).alias("tasks"), F.count_distinct(F.lower("owner")).alias("owners")).filter("tasks > 1")


def group_sizes(rows: DataFrame, group: str) -> DataFrame:
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"))


def whole_word(text: Column, phrase: Column) -> Column:
    """Does the phrase stand in the text as whole words, ignoring case?"""
    return (F.trim(phrase) != "") & F.regexp_like(text, F.concat(F.lit(r"(?iU)(?<!\w)\Q"), F.trim(phrase), F.lit(r"\E(?!\w)")))


def config_name(model: Column, defaults: dict[str, object], **settings: Column) -> Column:
    """A model's short name and every setting that is not at its default, in the settings' order."""
    short = F.lower(F.regexp_extract(F.regexp_replace(model, r"[\\/]+$", ""), r"([^\\/]*)$", 1))
    base = F.when(model.rlike(r"[\\/]"), short).otherwise(model)
    parts = [F.when(value != F.lit(defaults[name]), F.concat(F.lit(f"_{name}"), value.cast("string"))) for name, value in settings.items()]
    return F.concat_ws("", base, *parts)


# ---- top lists and lines ---------------------------------------------------------------------


def by_rate(totals: DataFrame) -> DataFrame:
    """Groups, the worst first; the total's row is left out."""
    return totals.filter("is_total = 0").orderBy(F.desc("wer"), "nhom")


def filtered_most(rows: DataFrame, order: str = "ord", k: int = TOP_FILTERED) -> DataFrame:
    """Of the rows that a filter has cut (``bi_loai`` not empty) those with the largest share of deleted words."""
    cut = rows.filter((F.size("bi_loai") > 0) & (F.col("n") > 0))
    return cut.withColumn("missing", F.col("del") / F.col("n")).orderBy(F.desc("missing"), order).limit(k)


def _lines(rows: DataFrame, section: str, no: Column, line: Column) -> DataFrame:
    return rows.select(F.lit(section).alias("section"), no.cast("int").alias("no"), line.alias("line"))


def report(scored: DataFrame, order: str = "ord") -> DataFrame:
    """(section, no, line): totals, groups, confusions, words deleted and inserted, worst and slow rows of one configuration."""
    totals = evaluate.totals(scored)
    figures = F.format_string("%s: %.1f %% of %d words (%d wrong, %d missing, %d more), %d segments", F.coalesce("nhom", F.lit("all")), F.col("wer") * 100, *map(F.col, ("n", "sub", "del", "ins", "segments")))
    place = lambda *by: F.row_number().over(Window.orderBy(*by)) - 1  # noqa: E731  of a few rows each
    parts = [
        _lines(totals.filter("is_total = 1"), "total", F.lit(0), figures),
        _lines(by_rate(totals), "groups", place(F.desc("wer"), "nhom"), figures),
        _lines(totals.filter(f"is_total = 1 and n < {FEW_WORDS}"), "note", F.lit(0), F.format_string("only %d words: the rate still varies", "n")),
    ]
    pairs = evaluate.confusions(scored, order)
    parts.append(_lines(pairs, "confusions", place(F.desc("count"), "ref", "hyp"), F.format_string("%d times %s -> %s", "count", "ref", "hyp")))
    for op, section in (("delete", "deleted"), ("insert", "inserted")):
        words = evaluate.frequent(scored, op, order)
        parts.append(_lines(words, section, place(F.desc("count"), "word"), F.format_string("%s (%d)", "word", "count")))
    bad = evaluate.worst(scored, order)
    parts.append(_lines(bad, "worst", place(F.desc("wer"), order), F.format_string("%s: %.0f %%", "id", F.col("wer") * 100)))
    late = evaluate.slow(scored)
    parts.append(_lines(late.limit(evaluate.TOP_SEGMENTS), "slow", place(F.desc("rtf"), order), F.format_string("%s: %.1f x", "id", "rtf")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def comparison(scored: DataFrame) -> DataFrame:
    """(nhom, is_total, cfg, n, errors, wer) of several configurations on the ids that all of them have; rows: (cfg, id, nhom, n, errors)."""
    common = scored.join(evaluate.common_ids(scored.select("cfg", "id")), "id", "left_semi")
    sums = common.groupingSets([[F.col("cfg")], [F.col("cfg"), F.col("nhom")]], F.col("cfg"), F.col("nhom")).agg(F.grouping("nhom").alias("is_total"), F.sum("n").alias("n"), F.sum("errors").alias("errors"))
    return sums.withColumn("wer", evaluate.rate(F.col("errors"), F.col("n")))


# ---- long files and data sets ----------------------------------------------------------------


def long_files(clips: DataFrame, seconds: float, group: str = "nguon") -> DataFrame:
    """(group, file, no, id): clips (group, ord, id, do_dai, silence) in order, one file after the other, each until it is
    ``seconds`` long, with the silence given before every clip but the first of a file.

    Where a file ends depends on the one before it, so this is a fold over a group; a group is one speaker or source.
    """

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        file, length, out = 0, 0.0, []
        for row in pdf.itertuples():
            length += row.do_dai + (row.silence if length else 0.0)
            out.append(file)
            if length >= seconds:
                file, length = file + 1, 0.0
        files = pd.Series(out, index=pdf.index, dtype="int32")
        return pd.DataFrame({group: pdf[group], "file": files, "no": files.groupby(files).cumcount().astype("int32"), "id": pdf["id"]})

    kinds = dict(clips.dtypes)
    return clips.select(group, "ord", "id", "do_dai", "silence").groupBy(group).applyInPandas(fill, f"{group} {kinds[group]}, file int, no int, id {kinds['id']}")


@dataclass(frozen=True)
class DataSet:
    """A set of labelled clips: which expressions give a row's text, group and source, and which rows count."""

    name: str
    text: str
    group: str
    source: str
    where: str = "true"

    def rows(self, df: DataFrame) -> DataFrame:
        """(bo, text, nhom, nguon) and the columns of ``df``."""
        made = df.filter(F.expr(self.where)).select(F.lit(self.name).alias("bo"), F.expr(self.text).alias("text"), F.expr(self.group).alias("nhom"), F.expr(self.source).alias("nguon"), *[c for c in df.columns if c not in ("bo", "text", "nhom", "nguon")])
        return made.filter(F.trim(F.coalesce("text", F.lit(""))) != "")


def read_or(spark: SparkSession, path: str, schema: str, reader: str = "json") -> DataFrame:
    """The table at ``path``, or an empty one of that schema where there is none."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)
    return getattr(spark.read.schema(schema), reader)(path) if there else spark.createDataFrame([], schema)
