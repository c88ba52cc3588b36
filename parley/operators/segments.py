"""Turns, segments and timed words: folds over ordered arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import speech as sp

TURNS = "array<struct<start:double,end:double>>"


def merge_turns(turns: Column, most: float) -> Column:
    """Ordered turns merged while a group, silence included, stays within ``most`` seconds of its first start; 0 merges none."""
    turns = turns.cast(TURNS)
    if most <= 0:
        return turns
    merged = F.aggregate(
        turns,
        F.array().cast(TURNS),
        lambda acc, t: F.when(
            (F.size(acc) > 0) & (t["end"] - F.element_at(acc, -1)["start"] <= most),
            F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), t["end"].alias("end")))),
        ).otherwise(F.concat(acc, F.array(t))),
    )
    return F.when(F.size(turns) > 0, merged).otherwise(turns)


def drop_repeats(texts: Column) -> Column:
    """array<boolean>: does each ordered text stay?  One goes that equals the kept one before it, or the one before
    that with another long one between; short texts always stay."""
    plain = F.transform(texts, sp.comparable)
    long = lambda t: F.size(F.filter(F.split(t, " "), lambda w: w != "")) >= sp.REPEATED_WORDS
    state = "struct<one:string,two:string,kept:array<boolean>>"
    start = F.struct(F.lit(None).cast("string").alias("one"), F.lit(None).cast("string").alias("two"), F.array().cast("array<boolean>").alias("kept")).cast(state)

    def step(s: Column, t: Column) -> Column:
        again = F.coalesce(t == s["one"], F.lit(False)) | (F.coalesce(t == s["two"], F.lit(False)) & F.coalesce(long(s["one"]), F.lit(False)))
        goes = long(t) & again
        return F.struct(
            F.when(goes, s["one"]).otherwise(t).alias("one"), F.when(goes, s["two"]).otherwise(s["one"]).alias("two"), F.concat(s["kept"], F.array(~goes)).alias("kept")
        ).cast(state)

    return F.aggregate(plain, start, step, lambda s: s["kept"])


def words_between(words: Column, start: float | Column, end: float | Column) -> Column:
    """Words whose middle lies in [start, end)."""
    middle = lambda w: (w["start"] + w["end"]) / 2
    return F.filter(words, lambda w: (middle(w) >= start) & (middle(w) < end))


def words_before(words: Column, end: float | Column) -> tuple[Column, Column]:
    """Words that start before ``end``, and the text of the others."""
    return F.filter(words, lambda w: w["start"] < end), F.trim(F.array_join(F.transform(F.filter(words, lambda w: w["start"] >= end), lambda w: w["word"]), ""))


def until_past(segments: Column, end: float | Column, speech_end: float | Column | None = None) -> Column:
    """Segments up to and with the first that ends at or past ``end`` (or where speech ends)."""
    past = lambda s: (s["end"] >= end) | (F.lit(False) if speech_end is None else s["end"] >= speech_end)
    first = F.array_position(F.transform(segments, past), True)
    return F.when(first > 0, F.slice(segments, F.lit(1), first.cast("int"))).otherwise(segments)


def shift(words: Column, seconds: float | Column) -> Column:
    return F.transform(words, lambda w: w.withField("start", w["start"] + seconds).withField("end", w["end"] + seconds))


def sentence(words: Column) -> Column:
    """struct(start, end, text) of a run of words; times rounded to hundredths, the end never before the start."""
    first, last = F.element_at(words, 1), F.element_at(words, -1)
    text = F.trim(F.regexp_replace(F.array_join(F.transform(words, lambda w: w["word"]), ""), r"\s+", " "))
    return F.struct(F.bround(first["start"], 2).alias("start"), F.bround(F.greatest(last["end"], first["start"]), 2).alias("end"), text.alias("text"))


def token_budget(seconds: Column) -> Column:
    return F.least(seconds * sp.TOKENS_A_SECOND + sp.TOKENS_MORE, F.lit(sp.TOKENS_MOST)).cast("int")


def bad_turns(turns: DataFrame, segments: DataFrame, prompt_mode: str = "day_du") -> DataFrame:
    """Turns (id, turn, start, end) of three seconds or more with under one true word a second; segments: (id, turn, s)."""
    n = F.size(F.filter(F.split(F.trim(F.col("s.text")), r"\s+"), lambda w: w != ""))
    said = segments.withColumn("n", F.when(sp.reject_reason(F.col("s"), prompt_mode).isNull(), n).otherwise(0)).groupBy("id", "turn").agg(F.sum("n").alias("n"))
    seconds = F.col("end") - F.col("start")
    rows = turns.join(said, ["id", "turn"], "left")
    return rows.filter((seconds >= sp.BAD_TURN_SECONDS) & (F.coalesce("n", F.lit(0)) < seconds * sp.BAD_TURN_WORDS)).drop("n")


def rescore(details: Column, prompt_mode: str | None) -> tuple[Column, Column]:
    """Stored segments filtered anew: (kept text, rejected texts).  None keeps all of them."""
    if prompt_mode is None:
        return F.trim(F.array_join(F.transform(details, lambda s: F.trim(s["text"])), " ")), F.array().cast("array<string>")
    marked = F.transform(details, lambda s: F.struct(s["text"].alias("text"), sp.reject_reason(s, prompt_mode, s["compression_ratio"]).isNull().alias("ok")))
    kept = F.array_join(F.transform(F.filter(marked, lambda m: m["ok"]), lambda m: sp.without_garbage(m["text"])), " ")
    return kept, F.transform(F.filter(marked, lambda m: ~m["ok"]), lambda m: F.trim(m["text"]))


def contained(turns: DataFrame, points: DataFrame, key: str, margin: float = 0.5) -> DataFrame:
    """Points (key, at) within [start, end + margin) of turns (key, start, end): a range join, by time buckets of the longest turn's length."""
    width = F.greatest(F.max(F.col("end") - F.col("start") + margin).over(Window.partitionBy(key)), F.lit(1e-3))
    sized = turns.withColumn("__w", width)
    widths = sized.groupBy(key).agg(F.max("__w").alias("__w"))
    buckets = F.sequence(F.floor(F.col("start") / F.col("__w")), F.floor((F.col("end") + margin) / F.col("__w")))
    left = sized.withColumn("__b", F.explode(buckets)).drop("__w")
    right = points.join(widths, key).withColumn("__b", F.floor(F.col("at") / F.col("__w"))).drop("__w")
    return left.join(right, [key, "__b"]).filter((F.col("at") >= F.col("start")) & (F.col("at") < F.col("end") + margin)).drop("__b")
