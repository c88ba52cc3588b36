"""Transcript rows to clean sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.lexicon_clean import VIETNAMESE, CleaningLexicon


def renumber(df: DataFrame, key: str = "source", order: str = "pos", out: str = "stt") -> DataFrame:
    """Contiguous numbers from 0 in each group."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1)


def clean_sentences(transcript: DataFrame, lexicon: CleaningLexicon = VIETNAMESE, segment=None) -> DataFrame:
    """(source, pos, stt, speaker, start, end, goc, sach, tach_tu, xa_giao), sentences without a word dropped.

    ``segment``: Column function for word segmentation; by default text stays
    as it is, but for the compounds of the lexicon.
    """
    segment = segment or (lambda c: c)
    rows = transcript.select("source", "pos", "speaker", "start", "end", F.col("text").alias("goc"), tx.clean(F.col("text"), lexicon).alias("sach"))
    # numbered before blank ones go: Spark doesn't move a filter below a window, so a text is cleaned once and not once more for the filter
    so_far = Window.partitionBy("source").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    said = ~tx.is_blank(F.col("sach"))
    rows = rows.withColumn("stt", F.count(F.when(said, 1)).over(so_far).cast("int") - 1).filter(said)
    tokens: Column = tx.join_compounds(segment(F.col("sach")), lexicon)
    return rows.select("source", "pos", "stt", "speaker", "start", "end", "goc", "sach", tokens.alias("tach_tu"), tx.is_small_talk(F.col("sach"), lexicon).alias("xa_giao"))


def sources_left_empty(transcript: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Sources of which cleaning leaves nothing; they are reported, not written."""
    return transcript.select("source").distinct().join(cleaned.select("source").distinct(), "source", "left_anti")
