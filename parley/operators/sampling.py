"""Samples under quotas, and long files from short clips."""

from __future__ import annotations

import math
import random

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAST_WORDS = 3


def quota(rows: DataFrame, group: str, order: list, most: int) -> DataFrame:
    """The first ``most`` rows of each group."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("__r") <= most).drop("__r")


def shuffled(ids: list, seed: int) -> list:
    """A fixed random order of a driver-side list of ids."""
    ids = list(ids)
    random.Random(seed).shuffle(ids)
    return ids


def two_quotas(rows: DataFrame, n: int, groups: int, per_source: int | None, taken: DataFrame | None = None) -> DataFrame:
    """``n`` rows of (ord, row_idx, text, nhom, nguon) by ord, under a quota by group and one by source; what the
    group quota leaves open is filled without it.  ``taken``: rows had already, which count for both quotas.

    The two quotas depend on each other row by row, so the fold is sequential.
    It runs on at most n rows of each source, as no more can be taken of one.
    """
    bound = min(n, per_source or n)
    pool = rows.filter(F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")) >= LEAST_WORDS)
    # rows beyond a pair's bound can never be reached by either pass
    pool = pool.withColumn("__r", F.row_number().over(Window.partitionBy("nhom", "nguon").orderBy("ord"))).filter(F.col("__r") <= bound + (0 if taken is None else n)).drop("__r")
    had = None if taken is None else taken.select("row_idx", "nhom", "nguon")
    marked = pool.withColumn("had", F.lit(False)).select("ord", "row_idx", "nhom", "nguon", "had")
    if had is not None:
        marked = marked.join(had.select("row_idx"), "row_idx", "left_anti").unionByName(had.select(F.lit(-1).cast("bigint").alias("ord"), "row_idx", "nhom", "nguon", F.lit(True).alias("had")))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        by_group, by_source, out = {}, {}, []

        def take(row):
            by_group[row.nhom] = by_group.get(row.nhom, 0) + 1
            by_source[row.nguon] = by_source.get(row.nguon, 0) + 1

        total = 0
        for row in pdf[pdf["had"]].itertuples():
            take(row)
            total += 1
        chosen = set()
        for most in (math.ceil(n / groups), n):
            for row in pdf[~pdf["had"]].itertuples():
                if total >= n:
                    break
                if row.row_idx in chosen or by_group.get(row.nhom, 0) >= most or (per_source and by_source.get(row.nguon, 0) >= per_source):
                    continue
                take(row)
                chosen.add(row.row_idx)
                out.append(row.row_idx)
                total += 1
        return pd.DataFrame({"row_idx": out, "pick": range(len(out))})

    picked = marked.withColumn("__all", F.lit(True)).groupBy("__all").applyInPandas(fold, "row_idx bigint, pick int")
    return rows.join(picked, "row_idx")


def fill_files(clips: list[tuple[str, float]], seconds: float, files: int, silence) -> list[list[str]]:
    """Ids of the clips of each long file: clips and silences one after the other until a file is long enough."""
    out: list[list[str]] = []
    rest = iter(clips)
    for _ in range(files):
        now, length = [], 0.0
        while length < seconds and (clip := next(rest, None)) is not None:
            length += clip[1] + (silence() if now else 0.0)
            now.append(clip[0])
        if not now:
            break
        out.append(now)
    return out
