"""Evaluation: word error reports, comparisons of configurations, and label matching."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import wer

# ---- fixed values ---------------------------------------------------------------------------
RIGHT, WRONG_DATE, OLD_DATE, MISSING, FORBIDDEN, REPEATED, OPTIONAL, FALSE = "ĐÚNG", "SAI_HẠN", "HẠN_BỊ_THAY", "THIẾU", "CẤM", "TRÙNG", "TÙY_CHỌN", "GIẢ"
DEADLINE_PREFIXES = ("trước ", "ngày ")
BOOTSTRAPS, BOOTSTRAP_SEED, LOW, HIGH = 2000, 0, 2.5, 97.5
TOP_PAIRS, TOP_WORDS, TOP_SEGMENTS, SPREAD = 30, 25, 15, 0.20
SLOW_FACTOR, SLOW_LEAST = 3, 5
# ---- end of fixed values --------------------------------------------------------------------

#: Numbers that are drawn at a time; parts that a group's values are dealt to for order statistics.
DRAWN, BUCKETS = 1 << 22, 64


def scored(labels: DataFrame, results: DataFrame) -> DataFrame:
    """Labels joined to their results (id), with reference and hypothesis words and error counts by kind.

    Words and operations are only made where they are asked for; counts don't need them.
    """
    rows = labels.join(results, "id").withColumn("__c", wer.counts("text", "du_doan")).withColumn("ops", wer.alignment("text", "du_doan"))
    rows = rows.withColumn("n", wer.n_words(F.col("text"))).select("*", "__c.*").drop("__c")
    return rows.withColumn("errors", F.col("sub") + F.col("del") + F.col("ins"))


def rate(errors: Column, n: Column) -> Column:
    """Pooled error rate, 0 where there are no words."""
    return F.coalesce(errors / F.nullif(n, F.lit(0)), F.lit(0.0))


def totals(rows: DataFrame, group: str = "nhom") -> DataFrame:
    """Totals over all and by group: words, errors, segments, seconds, pooled rate and real-time factor."""
    sums = [F.sum(c).alias(c) for c in ("n", "sub", "del", "ins", "errors", "do_dai", "thoi_gian")]
    df = rows.groupingSets([[], [F.col(group)]], F.col(group)).agg(F.grouping(group).alias("is_total"), F.count(F.lit(1)).alias("segments"), *sums)
    return df.withColumn("wer", rate(F.col("errors"), F.col("n"))).withColumn("rtf", F.col("thoi_gian") / F.nullif(F.col("do_dai"), F.lit(0)))


# Operations are exploded with rows that have none, and filtered after: of a plain explode Spark makes a filter on their number,
# for which every text would be aligned twice.


def _first_seen(events: DataFrame, *keys: str) -> DataFrame:
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), F.min(F.struct("ord", "k")).alias("seen"))


def confusions(rows: DataFrame, order: str = "ord", k: int = TOP_PAIRS) -> DataFrame:
    """The most frequent substitutions (ref, hyp, count); of equal counts the one met first."""
    events = rows.select(F.col(order).alias("ord"), F.posexplode_outer("ops").alias("k", "o")).filter("o.op = 'substitute'").select("ord", "k", "o.ref", "o.hyp")
    return _first_seen(events, "ref", "hyp").orderBy(F.desc("count"), "seen").limit(k).select("ref", "hyp", "count")


def frequent(rows: DataFrame, op: str, order: str = "ord", k: int = TOP_WORDS) -> DataFrame:
    """The words most often deleted or inserted."""
    side = "ref" if op == "delete" else "hyp"
    events = rows.select(F.col(order).alias("ord"), F.posexplode_outer("ops").alias("k", "o")).filter(F.col("o.op") == op).select("ord", "k", F.col(f"o.{side}").alias("word"))
    return _first_seen(events, "word").orderBy(F.desc("count"), "seen").limit(k).select("word", "count")


def worst(rows: DataFrame, order: str = "ord", k: int = TOP_SEGMENTS) -> DataFrame:
    return rows.withColumn("wer", rate(F.col("errors"), F.col("n"))).orderBy(F.desc("wer"), order).limit(k)


def by_position(rows: DataFrame, parts: Column, edge: int = wer.EDGE_WORDS) -> DataFrame:
    """Words, errors and deletions at the edges of parts and inside; ``parts``: array of word counts of a row's parts."""
    spans = F.transform(parts, lambda n, i: F.struct(F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0), lambda a, x: a + x).alias("a"), n.alias("n")))
    events = rows.withColumn("spans", spans).select("spans", F.explode_outer("ops").alias("o")).filter("o.op <> 'insert'")
    own = F.filter("spans", lambda s: (F.col("o.pos") >= s["a"]) & (F.col("o.pos") < s["a"] + s["n"]))[0]
    at_edge = (F.col("o.pos") - own["a"] < edge) | (own["a"] + own["n"] - F.col("o.pos") <= edge)
    return events.groupBy(F.when(at_edge, "edge").otherwise("middle").alias("place")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("o.op") != "equal").alias("errors"), F.count_if(F.col("o.op") == "delete").alias("deleted")
    )


def by_part(rows: DataFrame, parts: Column) -> DataFrame:
    """(id, part, n, errors): errors of long texts put down to the parts they were joined from; an insertion counts for the part before it."""
    ends = F.transform(parts, lambda n, i: F.aggregate(F.slice(parts, F.lit(1), i + 1), F.lit(0), lambda a, x: a + x))
    place = F.when(F.col("o.op") == "insert", F.greatest(F.col("o.pos") - 1, F.lit(0))).otherwise(F.col("o.pos"))
    events = rows.withColumn("ends", ends).select("id", "ends", F.explode_outer("ops").alias("o")).filter("o is not null")
    part = F.size(F.filter("ends", lambda e: e <= place))
    part = F.least(part, F.size("ends") - 1)
    return events.groupBy("id", part.alias("part")).agg(F.count_if(F.col("o.op") != "insert").alias("n"), F.count_if(F.col("o.op") != "equal").alias("errors"))


def common_ids(results: DataFrame) -> DataFrame:
    """Ids that every configuration has."""
    n = results.select("cfg").distinct().agg(F.count(F.lit(1)).alias("configs"))
    return results.groupBy("id").agg(F.countDistinct("cfg").alias("c")).join(F.broadcast(n), F.col("c") == F.col("configs")).select("id")


def against_base(rows: DataFrame, base: str) -> DataFrame:
    """(cfg, better, worse, equal) of each configuration's errors against the base's, on common ids; rows: (cfg, id, errors)."""
    b = rows.filter(F.col("cfg") == base).select("id", F.col("errors").alias("b"))
    pairs = rows.filter(F.col("cfg") != base).join(b, "id")
    return pairs.groupBy("cfg").agg(F.count_if(F.col("errors") < F.col("b")).alias("better"), F.count_if(F.col("errors") > F.col("b")).alias("worse"), F.count_if(F.col("errors") == F.col("b")).alias("equal"))


def spread(rows: DataFrame, least: float = SPREAD) -> DataFrame:
    """Ids whose rates differ by ``least`` or more between configurations; rows: (cfg, id, errors, n)."""
    df = rows.withColumn("wer", rate(F.col("errors"), F.col("n"))).groupBy("id").agg((F.max("wer") - F.min("wer")).alias("spread"))
    return df.filter(F.col("spread") >= least).orderBy(F.desc("spread"), "id")


def draws(clusters: np.ndarray, times: int = BOOTSTRAPS, seed: int = BOOTSTRAP_SEED) -> np.ndarray:
    """Column sums of rows drawn with replacement, as many as there are, ``times`` over; a bounded block of draws at a time."""
    rng, size = np.random.default_rng(seed), len(clusters)
    step = max(1, DRAWN // size)
    return np.concatenate([clusters[rng.integers(0, size, (min(step, times - k), size))].sum(axis=1) for k in range(0, times, step)])


def interval(n, a, b, clusters=None, **options) -> tuple[float, float, float]:
    """Difference of pooled rates b - a and its 95 % interval, by drawing clusters with replacement."""
    rows = pd.DataFrame({"n": np.asarray(n, float), "a": np.asarray(a, float), "b": np.asarray(b, float)})
    sums = (rows if clusters is None else rows.groupby(list(clusters), sort=False, dropna=False).sum()).to_numpy()
    drawn, (words, before, after) = draws(sums, **options), sums.sum(axis=0)
    low, high = np.percentile((drawn[:, 2] - drawn[:, 1]) / np.maximum(drawn[:, 0], 1), (LOW, HIGH))
    return float((after - before) / words), float(low), float(high)


def bootstrap(pairs: DataFrame, **options) -> DataFrame:
    """(cfg, diff, low, high, verdict) from rows (cfg, ord, n, a, b, cluster).

    Rows are added up by cluster before they meet: a configuration brings one row for each cluster, in the order in
    which the clusters first appear, and its draws are made in blocks of bounded size.
    """
    sums = [F.sum(c).cast("double").alias(c) for c in ("n", "a", "b")]
    clusters = pairs.groupBy("cfg", "cluster").agg(F.min("ord").alias("ord"), *sums)

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        diff, low, high = interval(pdf["n"], pdf["a"], pdf["b"], **options)
        return pd.DataFrame([(pdf["cfg"].iloc[0], diff, low, high, "worse" if low > 0 else "better" if high < 0 else "unsure")], columns=["cfg", "diff", "low", "high", "verdict"])

    return clusters.groupBy("cfg").applyInPandas(of, "cfg string, diff double, low double, high double, verdict string")


def order_statistics(rows: DataFrame, group: str, value: str, **places: Column) -> DataFrame:
    """(group, one column for each place): the value at a place from 0 in the group's sorted values.

    ``places``: expressions of ``n``, the group's number of rows.  Values are
    counted first and the counts run up within buckets, so no group's rows or values are gathered.
    """
    rows = rows.filter(F.col(value).isNotNull())
    counts = rows.groupBy(group, value).agg(F.count(F.lit(1)).alias("c"))
    # approximate quantiles deal a group's values out, whatever its size; counts before a bucket make the places exact
    breaks = rows.groupBy(F.col(group).alias("__g")).agg(F.percentile_approx(value, [k / BUCKETS for k in range(1, BUCKETS)], 1000).alias("__b"))
    dealt = counts.join(breaks, F.col(group).eqNullSafe(F.col("__g"))).withColumn("__k", F.size(F.filter("__b", lambda x: x < F.col(value)))).drop("__b", "__g")
    sums = dealt.groupBy(F.col(group).alias("__g"), F.col("__k").alias("__j")).agg(F.sum("c").alias("s"))
    whole = Window.partitionBy("__g")
    sums = sums.withColumn("before", F.sum("s").over(whole.orderBy("__j")) - F.col("s")).withColumn("n", F.sum("s").over(whole))
    run = dealt.join(sums, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__k") == F.col("__j")))
    run = run.withColumn("upto", F.col("before") + F.sum("c").over(Window.partitionBy(group, "__k").orderBy(value)))
    return run.groupBy(group).agg(*[F.min(F.when(F.col("upto") > place, F.col(value))).alias(name) for name, place in places.items()])


def nearest_rank(share: float) -> Column:
    """Place min(n - 1, int(share * n))."""
    return F.least(F.col("n") - 1, F.floor(F.col("n") * share))


def upper_median() -> Column:
    """Place n div 2."""
    return F.floor(F.col("n") / 2)


def slow(rows: DataFrame) -> DataFrame:
    """Rows whose time by length is over three times the upper median, where there are five or more."""
    rated = rows.withColumn("rtf", F.col("thoi_gian") / F.col("do_dai")).withColumn("__all", F.lit(1))
    bar = order_statistics(rated, "__all", "rtf", bar=upper_median())
    total = rated.groupBy("__all").agg(F.count(F.lit(1)).alias("total"))
    # one row for the whole table
    one = F.broadcast(bar.join(total, "__all"))
    return rated.join(one, "__all").filter((F.col("total") >= SLOW_LEAST) & (F.col("rtf") > F.col("bar") * SLOW_FACTOR)).drop("bar", "total", "__all")


def correction_effect(rows: DataFrame) -> DataFrame:
    """What a rewrite does to the errors: rows (n, before, after)."""
    return rows.agg(
        F.sum("n").alias("n"), F.sum("before").alias("before"), F.sum("after").alias("after"),
        F.count_if(F.col("after") < F.col("before")).alias("improved"), F.count_if(F.col("after") > F.col("before")).alias("worsened"),
        F.count_if(F.col("after") == F.col("before")).alias("neutral"),
    )


def what_if(lengths: DataFrame, settings: list[tuple[float, float]], most: int = 380) -> DataFrame:
    """(a, b, over, ratio): rows (seconds, tokens) over a limit of a * seconds + b tokens, and the limits' sum by that of the tokens."""
    table = lengths.sparkSession.createDataFrame(settings, "a double, b double")
    limit = F.least(F.col("a") * F.col("seconds") + F.col("b"), F.lit(most)).cast("int")
    rows = lengths.crossJoin(F.broadcast(table)).withColumn("limit", limit)
    return rows.groupBy("a", "b").agg(F.count_if(F.col("tokens") > F.col("limit")).alias("over"), (F.sum("limit") / F.sum("tokens")).alias("ratio"))


# ---- labels ----------------------------------------------------------------------------------


def plain(value) -> str:
    return re.sub(r"\s+", " ", "" if value is None else str(value)).strip().lower()


def plain_deadline(value) -> str | None:
    """A deadline without the words that lead it in, each of them once and in their order."""
    return re.sub("^" + "".join(f"(?:{p})?" for p in DEADLINE_PREFIXES), "", plain(value)) or None


def missing_words(text, words) -> list[str]:
    """Those of the words that the text doesn't hold."""
    base = plain(text)
    return [w for w in (() if words is None else words) if plain(w) not in base]


def greedy(pairs) -> dict:
    """One-to-one choice from ranked pairs (rank, left, right): the best pair whose ends are both free, and so on; left to (right, rank)."""
    chosen, taken = {}, set()
    for rank, left, right in sorted(pairs):
        if left not in chosen and right not in taken:
            chosen[left] = right, rank
            taken.add(right)
    return chosen


@dataclass(frozen=True)
class Label:
    """A labelled task in plain words."""

    owner: str | None
    words: tuple[str, ...]
    deadline: str | None = None
    replaced: str | None = None

    @classmethod
    def of(cls, row: dict) -> "Label":
        words = row.get("tu_khoa")
        return cls(row.get("chu"), () if words is None else tuple(words), plain_deadline(row.get("han")), plain_deadline(row.get("han_bi_thay")))

    def fits(self, task: dict) -> bool:
        return plain(self.owner) == plain(task["owner"]) and not missing_words(task["task"], self.words)

    def forbids(self, task: dict) -> bool:
        """As ``fits``, but a label without owner forbids the task to all, and one without anything nothing."""
        return bool(self.owner is not None or self.words) and (Label(task["owner"], self.words) if self.owner is None else self).fits(task)

    def kind(self, task: dict) -> str:
        date = plain_deadline(task["deadline"])
        return RIGHT if date == self.deadline else OLD_DATE if date is not None and date == self.replaced else WRONG_DATE


def match_tasks(required: list[dict], optional: list[dict], forbidden: list[dict], tasks: list[dict]) -> list[tuple[str, int | None, int | None]]:
    """(kind, task, label) of each produced task and each missing label.

    Required labels and the tasks that fit them are ranked pairs, those of equal dates first; a greedy one-to-one choice
    among them decides.  Of the tasks left over, those that a label asked for are repeated, those of an optional label
    are optional once, and the rest are false.
    """
    needed, spare, barred = ([Label.of(x) for x in xs] for xs in (required, optional, forbidden))
    free = [i for i, t in enumerate(tasks) if not any(x.forbids(t) for x in barred)]
    fitting = [(label.kind(tasks[i]), m, i) for m, label in enumerate(needed) for i in free if label.fits(tasks[i])]
    chosen = greedy((kind != RIGHT, m, i) for kind, m, i in fitting)
    kinds = {(m, i): kind for kind, m, i in fitting}
    asked = {i for _, _, i in fitting}
    first_of = {i: next((k for k, x in enumerate(spare) if x.fits(tasks[i])), None) for i in free if i not in asked}
    # of the tasks of one optional label the first is optional
    leads = {k: i for i, k in reversed(first_of.items())}
    owner = {i: m for m, (i, _) in chosen.items()}

    def outcome(i: int) -> tuple[str, int, int | None]:
        if i in owner:
            return kinds[owner[i], i], i, owner[i]
        if i not in first_of:
            return REPEATED if i in asked else FORBIDDEN, i, None
        k = first_of[i]
        return FALSE if k is None else OPTIONAL if leads[k] == i else REPEATED, i, k

    return [*((MISSING, None, m) for m in range(len(needed)) if m not in chosen), *map(outcome, range(len(tasks)))]


def match_decisions(required: list[list[str]], optional: list[list[str]], texts: list[str]) -> dict:
    """Counts of a greedy one-to-one match of decisions, required labels first: matched, required, missing, extra."""
    pairs = lambda labels, of: ((m, i) for m, words in enumerate(labels) for i in of if not missing_words(texts[i], words))
    needed = greedy((0, m, i) for m, i in pairs(required, range(len(texts))))
    left = set(range(len(texts))) - {i for i, _ in needed.values()}
    # here texts choose their labels
    spare = greedy((0, i, k) for k, i in pairs(optional, left))
    return {"matched": len(needed), "required": len(required), "missing": len(required) - len(needed), "extra": len(left) - len(spare)}


def meeting_passes(label: Column, time: Column, place: Column) -> Column:
    """A key that is absent is not checked, one that is null must be absent; time by containment, place by equality."""
    norm = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))
    label = F.coalesce(label, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    want_t, want_p = F.try_element_at(label, F.lit("thoi_gian_chua")), F.try_element_at(label, F.lit("noi_bang"))
    time_ok = F.when(want_t.isNull(), F.coalesce(time, F.lit("")) == "").otherwise(F.contains(norm(time), norm(want_t)))
    place_ok = F.when(want_p.isNull(), F.coalesce(place, F.lit("")) == "").otherwise(norm(place) == norm(want_p))
    return (~F.map_contains_key(label, F.lit("thoi_gian_chua")) | time_ok) & (~F.map_contains_key(label, F.lit("noi_bang")) | place_ok)


def task_outcomes(labels: DataFrame, tasks: DataFrame) -> DataFrame:
    """(source, tap, kind, task, deadline): outcome of each task and missing label; labels: (source, label), tasks: (source, xs)."""
    joined = labels.join(tasks, "source")

    @F.pandas_udf("array<struct<kind:string,task:int,label:int>>")
    def of(label: pd.DataFrame, xs: pd.Series) -> pd.Series:
        lists = lambda x: [] if x is None else [dict(i) for i in x]
        return pd.Series(
            [
                [{"kind": k, "task": t, "label": m} for k, t, m in match_tasks(lists(r.viec_bat_buoc), lists(r.viec_tuy_chon), lists(r.viec_cam), lists(x))]
                for r, x in zip(label.itertuples(), xs, strict=True)
            ]
        )

    picked = F.struct(F.col("label.viec_bat_buoc"), F.col("label.viec_tuy_chon"), F.col("label.viec_cam"))
    return joined.select("source", F.col("label.tap").alias("tap"), F.explode(of(picked, F.col("xs"))).alias("o")).select("source", "tap", "o.*")


def precision_recall(outcomes: DataFrame, *groups: str) -> DataFrame:
    """Precision (optional tasks out of its base), recall, and recall by owner and keywords alone, by group."""
    n = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    made, needed = n(RIGHT, WRONG_DATE, OLD_DATE, FORBIDDEN, REPEATED, FALSE), n(RIGHT, WRONG_DATE, OLD_DATE, MISSING)
    share = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    return outcomes.groupBy(*groups).agg(
        share(n(RIGHT), made).alias("precision"), share(n(RIGHT), needed).alias("recall"), share(n(RIGHT, WRONG_DATE, OLD_DATE), needed).alias("recall_undated")
    )
