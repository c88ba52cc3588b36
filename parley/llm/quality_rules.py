"""Quality rules: simple text counts and robust multivariate outliers.

Each document has a vector of transformed statistics.  Centre and scatter are
estimated per (language, source), per language and over all rows by the
minimum covariance determinant, in the way of FAST-MCD: several starts for each
group (coordinate medians and absolute deviations, and the moments of STARTS
small subsets drawn by hash), concentration steps from each of them (mean and
covariance of the fraction H of rows with the smallest Mahalanobis distances),
then further steps from the start whose covariance has the least determinant,
and a last reweighted estimate over the rows within the INNER quantile of
chi-square.  A document is an outlier when its squared distance to the estimate
of the smallest of its groups that holds at least MIN_GROUP rows exceeds CUTOFF.

Statistics are rounded to 1/GRID, so all sums are sums of integers: results do
not depend on the order of rows.  Quantiles are read from histograms, whose
rows are (group, bin) counts; a group's histogram is an array of as many bins
as the grid allows, and nothing gathers a group.  Estimates are tables
written between the steps; joins to them spread every group over SPREAD keys.

Everything is built-in expressions and aggregates, no Python.

Defined results.  Null text counts as empty.  Null language or source is a
group of its own.  Repeated rows count as often as they occur.  A table of
under MIN_GROUP rows has no estimates and so no outliers.  Extra columns pass
through ``filter_rows``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, materialize

GRID = 256
H = 0.75
#: Subsets that start the search beside the medians, rows of a subset, concentration steps for all starts and for the best.
STARTS, SUBSET, FIRST_STEPS, MORE_STEPS = 3, 32, 2, 1
MIN_GROUP = 200
#: Squared Mahalanobis distance beyond which a document is an outlier: what chi-square with five degrees
#: of freedom exceeds once in 10^8 draws, as clean documents have longer tails than the normal distribution.
CUTOFF = 45.8
#: The 0.975 quantile of chi-square with five degrees of freedom, for the reweighted estimate, and what makes a
#: covariance of the inner share q of normal rows consistent: q over the share of chi-square with seven degrees below.
INNER = 12.83
OF_CORE, OF_INNER = 0.75 / 0.531, 0.975 / 0.924
#: Added to the scatter's diagonal, as a standard deviation: most statistics are zero for most texts.
RIDGE = 0.25
#: Distances are compared by bins of log(1 + d2), so many to a unit.
BINS = 256
SPREAD = 16
#: Estimates (of 200 bytes) that a join may broadcast.
GROUPS = 50_000
SPACE = "[\\x20\\x09-\\x0D]+"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
DIM = ("x0", "x1", "x2", "x3", "x4")


def repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found at least twice; windows are compared by 64-bit hashes."""

    def covered(grams: Column) -> Column:
        # positions of repeated windows in order; each adds what the next one does not start within
        def of(sorted_grams: Column) -> Column:
            same = lambda i, j: F.coalesce(F.get(sorted_grams, i)["g"] == F.get(sorted_grams, j)["g"], F.lit(False))
            hits = F.sort_array(F.transform(F.filter(sorted_grams, lambda _, i: ((i > 0) & same(i, i - 1)) | same(i, i + 1)), lambda s: s["p"]))
            return let(
                hits,
                lambda p: F.aggregate(
                    F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))),
                    F.lit(0).cast("bigint"),
                    lambda a, x: a + x.cast("bigint"),
                ),
            )

        pairs = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("bigint")).otherwise(let(pairs, of))

    grams = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 3, F.lit(0).cast("bigint")).otherwise(let(grams, covered))


def statistics(text: Column) -> Column:
    """struct of the five counts (long) of a text."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, SPACE, -1), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return let(
        words,
        lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            F.char_length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
            repeat_words(w).alias("n_repeat_words"),
        ),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def vector() -> list[Column]:
    """Transformed statistics, in units of 1/GRID."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    exprs = (
        F.log1p(n),
        F.log(chars / n) * 4,
        F.log1p(F.col("n_symbols") * 100 / chars),
        F.log1p(F.col("n_dup_lines") * 100 / n),
        F.col("n_repeat_words") * 4 / n,
    )
    return [F.round(x * GRID).cast("bigint").alias(d) for d, x in zip(DIM, exprs, strict=True)]


def groups() -> Column:
    """Keys of the groups a row belongs to, largest group first."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    return F.array(F.lit("all"), F.concat(F.lit("l"), part("__lang")), F.concat(F.lit("s"), part("__lang"), F.lit("\x00"), part("__source")))


def _salt() -> Column:
    return F.pmod(F.xxhash64(*DIM), F.lit(SPREAD)).cast("int")


def _spread(table: DataFrame) -> DataFrame:
    return table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))


def _at(counts: Column, share: float) -> Column:
    """Of a sorted array of (x, n) the smallest x at which the counts reach the share."""
    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, c: a + c["n"])
    start = F.struct(F.lit(0).cast("bigint").alias("upto"), F.lit(None).cast("bigint").alias("x"))
    run = F.aggregate(
        counts, start, lambda a, c: F.struct((a["upto"] + c["n"]).alias("upto"), F.coalesce(a["x"], F.when(a["upto"] + c["n"] >= total * share, c["x"])).alias("x")), lambda a: a["x"]
    )
    return run


def _histograms(counts: DataFrame, *keys: str) -> DataFrame:
    """(keys, h): the counts (keys, x, n) of each key as a sorted array; a key has as many values as the grid or the bins allow."""
    return counts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("x").cast("bigint").alias("x"), F.col("n").cast("bigint").alias("n")))).alias("h"))


def distance(prefix: str = "") -> Column:
    """Squared Mahalanobis distance of x from centre m0.. with the Cholesky factor l00, l10, .. in the row."""
    y: list[Column] = []
    for i, d in enumerate(DIM):
        rest = F.col(d) / GRID - F.col(f"{prefix}m{i}")
        for j in range(i):
            rest = rest - F.col(f"{prefix}l{i}{j}") * y[j]
        y.append(rest / F.col(f"{prefix}l{i}{i}"))
    return sum((v * v for v in y[1:]), y[0] * y[0])


CENTRE = [f"m{i}" for i in range(len(DIM))]
FACTOR = [f"l{i}{j}" for i in range(len(DIM)) for j in range(i + 1)]


def _moments(rows: DataFrame, *keys: str) -> DataFrame:
    """n, s{i} and s{i}{j}: integer sums of weighted rows by key."""
    k = len(DIM)
    big = lambda c: F.sum(c.cast("decimal(38,0)"))
    return rows.groupBy(*keys).agg(
        F.sum("w").alias("n"),
        *[big(F.col(DIM[i]) * F.col("w")).alias(f"s{i}") for i in range(k)],
        *[big(F.col(DIM[i]) * F.col(DIM[j]) * F.col("w")).alias(f"s{i}{j}") for i in range(k) for j in range(i + 1)],
    )


def _factor(moments: DataFrame, scale: float, *keys: str) -> DataFrame:
    """From sums to centre, Cholesky factor of the ridged and scaled covariance, and its determinant's logarithm."""
    k = len(DIM)
    df = moments.withColumns({f"m{i}": F.col(f"s{i}").cast("double") / F.col("n") / GRID for i in range(k)})
    cov = lambda i, j: F.col(f"s{i}{j}").cast("double") / F.col("n") / (GRID * GRID) - F.col(f"m{i}") * F.col(f"m{j}")
    df = df.withColumns({f"v{i}{j}": cov(i, j) * scale + (RIDGE * RIDGE if i == j else 0.0) for i in range(k) for j in range(i + 1)})
    # the factor's columns from left to right; each needs those before it
    for j in range(k):
        rest = lambda i: sum((-F.col(f"l{i}{p}") * F.col(f"l{j}{p}") for p in range(j)), F.col(f"v{i}{j}"))  # noqa: B023, E731
        df = df.withColumn(f"l{j}{j}", F.sqrt(F.greatest(rest(j), F.lit(1e-9))))
        if j + 1 < k:
            df = df.withColumns({f"l{i}{j}": rest(i) / F.col(f"l{j}{j}") for i in range(j + 1, k)})
    det = sum((F.log(f"l{i}{i}") for i in range(1, k)), F.log("l00"))
    return df.select(*keys, *CENTRE, *FACTOR, det.alias("det"))


def _measured(rows: DataFrame, est: DataFrame) -> DataFrame:
    """Rows with the squared distance to each estimate of their group."""
    found = rows.withColumn("salt", _salt()).join(_spread(est), ["g", "salt"])
    return found.withColumn("d2", distance()).drop("salt", *CENTRE, *FACTOR, "det")


def concentrate(rows: DataFrame, est: DataFrame) -> DataFrame:
    """One step: the estimate (g, start) from the fraction H of rows that lie nearest to the given one."""
    near = _measured(rows, est).withColumn("bin", F.floor(F.log1p("d2") * BINS))
    bars = _histograms(near.groupBy("g", "start", F.col("bin").alias("x")).agg(F.sum("w").alias("n")), "g", "start").select("g", "start", _at(F.col("h"), H).alias("bar"))
    core = near.withColumn("salt", _salt()).join(_spread(bars), ["g", "start", "salt"]).filter("bin <= bar")
    return materialize(_factor(_moments(core, "g", "start"), OF_CORE, "g", "start"), "estimate")


def first_estimates(rows: DataFrame, large: DataFrame) -> DataFrame:
    """(g, start, m0.., l00.., det): medians and deviations as start 0, then the moments of small subsets."""
    k = len(DIM)
    values = rows.select("g", "w", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(d).alias("x")) for i, d in enumerate(DIM)])).alias("v"))
    values = values.groupBy("g", F.col("v.i").alias("i"), F.col("v.x").alias("x")).agg(F.sum("w").alias("n"))
    middle = _histograms(values, "g", "i").select("g", "i", "h", _at(F.col("h"), 0.5).alias("med"))
    away = F.sort_array(F.transform("h", lambda c: F.struct(F.abs(c["x"] - F.col("med")).alias("x"), c["n"].alias("n"))))
    mad = middle.select("g", "i", "med", _at(away, 0.5).alias("mad"))
    pick = lambda i, c: F.max(F.when(F.col("i") == i, c))
    diagonal = [
        (pick(i, F.greatest(F.col("mad") * 1.4826 / GRID, F.lit(RIDGE))) if i == j else F.max(F.lit(0.0))).alias(f"l{i}{j}") for i in range(k) for j in range(i + 1)
    ]
    medians = mad.groupBy("g").agg(*[pick(i, F.col("med").cast("double") / GRID).alias(f"m{i}") for i in range(k)], *diagonal)
    medians = medians.select("g", F.lit(0).alias("start"), *CENTRE, *FACTOR, F.lit(0.0).alias("det"))
    drawn = rows.join(large.withColumn("step", F.greatest(F.floor(F.col("n") / SUBSET), F.lit(1))).drop("n"), "g")
    starts = F.array(*[F.when(F.pmod(F.xxhash64(F.lit(s), *DIM), F.col("step")) == 0, F.lit(s)) for s in range(1, STARTS + 1)])
    drawn = drawn.withColumn("start", F.explode(F.array_compact(starts)))
    return materialize(medians.unionByName(_factor(_moments(drawn, "g", "start"), 1.0, "g", "start")), "start")


def estimates(vectors: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """(g, m0.., l00.., det) of every group of at least ``min_group`` rows; rows of ``vectors``: gs (group keys), x0.."""
    # equal vectors of a group are one row with a count: moments and histograms need no more
    rows = vectors.select(F.explode("gs").alias("g"), *DIM).groupBy("g", *DIM).agg(F.count(F.lit(1)).alias("w"))
    rows = materialize(rows, "vectors")
    large = materialize(rows.groupBy("g").agg(F.sum("w").alias("n")).filter(F.col("n") >= min_group), "large")
    rows = materialize(rows.join(large.select("g"), "g", "left_semi"), "rows")
    est = first_estimates(rows, large)
    for _ in range(FIRST_STEPS):
        est = concentrate(rows, est)
    least = Window.partitionBy("g").orderBy("det", "start")
    est = materialize(est.withColumn("r", F.row_number().over(least)).filter("r = 1").drop("r"), "least")
    for _ in range(MORE_STEPS):
        est = concentrate(rows, est)
    inner = _measured(rows, est).filter(F.col("d2") <= INNER)
    return materialize(_factor(_moments(inner, "g"), OF_INNER, "g"), "estimate")


def measured(docs: DataFrame, keep: list, text_col: str, lang_col: str, source_col: str, min_group: int) -> DataFrame:
    """``keep`` columns, the five counts and the distance to the estimate of the smallest group that has one.

    Texts stay where they are: counts are written beside the kept columns, and each row gets its group's estimate.
    """
    stats = docs.select(*keep, F.col(lang_col).alias("__lang"), F.col(source_col).alias("__source"), statistics(F.col(text_col)).alias("__s"))
    stats = stats.select(*[c for c in stats.columns if c not in ("__lang", "__source", "__s")], groups().alias("gs"), "__s.*")
    stats = materialize(stats.select("*", *vector()), "statistics")
    est = estimates(stats.filter(~base_failed()), min_group)
    # the smallest group with an estimate: groups of a row are joined by its sets of keys, not by rows
    keys = stats.select("gs").distinct().select("gs", F.posexplode("gs").alias("level", "g"))
    best = keys.join(est, "g").groupBy("gs").agg(F.max_by(F.struct(*CENTRE, *FACTOR), "level").alias("e")).select("gs", "e.*")
    best = materialize(best, "best")
    if best.count() <= GROUPS:
        joined = stats.join(F.broadcast(best), "gs", "left")
    else:
        joined = stats.withColumn("salt", _salt()).join(_spread(best), ["gs", "salt"], "left")
    return joined.withColumn("distance", distance()).drop("gs", "salt", *DIM, *CENTRE, *FACTOR)


def kept(cutoff: float = CUTOFF):
    """Passes the base rules and is no outlier; without an estimate the base rules decide."""
    return ~base_failed() & F.coalesce(F.col("distance") <= cutoff, F.lit(True))


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cutoff: float = CUTOFF, min_group: int = MIN_GROUP) -> DataFrame:
    """(doc_id, five counts, base_failed, distance, kept) for each row of ``docs``; distance is null without an estimate."""
    found = measured(docs, [F.col(id_col).alias("doc_id")], text_col, lang_col, source_col, min_group)
    return found.select("doc_id", *STATS, base_failed().alias("base_failed"), "distance", kept(cutoff).alias("kept"))


def filter_rows(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cutoff: float = CUTOFF, min_group: int = MIN_GROUP) -> DataFrame:
    """The rows of ``docs`` that are kept, columns unchanged."""
    held = [F.col(c).alias(f"__{i}") for i, c in enumerate(docs.columns)]
    found = measured(docs, held, text_col, lang_col, source_col, min_group)
    return found.filter(kept(cutoff)).select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(docs.columns)])
