"""Mixing sources to target weights by the cube method.

Every document of a source is taken floor(m) times, m being target over size of
the source (at most 3), and once more with probability m - floor(m).  The extra
copies are drawn by the cube method: the fractional inclusion probabilities of
three documents at a time move along the direction that keeps both their sum
and the sum of their words, until one of them is 0 or 1.

A document of more than LARGE of its source's target could not be balanced at
the end, so these (at most the source's size over LARGE times its target) are
drawn first, by systematic sampling, and what they take too many or too few is
made up by the others' probabilities; only where those can't make it up are
large documents exchanged.  The others are dealt to blocks of bounded size by a
hash; each block ends with two open documents at most, which are dealt anew
until a source fits one block.  Its last two are landed by systematic sampling.
A source's words miss its target by no more than two documents of LARGE.

Random numbers follow from hashes of the ids and a seed: reruns agree.

Defined results.  Null text has size 0 and is taken 0 words whatever is drawn.
The null source is a source like any other.  Repeated rows are drawn
separately, in an order by hash; which of two equal rows is taken is
immaterial.  An empty table, or one without any word, gives targets of 0.
Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
BLOCK = 4096
SPREAD = 32
#: Share of its source's target from which a document is drawn first.
LARGE = 0.0025


def targets(sources: DataFrame, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """Adds ``target`` to (source, source_size): the total shared by weight, no source above ``most`` times its size.

    Sources in code point order, null last, take the weights in turn.  With a
    common factor f each source gets min(most * size, f * weight); sources are
    closed in the order of size over weight until f no longer passes the next.
    """
    every = Window.partitionBy(F.lit(0))
    order = every.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    df = sources.withColumn("w", w).withColumn("cap", F.col("source_size") * most)
    by_ratio = every.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("closed", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("open_w", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    df = df.withColumn("f", (F.sum("source_size").over(every) - F.col("closed")) / F.col("open_w")).withColumn("stays", F.col("f") * F.col("w") <= F.col("cap"))
    factor = F.min(F.when(F.col("stays"), F.struct(F.col("cap") / F.col("w"), F.col("f")))).over(every)["f"]
    return df.withColumn("target", F.least("cap", F.coalesce(factor, F.lit(0.0)) * F.col("w"))).select("source", "source_size", "n_docs", "target")


def flight(size: np.ndarray, p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Moves ``p`` to 0 or 1, keeping its sum and its sum weighted by ``size``; at most two stay open, which come late.

    ``u``: one uniform number for each row.
    """
    p = p.copy()
    held: list[int] = []
    step = 0
    for k in np.flatnonzero((p > 0) & (p < 1)).tolist():
        held.append(k)
        if len(held) < 3:
            continue
        a, b, c = held
        d = (size[c] - size[b], size[a] - size[c], size[b] - size[a])
        if not any(d):
            d = (1.0, -1.0, 0.0)
        up = min((1 - p[i]) / x if x > 0 else -p[i] / x for i, x in zip(held, d, strict=True) if x)
        down = min(p[i] / x if x > 0 else (p[i] - 1) / x for i, x in zip(held, d, strict=True) if x)
        move = up if u[step] * (up + down) < down else -down
        step += 1
        for i, x in zip(held, d, strict=True):
            p[i] += move * x
            if p[i] < 1e-9:
                p[i] = 0.0
            elif p[i] > 1 - 1e-9:
                p[i] = 1.0
        held = [i for i in held if 0 < p[i] < 1]
    return p


def land(p: np.ndarray, u: float) -> np.ndarray:
    """Closes the open rows by systematic sampling: each with its probability, as many as they sum to, give or take one."""
    open_ = np.flatnonzero((p > 0) & (p < 1))
    upto = np.cumsum(p[open_]) + u
    p = p.copy()
    p[open_] = np.floor(upto) - np.floor(np.concatenate([[u], upto[:-1]]))
    return p


def draw_large(size: np.ndarray, p: np.ndarray, rest: float, u: float) -> np.ndarray:
    """0 or 1 for each large document, ``rest`` being the words of the others, which all have the first one's ``p``.

    Sizes are descending, so that systematic sampling spreads over them.  What is drawn is exchanged, by the document
    that comes nearest, only while the others' words can't make up for it.
    """
    x = land(p, u)
    while True:
        short = ((p - x) * size).sum()
        excess = max(short - (1 - p[0]) * rest, 0.0) + min(short + p[0] * rest, 0.0)
        flips = np.flatnonzero(x == (0.0 if excess > 0 else 1.0))
        if not excess or not len(flips):
            return x
        k = flips[np.argmin(np.abs(size[flips] - abs(excess)))]
        if abs(size[k] - abs(excess)) >= abs(excess):
            return x
        x[k] = 1 - x[k]


def _large(seed: int):
    def run(table):
        import pyarrow as pa

        size, key = (table.column(c).to_numpy() for c in ("size", "key"))
        order = np.lexsort((key, -size))
        u = np.random.default_rng([seed, int(key.min()) & (2**63 - 1), len(size)]).random()
        x = draw_large(size[order].astype(float), table.column("p").to_numpy()[order], float(table.column("rest")[0].as_py()), u)
        return pa.table({c: (pa.array(x) if c == "p" else table.column(c).take(pa.array(order))) for c in ("doc_id", "source", "size", "key", "p")})

    return run


def _round(last: bool, seed: int):
    def run(table):
        import pyarrow as pa

        size, key, p = (table.column(c).to_numpy() for c in ("size", "key", "p"))
        order = np.lexsort((size, key))
        size, p = size[order].astype(float), p[order]
        u = np.random.default_rng([seed, int(key.min()) & (2**63 - 1), len(size)]).random(len(size) + 1)
        p = flight(size, p, u)
        if last:
            p = land(p, u[-1])
        return pa.table({c: (pa.array(p) if c == "p" else table.column(c).take(pa.array(order))) for c in ("doc_id", "source", "size", "key", "p")})

    return run


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, most: float = MOST, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for each row of ``docs``; taken is size times copies."""
    parts = F.split(F.coalesce(F.col(text_col), F.lit("")), "[\\x20\\x09-\\x0D]+", -1)
    n = F.transform(F.array(parts), lambda w: F.size(w) - F.when(F.element_at(w, 1) == "", 1).otherwise(0) - F.when((F.element_at(w, -1) == "") & (F.size(w) > 1), 1).otherwise(0))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.element_at(n, 1).cast("bigint").alias("size"))
    rows = materialize(rows.withColumn("key", F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed))), "sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    shares = materialize(targets(sources, weights, most), "shares")
    m = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(most))).otherwise(F.lit(0.0))
    # within a millionth of a whole number of copies counts as whole
    shares = shares.withColumn("m", F.when(F.abs(m - F.round(m)) < 1e-9, F.round(m)).otherwise(m))
    spread = shares.select(F.col("source").alias("s"), "source_size", "n_docs", "target", "m", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("salt"))
    drawn = rows.withColumn("salt", F.pmod(F.col("key"), F.lit(SPREAD)).cast("int"))
    drawn = drawn.join(spread, (drawn.source.eqNullSafe(spread.s)) & (drawn.salt == spread.salt)).drop(spread.salt)
    drawn = drawn.select("doc_id", "source", "size", "source_size", "target", "n_docs", F.floor("m").cast("int").alias("whole"), (F.col("m") - F.floor("m")).alias("p"), "key")
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, source {rows.schema['source'].dataType.simpleString()}, size bigint, key bigint, p double"

    def rounds(open_: DataFrame, blocks) -> DataFrame:
        last = blocks is None
        dealt = open_.withColumn("b", F.lit(0) if last else F.pmod(F.xxhash64("key", F.lit(seed)), blocks))
        return dealt.groupBy("source", "b").applyInArrow(_round(last, seed), schema)

    large = (F.col("p") > 0) & (F.col("size") > F.col("target") * LARGE)
    first = rows.groupBy("source").agg(F.sum("size").alias("all"))
    drawn = drawn.withColumn("large", large)
    big = drawn.filter("large")
    words = materialize(big.groupBy("source").agg(F.sum("size").alias("big"), F.first("p").alias("p0")).join(first.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "large-words")
    rest = words.select(F.col("source").alias("s"), (F.col("all") - F.col("big")).alias("rest"))
    taken = big.join(rest, F.col("source").eqNullSafe(F.col("s"))).drop("s").groupBy("source").applyInArrow(_large(seed), schema)
    taken = materialize(taken, "large")
    # the others share what the large ones fall short of
    got = taken.groupBy("source").agg(F.sum(F.col("size") * F.col("p")).alias("got")).withColumnRenamed("source", "t")
    shift = words.join(got, F.col("source").eqNullSafe(F.col("t"))).select(F.col("source").alias("s"), (F.col("all") - F.col("big")).alias("rest"), ((F.col("big") * F.col("p0")) - F.col("got")).alias("short"))
    left = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("p") + F.coalesce(F.try_divide("short", "rest"), F.lit(0.0))))
    spread_shift = shift.withColumn("salt2", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    others = drawn.filter("not large").withColumn("salt1", F.pmod(F.col("key"), F.lit(SPREAD)).cast("int"))
    others = others.join(spread_shift, F.col("source").eqNullSafe(F.col("s")) & (F.col("salt1") == F.col("salt2")), "left")
    others = others.withColumn("p", F.when(F.col("p") > 0, left).otherwise(0.0)).select("doc_id", "source", "size", "key", "p", "n_docs")
    blocks = F.greatest(F.ceil(F.col("n_docs") / block), F.lit(1))
    moved = materialize(rounds(others, blocks).unionByName(taken), "flight")
    closed, open_ = [moved.filter("p = 0 or p = 1")], moved.filter("p > 0 and p < 1")
    while True:
        left = open_.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"))
        most_left = left.agg(F.max("n_docs")).first()[0] or 0
        if most_left <= block:
            closed.append(rounds(open_, None))
            break
        counted = open_.join(left.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        moved = materialize(rounds(counted, F.ceil(F.col("n_docs") / block)), "flight")
        closed.append(moved.filter("p = 0 or p = 1"))
        open_ = moved.filter("p > 0 and p < 1")
    extra = closed[0]
    for x in closed[1:]:
        extra = extra.unionByName(x)
    extra = extra.withColumn("salt", F.pmod(F.col("key"), F.lit(SPREAD)).cast("int"))
    whole = spread.withColumn("whole", F.floor("m").cast("int"))
    joined = extra.join(whole, (extra.source.eqNullSafe(whole.s)) & (extra.salt == whole.salt))
    copies = F.col("whole") + F.col("p").cast("int")
    return joined.select("doc_id", "source", "size", "source_size", "target", copies.cast("int").alias("copies"), (F.col("size") * copies).cast("bigint").alias("taken"))
