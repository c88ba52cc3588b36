"""Shared plumbing: shared-folder tables, skew-aware joins, array helpers, tokenising."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds more than this share of a table's rows.  By
#: construction at most 1/HOT_SHARE keys can be hot, so the list is bounded.
HOT_SHARE = 1 / 500
#: ... and at least this many rows, so that small tables are joined plainly.
HOT_ROWS = 2000
#: Rows of a hot key are spread over so many join partitions.
SALTS = 32


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where it is unset and everything runs in one JVM (tests), a temporary
    folder is set; on a cluster an unset folder is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    held = spark.sparkContext.getCheckpointDir()
    if held:
        return held
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="parley-"))
    return spark.sparkContext.getCheckpointDir()


@contextmanager
def brief_exchanges(spark: SparkSession):
    """Within, the files of a query's exchanges go when it ends, not when the driver's garbage is collected; a DataFrame made within can run once."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Folders written by this process, in order.
WRITTEN: list[str] = []


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/parley/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, first: int, last: int) -> None:
    """Deletes the folders WRITTEN[first:last], which nothing may read any more."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    for path in WRITTEN[first:last]:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    del WRITTEN[first:last]


def hot_keys(df: DataFrame, key: str) -> list:
    """Keys of ``df`` with over HOT_SHARE of its rows: at most 1/HOT_SHARE values."""
    total = df.count()
    if total <= HOT_ROWS:
        return []
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return [r[0] for r in counts.filter(F.col("n") > max(HOT_ROWS, int(total * HOT_SHARE))).select(key).collect() if r[0] is not None]


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", hot: list | None = None) -> DataFrame:
    """Equi-join on ``key`` where ``left`` may hold hot keys and ``right`` has unique keys.

    Rows of hot keys are spread over SALTS partitions by a hash of the whole
    row; only the (at most 1/HOT_SHARE) matching rows of ``right`` are
    repeated.  Equal to the plain join in every case.
    """
    hot = hot_keys(left, key) if hot is None else hot
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    salted = left.withColumn("__salt", F.when(is_hot, F.pmod(F.xxhash64(*left.columns), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    spread = right.withColumn("__salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(spread, [key, "__salt"], how).drop("__salt")


#: Rows of two or three hashes that a join may broadcast: 64 MB at most.
KEYS = 2_000_000


def small_join(left: DataFrame, right: DataFrame, key: list[str], how: str = "inner") -> DataFrame:
    """Equi-join with a written table of keys that is broadcast only while it has at most KEYS rows, else shuffled."""
    return left.join(F.broadcast(right) if right.count() <= KEYS else right, key, how)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def prefix_sums(lengths: Column, block: int = 512) -> Column:
    """Exclusive prefix sums of an array of longs, in blocks so that no step is quadratic in the array."""
    zero = F.array(F.lit(0).cast("bigint"))

    def scan(xs: Column) -> Column:
        return F.aggregate(xs, zero, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x.cast("bigint"))))

    def whole(xs: Column) -> Column:
        blocks = F.transform(
            F.when(F.size(xs) > 0, F.sequence(F.lit(0), ((F.size(xs) - 1) / block).cast("int"))).otherwise(F.array().cast("array<int>")),
            lambda b: scan(F.slice(xs, b * block + 1, F.lit(block))),
        )
        return let(
            blocks,
            lambda local: let(
                scan(F.transform(local, lambda s: F.element_at(s, -1))),
                lambda offs: F.flatten(F.transform(local, lambda s, i: F.transform(F.slice(s, F.lit(1), F.size(s) - 1), lambda v: v + F.element_at(offs, i + 1)))),
            ),
        )

    return let(lengths, whole)


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; pure-ASCII texts take the byte-wise built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


#: bytes.translate tables for Arrow code: A-Z lower-cased; the second also turns every
#: ASCII byte that is neither letter nor digit into a space.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
ALNUM = bytes((LOWER[b] if b >= 128 or chr(b).isalnum() else 32) for b in range(256))


def alnum_words(text: bytes) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and non-ASCII characters."""
    return text.translate(ALNUM).split()


def space_words(text: bytes) -> list[bytes]:
    """Lower-cased runs between the ASCII white space characters."""
    return text.translate(LOWER).split()


def column_bytes(batch, name: str) -> list[bytes]:
    """A string column of an Arrow batch as UTF-8 bytes; null is empty."""
    import pyarrow as pa

    col = batch.column(name)
    kind = pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()
    return [b"" if x is None else x for x in col.cast(kind).to_pylist()]


def each_bytes(batch, name: str):
    """As ``column_bytes``, one text at a time."""
    for x in batch.column(name):
        text = x.as_py()
        yield b"" if text is None else text.encode()


def slices(sizes: list[int], most: int):
    """Cuts 0..len(sizes) into runs of at most ``most`` in total (one item at least)."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def read(spark: SparkSession, sf_dir: str, table: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*cols) if cols else df
