"""Benchmark decontamination over a stored, distributed positional inverted index.

1. ``index`` cuts the documents into segments of bounded size and writes one
   row for each to the shared folder: the segment's terms (sorted hashes) with
   their document frequencies and posting lists (word positions, as deltas),
   and what is kept of its documents.  Segments lie where their documents were,
   so nothing is shuffled and a frequent term only lengthens lists that one
   segment holds.
2. The benchmark is read in blocks of bounded size, one after the other; one
   block is broadcast at a time.  Each segment resolves the block's windows:
   the postings of a window's rarest term, shifted by its offset, are
   intersected with the shifted postings of the next rarest term, and so on.
   What is left after the last term are exact phrase matches.  A proximity
   match is a stretch of PROXIMITY words that holds all terms of a window, in
   any order.  Matches are sparse rows (segment, document).
3. Matches of all blocks are merged by document and joined to the index.

Defined results.  Null or word-less documents: no words, no hits.  Benchmark
rows without words match nothing; a null item id counts as the id ``null``.
Repeated item ids count once; repeated rows of either table are kept and
treated alike.  An empty benchmark leaves every document clean.  Kept columns
pass through; one that bears the name of the result column is replaced.
Different words are taken to have different 60-bit hashes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import alnum_words, column_bytes, materialize, slices, small_join
from .ngram_exchange import Chunk, narrow, pack, pack_bytes, unpack, unpack_bytes, word_hash

WINDOW = 13
#: Words of a stretch that has to hold all terms of a window for a proximity match.
PROXIMITY = 2 * WINDOW
#: Text bytes of the benchmark that are sent to the tasks at a time, and of one index segment.
BLOCK_BYTES, SEGMENT_BYTES = 4 << 20, 4 << 20
#: Candidate positions that are intersected at a time.
CANDIDATES = 1 << 18

SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
FOUND = T.StructType(
    [
        T.StructField("segment", T.StringType()),
        T.StructField("doc", T.IntegerType()),
        T.StructField("hits", T.ArrayType(SPAN)),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("near_items", T.ArrayType(T.StringType())),
    ]
)
SEGMENT = ("segment", "lengths", "terms", "df", "postings")


class Windows:
    """A block of the benchmark: windows of equal length as rows of term numbers, with the items that own them."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        number: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        self.items = sorted({i for i, _ in items})
        of_item = {x: k for k, x in enumerate(self.items)}
        for item, text in items:
            ids = [number.setdefault(w, len(number)) for w in alnum_words(text)]
            for s in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[s : s + window]), set()).add(of_item[item])
        self.hashes = np.array([word_hash(w) for w in number], np.uint64)
        self.groups = []
        for length in sorted({len(w) for w in found}):
            rows = [w for w in found if len(w) == length]
            self.groups.append((np.array(rows, np.int32), [sorted(found[w]) for w in rows]))


def build_segment(texts: list[bytes]) -> dict:
    """Terms, frequencies and postings of some documents; a place is left free between two of them."""
    chunk = Chunk(texts)
    order = np.argsort(chunk.hashes)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    term = rank[chunk.ids]
    place = (np.arange(len(term)) + chunk.doc).astype(np.uint32)
    by_term = np.argsort(term, kind="stable")
    return {
        "lengths": chunk.lengths,
        "terms": pack(chunk.hashes[order]),
        "df": pack_bytes(narrow(np.bincount(term, minlength=len(order)))),
        # deltas run on from one list to the next and wrap there
        "postings": pack_bytes(np.diff(place[by_term], prepend=np.uint32(0))),
    }


class Segment:
    """A segment as read back: posting lists one after the other, as sorted keys (term, position)."""

    def __init__(self, lengths, terms: bytes, df: bytes, postings: bytes):
        self.lengths = np.asarray(lengths, np.int64)
        self.starts = np.cumsum(self.lengths + 1) - self.lengths - 1
        self.terms = unpack(terms)
        self.df = unpack_bytes(df).astype(np.int64)
        self.first = np.cumsum(self.df) - self.df
        self.postings = np.cumsum(unpack_bytes(postings), dtype=np.uint32).astype(np.int64)
        self.span = int(self.lengths.sum()) + len(self.lengths) + 1
        self.keys = np.repeat(np.arange(len(self.terms)), self.df) * self.span + self.postings

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Own numbers of terms, -1 for those that don't occur."""
        if not len(self.terms):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def candidates(self, windows: np.ndarray):
        """(window, order of its terms by rarity, row, posting of the rarest term), in blocks; ``windows``: own term numbers."""
        here = np.flatnonzero((windows >= 0).all(axis=1))
        if not len(here):
            return
        mine = windows[here]
        rarity = np.argsort(self.df[mine], axis=1, kind="stable")
        rare = np.take_along_axis(mine, rarity[:, :1], 1)[:, 0]
        for a, b in slices(self.df[rare].tolist(), CANDIDATES):
            n = self.df[rare[a:b]]
            row = np.repeat(np.arange(a, b), n)
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield here, rarity, row, self.postings[self.first[rare[row]] + within]

    def phrases(self, windows: np.ndarray):
        """(window, start) of every exact occurrence, by intersecting offset-adjusted posting lists."""
        for here, rarity, row, place in self.candidates(windows):
            start = place - rarity[row, 0]
            for k in range(1, windows.shape[1]):
                offset = rarity[row, k]
                key = windows[here[row], offset] * self.span + start + offset
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                # places outside the segment would be looked for in another list
                ok = (self.keys[at] == key) & (start >= 0) & (start + offset < self.span)
                row, start = row[ok], start[ok]
            yield here[row], start[start >= 0] if windows.shape[1] == 1 else start

    def near(self, windows: np.ndarray, stretch: int):
        """(window, place of its rarest term) where ``stretch`` words of one document around that hold all its terms."""
        for here, rarity, row, place in self.candidates(windows):
            doc = self.doc_of(place)
            first, last = self.starts[doc], self.starts[doc] + self.lengths[doc] - 1

            def holds(row, lo, hi, k):
                base = windows[here[row], rarity[row, k]] * self.span  # noqa: B023
                return np.searchsorted(self.keys, base + hi, "right") > np.searchsorted(self.keys, base + lo, "left")

            for k in range(1, windows.shape[1]):
                ok = holds(row, np.maximum(place - stretch + 1, first), np.minimum(place + stretch - 1, last), k)
                row, place, first, last = row[ok], place[ok], first[ok], last[ok]
            found = np.zeros(len(row), bool)
            for s in range(stretch):
                left = np.flatnonzero(~found)
                lo, hi = np.maximum(place - s, first), np.minimum(place - s + stretch - 1, last)
                for k in range(1, windows.shape[1]):
                    left = left[holds(row[left], lo[left], hi[left], k)]
                found[left] = True
            yield here[row[found]], place[found]

    def doc_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, place, "right") - 1


def merged(spans) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or touch made one."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(e, out[-1][1])
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def search(segment: Segment, queries: Windows, stretch: int | None) -> list[tuple]:
    """(document, hits, items, items near by) of the documents that a block matches."""
    spans: dict[int, set[tuple[int, int]]] = {}
    items: dict[int, set[int]] = {}
    close: dict[int, set[int]] = {}
    own = segment.numbers(queries.hashes)
    for windows, owners in queries.groups:
        mine = own[windows]
        for win, start in segment.phrases(mine):
            docs = segment.doc_of(start)
            for d, w, s in zip(docs.tolist(), win.tolist(), (start - segment.starts[docs]).tolist(), strict=True):
                spans.setdefault(d, set()).add((s, s + windows.shape[1]))
                items.setdefault(d, set()).update(owners[w])
        if stretch is not None:
            for win, place in segment.near(mine, stretch):
                pairs = np.unique(segment.doc_of(place) * len(owners) + win) if len(win) else win
                for p in pairs.tolist():
                    close.setdefault(p // len(owners), set()).update(owners[p % len(owners)])
    name = lambda xs: [queries.items[i] for i in sorted(xs)]
    return [(d, merged(spans.get(d, ())), name(items.get(d, ())), name(close.get(d, ()))) for d in sorted({*spans, *close})]


def index(docs: DataFrame, keep: list[str], text_col: str = "text", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The written index: one row for each segment, ``keep`` columns as arrays over its documents."""
    schema = T.StructType(
        [
            T.StructField("segment", T.StringType()), T.StructField("lengths", T.ArrayType(T.LongType())),
            *[T.StructField(c, T.BinaryType()) for c in ("terms", "df", "postings")],
            *[T.StructField(f"_{i}", T.ArrayType(docs.schema[c].dataType)) for i, c in enumerate(keep)],
        ]
    )

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        import pyarrow.compute as pc

        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_pylist()
            for a, b in slices(sizes, segment_bytes):
                row = {"segment": f"{task}.{number}", **build_segment(column_bytes(batch.slice(a, b - a), text_col))}
                number += 1
                lists = [pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), batch.column(c).slice(a, b - a)) for c in keep]
                plain = [pa.array([row["segment"]]), pa.array([row["lengths"].tolist()], pa.list_(pa.int64())), *(pa.array([row[c]], pa.binary()) for c in SEGMENT[2:])]
                yield pa.RecordBatch.from_arrays([*plain, *lists], names=[*SEGMENT, *(f"_{i}" for i in range(len(keep)))])

    return materialize(docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(run, schema), "index")


def matches(segments: DataFrame, benchmark: DataFrame, window: int = WINDOW, proximity: int | None = PROXIMITY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(segment, doc, hits, items, near_items) of the documents that match any of ``benchmark`` (i, t)."""
    spark = segments.sparkSession
    total = benchmark.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    found = None
    for b in range(blocks):
        mine = benchmark.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)
        queries = spark.sparkContext.broadcast(Windows([(r[0], r[1].encode()) for r in mine.toLocalIterator()], window))

        def run(batches, queries=queries):
            import pyarrow as pa
            from pyspark.sql.pandas.types import to_arrow_schema

            schema = to_arrow_schema(FOUND)
            for batch in batches:
                rows = batch.to_pylist()
                for row in rows:
                    name = row.pop("segment")
                    here = search(Segment(**row), queries.value, proximity)
                    cols = [[name] * len(here), [d for d, *_ in here], [[{"start": s, "end": e} for s, e in h] for _, h, *_ in here], [i for *_, i, _ in here], [n for *_, n in here]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        part = materialize(segments.select(*SEGMENT).mapInArrow(run, FOUND), "matches")
        queries.destroy()
        found = part if found is None else found.unionByName(part)
    every = lambda c: F.flatten(F.collect_list(c))
    by_doc = found.groupBy("segment", "doc").agg(F.array_sort(F.array_distinct(every("hits"))).alias("h"), F.array_sort(F.array_distinct(every("items"))).alias("items"), F.array_distinct(every("near_items")).alias("n"))
    last = lambda a: F.element_at(a, -1)
    joined = F.aggregate(
        F.slice("h", F.lit(2), F.size("h")),
        F.slice("h", F.lit(1), F.lit(1)),
        lambda a, x: F.when(x["start"] <= last(a)["end"], F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(last(a)["start"].alias("start"), F.greatest(last(a)["end"], x["end"]).alias("end"))))).otherwise(F.concat(a, F.array(x))),
    )
    return by_doc.select("segment", "doc", F.when(F.size("h") > 1, joined).otherwise(F.col("h")).alias("hits"), "items", F.array_sort(F.array_except("n", "items")).alias("near_items"))


def annotate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    proximity: int | None = PROXIMITY,
    keep: list[str] | None = None,
    out: str = "contamination",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The ``keep`` columns of ``docs`` (all by default) plus ``out``: struct of n_words, hits (merged word spans), items, near_items.

    ``proximity``: a window also matches where so many words hold all of its
    words, in any order; None leaves ``near_items`` empty.
    """
    keep = [c for c in (keep or docs.columns) if c != out]
    bench = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t"))
    segments = index(docs, keep, text_col)
    found = materialize(matches(segments, bench, window, proximity, block_bytes), "found")
    kept = [f"_{i}" for i in range(len(keep))]
    rows = segments.select("segment", F.posexplode(F.arrays_zip("lengths", *kept)).alias("doc", "x")).select("segment", "doc", "x.*")
    none = F.array().cast("array<string>")
    result = F.struct(
        F.col("lengths").alias("n_words"), F.coalesce("hits", F.array().cast("array<struct<start:int,end:int>>")).alias("hits"),
        F.coalesce("items", none).alias("items"), F.coalesce("near_items", none).alias("near_items"),
    )
    joined = small_join(rows, found, ["segment", "doc"], "left")
    return joined.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], result.alias(out))


def n_hit(contamination: Column) -> Column:
    return F.aggregate(contamination["hits"], F.lit(0).cast("bigint"), lambda a, h: a + (h["end"] - h["start"]).cast("bigint"))


def verdicts(annotated: DataFrame, out: str = "contamination", share: int = 20) -> DataFrame:
    """Adds n_hit, n_items, items_sha256, contaminated (hit words make at least 1/share of all) and n_near to annotated rows."""
    c = F.col(out)
    return (
        annotated.withColumn("n_words", c["n_words"])
        .withColumn("n_hit", n_hit(c))
        .withColumn("n_items", F.size(c["items"]).cast("bigint"))
        .withColumn("items_sha256", F.sha2(F.concat_ws(",", F.array_sort(c["items"])), 256))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))
        .withColumn("n_near", F.size(c["near_items"]).cast("bigint"))
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", window: int = WINDOW, share: int = 20, **options) -> DataFrame:
    """``docs`` without the rows that hold benchmark text, columns unchanged.

    A row goes when it holds a whole window of the benchmark, or when shorter
    items make up 1/share of its words.  Only hashes of rows move.
    """
    c = F.col("__contamination")
    plain = [x for x, kind in docs.dtypes if "map<" not in kind]
    # nulls leave a hash as it is, so that their places are hashed, too
    row = lambda k: F.xxhash64(F.lit(k), F.col(text_col).isNull(), text_col, *plain)
    keyed = docs.select(*[F.col(x).alias(f"__{i}") for i, x in enumerate(docs.columns)], row(1).alias("__a"), row(2).alias("__b"))
    at = {x: f"__{i}" for i, x in enumerate(docs.columns)}
    found = annotate(keyed, benchmark, text_col=at[text_col], window=window, proximity=None, keep=["__a", "__b"], out="__contamination", **options)
    whole = F.exists(c["hits"], lambda h: h["end"] - h["start"] >= window)
    gone = found.filter(whole | ((n_hit(c) > 0) & (n_hit(c) * share >= c["n_words"]))).select("__a", "__b").distinct()
    return small_join(keyed, materialize(gone, "gone"), ["__a", "__b"], "left_anti").select(*[F.col(at[x]).alias(x) for x in docs.columns])
