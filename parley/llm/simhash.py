"""SimHash near-duplicates through vantage-point trees over Hamming distance.

1. One pass makes a 64-bit fingerprint of each document from all its word
   shingles.  Equal fingerprints form a class; only classes are searched.
2. A vantage-point tree over a bounded, fixed-size sample of classes (it only
   shapes shards; results don't depend on it) sends every class to one home
   shard.  A class whose distance to a vantage point lies within the radius of
   the split also visits the shard on the other side (triangle inequality), so
   that every close pair meets in the home shard of one of the two.
3. Each shard builds its own vantage-point tree and searches all visitors in
   bulk, pruning by the same bounds.  Links are contracted as they are found:
   a shard returns at most one edge per class, never all pairs of a group.
4. The shards' edges are joined to components (large-star/small-star).

Defined results.  Null or word-less texts have fingerprint zero and link like
any other.  Repeated rows are separate documents with equal results; a null
doc_id never names a component unless no member has an id.  An empty table
gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_bytes, hot_keys, materialize, skew_join, slices, small_join, space_words
from .components import connected_components
from .ngram_exchange import mix

SHINGLE, RADIUS = 3, 2
#: Classes that shape the shard tree, and classes that one shard is to hold.
SAMPLE, SHARD = 8192, 16384
LEAF = 48
PAIRS = 1 << 20


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of all word shingles of a lower-cased text, repeats included; of fewer words one shingle."""
    import xxhash

    words = space_words(text)
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], "<u8")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-1].tolist()][: len(words) - shingle + 1]
    stops = (ends[shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)], "<u8")


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[k : k + (1 << 16)])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the lower-cased word shingles (repeats count); zero without words."""
    return majority(shingle_hashes(text, shingle))


def wide_fingerprint(text: bytes, shingle: int, lanes: int) -> tuple[int, bytes]:
    """The fingerprint and ``lanes`` - 1 more from independent mixes of the same hashes."""
    hashes = shingle_hashes(text, shingle)
    more = [majority(mix(hashes, np.full(len(hashes), k, np.uint64))) for k in range(1, lanes)]
    return majority(hashes), np.array(more, "<u8").tobytes()


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, lanes: int = 1) -> DataFrame:
    """(doc_id, fp, more): fingerprints as signed longs, and the other lanes."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [wide_fingerprint(t, shingle, lanes) for t in column_bytes(batch, text_col)]
            fps = np.fromiter((fp for fp, _ in found), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(fps.view(np.int64)), pa.array([m for _, m in found], pa.binary())], names=["doc_id", "fp", "more"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, fp bigint, more binary")


@dataclass
class Node:
    """Inner node: those within ``radius`` of ``point`` go inside, the others outside.  A leaf has a shard number."""

    point: int = 0
    radius: int = 0
    inside: "Node | None" = None
    outside: "Node | None" = None
    shard: int = -1


def distances(values: np.ndarray, point) -> np.ndarray:
    return np.bitwise_count(values ^ np.uint64(point)).astype(np.int16)


def split(values: np.ndarray) -> tuple[int, int] | None:
    """A vantage point and radius that part ``values`` most evenly; None if they can't be parted."""
    best = None
    for k in {0, len(values) // 3, len(values) // 2, len(values) - 1}:
        d = distances(values, values[k])
        cum = np.cumsum(np.bincount(d, minlength=65))
        r = int(np.argmin(np.abs(cum - len(values) / 2)))
        # few values near the border mean few visitors; balance comes first
        cost = abs(int(cum[r]) * 2 - len(values)), int(cum[min(64, r + RADIUS)] - (cum[r - RADIUS] if r >= RADIUS else 0))
        if 0 < cum[r] < len(values) and (best is None or cost < best[0]):
            best = cost, int(values[k]), r
    return best and best[1:]


def shard_tree(sample: np.ndarray, shards: int) -> Node:
    """A tree with about ``shards`` leaves over the sample."""
    count = [0]

    def grow(values: np.ndarray, want: int) -> Node:
        cut = split(values) if want > 1 and len(values) > 1 else None
        if cut is None:
            count[0] += 1
            return Node(shard=count[0] - 1)
        near = distances(values, cut[0]) <= cut[1]
        return Node(*cut, grow(values[near], (want + 1) // 2), grow(values[~near], want // 2))

    return grow(sample, shards)


def route(values: np.ndarray, node: Node, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, shard, home): where each value lives and which shards it has to visit."""
    out = []
    todo = [(node, np.arange(len(values)), np.ones(len(values), bool))]
    while todo:
        node, idx, home = todo.pop()
        if not len(idx):
            continue
        if node.shard >= 0:
            out.append((idx, np.full(len(idx), node.shard, np.int32), home))
            continue
        d = distances(values[idx], node.point)
        near = d <= node.radius
        go = d - radius <= node.radius
        todo.append((node.inside, idx[go], (home & near)[go]))
        go = d + radius > node.radius
        todo.append((node.outside, idx[go], (home & ~near)[go]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Forest:
    """Disjoint sets over 0..n-1, fed with arrays of pairs; a set's name is its smallest member."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        ra, rb = self.root[a], self.root[b]
        differ = ra != rb
        if differ.any():
            self.held.append(np.stack([ra[differ], rb[differ]]))
            self.size += int(differ.sum())
        if self.size > PAIRS:
            self.settle()

    def settle(self) -> np.ndarray:
        pairs = np.concatenate(self.held, axis=1) if self.held else np.zeros((2, 0), np.int64)
        self.held, self.size = [], 0
        while pairs.shape[1]:
            a, b = self.root[pairs[0]], self.root[pairs[1]]
            differ = a != b
            pairs, a, b = pairs[:, differ], a[differ], b[differ]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up
        return self.root


def search_shard(values: np.ndarray, home: np.ndarray, radius: int, leaf: int = LEAF, more: np.ndarray | None = None, total: int | None = None) -> np.ndarray:
    """Links of a shard, contracted: for each of the ``values`` the index of its set's first member.

    All values visit; those at ``home`` are indexed.  Pairs of two residents
    are seen twice and used once.  ``more`` and ``total``: further lanes, and
    the most bits that all lanes together may differ in.
    """
    sets = Forest(len(values))
    todo = [(np.flatnonzero(home), np.arange(len(values)))]
    while todo:
        own, visit = todo.pop()
        if not len(own) or not len(visit):
            continue
        cut = split(values[own]) if len(own) > leaf else None
        if cut is None:
            step = max(1, PAIRS // len(own))
            for k in range(0, len(visit), step):
                v = visit[k : k + step]
                q, o = np.nonzero(np.bitwise_count(values[v][:, None] ^ values[own][None, :]) <= radius)
                a, b = v[q], own[o]
                once = (a < b) | ((a > b) & ~home[a])
                a, b = a[once], b[once]
                if total is not None and len(a):
                    near = np.bitwise_count(values[a] ^ values[b]).astype(np.int32) + np.bitwise_count(more[a] ^ more[b]).sum(axis=1, dtype=np.int32) <= total
                    a, b = a[near], b[near]
                sets.add(a, b)
            continue
        near = distances(values[own], cut[0]) <= cut[1]
        d = distances(values[visit], cut[0])
        todo.append((own[near], visit[d - radius <= cut[1]]))
        todo.append((own[~near], visit[d + radius > cut[1]]))
    return sets.settle()


def link_classes(classes: DataFrame, radius: int = RADIUS, total: int | None = None, sample: int = SAMPLE, shard: int = SHARD) -> DataFrame:
    """(node, root) for every class (node, fp, more) that has a link: root is the smallest node of its component."""
    spark = classes.sparkSession
    n = classes.count()
    picked = classes.select("fp").distinct().orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()
    points = np.array([r[0] for r in picked], np.int64).view(np.uint64)
    tree = shard_tree(points, max(1, -(-n // shard)))
    held = spark.sparkContext.broadcast(tree)
    columns = ["node", "fp", *(["more"] if total is not None else [])]

    def deal(batches):
        import pyarrow as pa

        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
            idx, to, home = route(fps.view(np.uint64), held.value, radius)
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(home), *(batch.column(c).take(pa.array(idx)) for c in columns)], names=["shard", "home", *columns])

    def search(table):
        import pyarrow as pa

        node = table.column("node").to_numpy()
        order = np.argsort(node)
        node, values, home = node[order], table.column("fp").to_numpy()[order].view(np.uint64), table.column("home").to_numpy()[order]
        more = None
        if total is not None:
            more = np.frombuffer(b"".join(table.column("more").to_pylist()), "<u8").reshape(len(node), -1)[order]
        root = search_shard(values, home, radius, more=more, total=total)
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"u": node[moved], "v": node[root[moved]]})

    schema = "shard int, home boolean, node bigint, fp bigint" + ", more binary" * (total is not None)
    dealt = classes.select(*columns).mapInArrow(deal, schema)
    edges = dealt.groupBy("shard").applyInArrow(search, "u bigint, v bigint")
    return connected_components(edges).select("node", F.col("component").alias("root"))


def link(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, lanes: int = 1, total: int | None = None, shard: int = SHARD
) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``: component_id is the smallest doc_id reachable over links.

    Fingerprints link at ``radius`` or fewer differing bits.  With more
    ``lanes``, documents link when also all lanes together differ in ``total``
    or fewer bits, which tells similarity more closely than 64 bits can.
    """
    fps = fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle, lanes=lanes)
    fps = materialize(fps.withColumn("node", F.col("fp") if lanes == 1 else F.xxhash64("fp", "more")), "simhash")
    classes = fps.groupBy("node").agg(F.first("fp").alias("fp"), F.first("more").alias("more"), F.min("doc_id").alias("first"))
    classes = materialize(classes, "classes")
    roots = link_classes(classes, radius, total if lanes > 1 else None, shard=shard)
    named = classes.select("node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = materialize(named, "named")
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of_node = skew_join(named.select("node", "root"), smallest, "root").select("node", "component_id")
    rows = fps.select("doc_id", "fp", "node")
    return skew_join(rows, of_node, "node", "left", hot=hot_keys(rows, "node")).select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each component of near copies: the one with the smallest id.  Rows without an id are kept
    only where their component has no id at all, then one of them.  Different texts under one id are documents of their
    own.  Options of ``near_copies.components``.

    Only hashes of rows move: what is dropped is taken out of ``docs`` by a join on those.
    """
    from . import near_copies

    plain = [c for c, kind in docs.dtypes if "map<" not in kind]
    # nulls leave a hash as it is, so that their places are hashed, too
    row = lambda k: F.xxhash64(F.lit(k), F.col(id_col).isNull(), F.col(text_col).isNull(), id_col, text_col, *plain)
    keyed = docs.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(docs.columns)], row(1).alias("__a"), row(2).alias("__b"))
    at = {c: f"__{i}" for i, c in enumerate(docs.columns)}
    name = F.col(at[id_col])
    key = ["__a", "__b"]
    found = near_copies.components(keyed, key=key, keep=[at[id_col]], text_col=at[text_col], **options)
    rows = found.groupBy(*key).agg(F.min("root").alias("root"), F.min(name).alias("id"), F.count(F.lit(1)).alias("c"))
    rows = materialize(rows, "rows")
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", *key)).alias("best"))
    judged = skew_join(rows, best, "root").withColumn("stays", (F.col("__a") == F.col("best.__a")) & (F.col("__b") == F.col("best.__b")))
    judged = materialize(judged.select(*key, "c", "stays"), "judged")
    gone = materialize(judged.filter("not stays").select(*key), "gone")
    # equal rows have equal hashes: of those that stay one has to be taken
    repeated = materialize(judged.filter("stays and c > 1").select(*key), "repeated")
    kept = small_join(keyed, gone, key, "left_anti")
    once = small_join(kept, repeated, key, "left_anti")
    kept = once.unionByName(small_join(kept, repeated, key, "left_semi").dropDuplicates(key))
    return kept.select(*[F.col(at[c]).alias(c) for c in docs.columns])
