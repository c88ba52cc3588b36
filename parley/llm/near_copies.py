"""Near copies: documents whose sets of word shingles have a Jaccard similarity of at least 4/5.

Every link is checked on the whole sets; candidates come from two sources.

1. Equal sets form a class; only classes are searched.
2. SimHash: fingerprints within RADIUS bits, found by the vantage-point shards
   of ``simhash``.  At a similarity of 4/5 fingerprints differ in ten of 64 bits
   on average; a tree that has to reach so far prunes nothing, so this source
   only brings the closest copies.
3. The rest: each class has a sketch of BANDS x WIDTH minima, cut into bands.
   Two classes of similarity s share no band with a probability of
   (1 - s ** WIDTH) ** BANDS, which is 0.00003 at 4/5 and falls steeply above.
   First every class is compared with the leader of each of its bands, then, in
   ROUNDS, with the partners of other groups whose sketches agree most: that
   joins large groups in proportion to their size.  What then shares a band
   without being joined is compared within the band's task, pair by pair, if the
   sketches agree in LIKELY or more of their places: the whole sets of such
   classes go to that task, which returns no more links than join its groups.
   Members of a band that are joined already are never compared, so a group of
   copies costs its size, not its square; comparisons, but no rows, are quadratic
   in the classes that share a band and yet are not similar.
4. Links are joined to components.

Sketches and ids move; texts are read once more, for the classes that share a
band, by a join that broadcasts keys only while they are at most KEYS.

Defined results.  Null or word-less texts have an empty set and are alike; of
fewer words than a shingle has, all words are one.  A component is named by its
smallest class.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each_bytes, hot_keys, materialize, skew_join, small_join
from .components import connected_components
from .ngram_exchange import mix, pack, unpack
from .simhash import link_classes, majority, shingle_hashes

SHINGLE, RADIUS = 5, 3
BANDS, WIDTH = 20, 4
#: Further minima of a sketch, a byte each, and the share of all that has to agree.
MORE, LIKELY = 160, 0.7
#: Rounds in which each class is compared with its BEST likeliest partners of other groups in each band.
ROUNDS, BEST = 2, 1
#: Classes of one band that a task compares at a time, and rows of a shard of bands.
CELL, SHARD = 4096, 1 << 17
#: Bytes of sets and sketches of a shard where whole sets are compared.
SHARD_BYTES = 32 << 20
#: Shingle hashes are compared by so many bits.
BITS = 40
_DRAWN = np.random.default_rng(20).integers(0, 1 << 31, (2, BANDS * WIDTH + MORE), dtype=np.uint32)
FACTORS, TERMS = _DRAWN[0] * np.uint32(2) + np.uint32(1), _DRAWN[1]


def overlap(a, b):
    """The least overlap of sets of a and b members at a similarity of 4/5."""
    return -(-4 * (a + b) // 9)


def sketch(distinct: np.ndarray) -> bytes:
    """The minima of a set of hashes under many orders: those of the bands, then the last bytes of MORE others."""
    folded = (distinct ^ (distinct >> np.uint64(32))).astype(np.uint32)
    out = np.full(len(FACTORS), 2**32 - 1, np.uint32)
    with np.errstate(over="ignore"):
        for k in range(0, len(folded), 512):
            np.minimum(out, (folded[k : k + 512, None] * FACTORS + TERMS).min(axis=0), out=out)
    return out[: BANDS * WIDTH].tobytes() + out[BANDS * WIDTH :].astype(np.uint8).tobytes()


def minima(column) -> tuple[np.ndarray, np.ndarray]:
    """The minima of the bands and the further ones, a row for each sketch of an Arrow column."""
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), BANDS * WIDTH * 4 + MORE)
    return np.ascontiguousarray(raw[:, : BANDS * WIDTH * 4]).view("<u4"), raw[:, BANDS * WIDTH * 4 :]


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """One hash for each band of each row of ``sketches``."""
    cells = sketches.reshape(len(sketches), BANDS, WIDTH).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), cells.shape[:2])
    for k in range(WIDTH):
        key = mix(key, cells[:, :, k])
    return key.view(np.int64)


def describe(docs: DataFrame, keep: list[str], text_col: str, shingle: int) -> DataFrame:
    """``keep`` columns, the class of each text, its size, fingerprint and sketch."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            found = []
            for text in each_bytes(batch, text_col):
                hashes = shingle_hashes(text, shingle)
                distinct = np.unique(hashes)
                node = np.uint64(xxhash.xxh64_intdigest(distinct.tobytes(), 7)).view(np.int64)
                found.append((int(node), len(distinct), int(np.uint64(majority(hashes)).view(np.int64)), sketch(distinct)))
            cols = list(zip(*found, strict=True)) or [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[*keep, "node", "n", "fp", "sketch"])

    kept = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(run, kept + "node bigint, n bigint, fp bigint, sketch binary")


def shared_bands(classes: DataFrame) -> DataFrame:
    """(h, node) of the bands that several classes share."""

    def explode(batches):
        import pyarrow as pa

        for batch in batches:
            raw, _ = minima(batch.column("sketch"))
            node = np.repeat(batch.column("node").to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(band_keys(raw).ravel()), pa.array(node)], names=["h", "node"])

    bands = materialize(classes.filter("n > 0").select("node", "sketch").mapInArrow(explode, "h bigint, node bigint"), "bands")
    several = bands.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("h")
    return materialize(skew_join(bands, several, "h"), "shared")


def leaders(met: DataFrame) -> DataFrame:
    """Pairs (u, v) of each class and the leader of a band it is in."""
    rank = F.struct(F.xxhash64("node").alias("rank"), "node")
    first = met.groupBy("h").agg(F.min(rank)["node"].alias("v"))
    pairs = skew_join(met, first, "h").filter("node != v").select(F.greatest("node", "v").alias("u"), F.least("node", "v").alias("v")).distinct()
    return pairs


def joined(links: DataFrame) -> DataFrame:
    """(node, grp): groups of classes that are surely of one component, by two rounds of smallest neighbours."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("grp"))
    least = materialize(least, "least")
    near = skew_join(both, least.withColumnRenamed("u", "v"), "v")
    again = near.groupBy("u").agg(F.min("grp").alias("g2"))
    return materialize(least.join(again, "u").select(F.col("u").alias("node"), F.least("grp", "g2").alias("grp")), "groups")


def cells(met: DataFrame, groups: DataFrame, sketches: DataFrame) -> DataFrame:
    """(h, node, grp, own, cell, sketch) of the bands with classes of several groups, cut into cells where all pairs of these meet once."""
    # a class is in BANDS bands at most, so no node is hot here
    rows = met.join(groups, "node", "left").withColumn("grp", F.coalesce("grp", "node"))
    rows = materialize(rows.select("h", "node", "grp"), "grouped")
    sizes = rows.groupBy("h", "grp").agg(F.count(F.lit(1)).alias("c"))
    main = sizes.groupBy("h").agg(F.max_by("grp", F.struct("c", "grp")).alias("main"), F.sum("c").alias("c"), F.count(F.lit(1)).alias("groups")).filter("groups > 1")
    many = F.ceil(F.col("c") / CELL).cast("int")
    rows = skew_join(rows, main.select("h", "main", many.alias("cells")), "h").withColumn("own", F.col("grp") == F.col("main"))
    # a band's largest group is dealt over its cells, the rest visits each of them
    place = F.when(F.col("own"), F.array(F.pmod(F.xxhash64("node"), F.col("cells")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("cells") - 1))
    rows = rows.select("h", "node", "grp", "own", F.explode(place).alias("cell"))
    return materialize(rows.join(sketches, "node"), "cells")


def likely(table, once: bool = False):
    """Of each cell's strangers, (place, places, shares): the row, those rows of other groups whose sketches agree enough, and how far.

    ``once``: pairs that share several bands in the first of them only.
    """
    h, cell, grp = (table.column(c).to_numpy() for c in ("h", "cell", "grp"))
    own = table.column("own").to_numpy(zero_copy_only=False).astype(bool)
    first, more = minima(table.column("sketch"))
    bands = band_keys(first)
    band = (bands == h[:, None]).argmax(axis=1)
    order = np.lexsort((own, cell, h))
    starts = np.flatnonzero(np.r_[True, (h[order][1:] != h[order][:-1]) | (cell[order][1:] != cell[order][:-1])])
    for a, b in zip(starts, np.r_[starts[1:], len(h)], strict=True):
        mine = order[a:b]
        strangers = mine[~own[mine]]
        for k, i in enumerate(strangers):
            # strangers meet each other in the first cell alone
            others = np.r_[strangers[k + 1 :], mine[len(strangers) :]] if cell[i] == 0 else mine[len(strangers) :]
            others = others[grp[others] != grp[i]]
            alike = ((first[others] == first[i]).sum(axis=1) + (more[others] == more[i]).sum(axis=1)) / len(FACTORS)
            others, alike = others[alike >= LIKELY], alike[alike >= LIKELY]
            if once and len(others):
                here = (bands[others] == bands[i]).argmax(axis=1) == band[i]
                others, alike = others[here], alike[here]
            if len(others):
                yield i, others, alike


def unjoined(met: DataFrame, groups: DataFrame, sketches: DataFrame, best: int) -> DataFrame:
    """Pairs (u, v) that share a band, are of different groups and have sketches that agree enough; of each class outside a band's largest group the ``best`` pairs a band."""
    rows = cells(met, groups, sketches)
    shards = max(1, rows.count() // SHARD)

    def search(table):
        import pyarrow as pa

        node, out = table.column("node").to_numpy(), []
        for i, others, alike in likely(table):
            if len(others) > best:
                others = others[np.argpartition(-alike, best - 1)[:best]]
            out.append(np.stack([np.full(len(others), node[i]), node[others]]))
        u, v = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
        return pa.table({"u": pa.array(np.maximum(u, v)), "v": pa.array(np.minimum(u, v))})

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("h", "cell"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(search, "u bigint, v bigint").distinct()


def rest(met: DataFrame, groups: DataFrame, sketches: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v) between groups that share a band: whole sets of all likely pairs are compared, and of each cell as many links stay as join its groups."""
    rows = cells(met, groups, sketches)
    shards = max(1, rows.count() // SHARD)
    shard = lambda df, n: df.withColumn("shard", F.pmod(F.xxhash64("h", "cell"), F.lit(n)))

    def find(table):
        """The rows that are in a likely pair."""
        asked = np.zeros(len(table), bool)
        for i, others, _ in likely(table, once=True):
            asked[i] = asked[others] = True
        return table.drop_columns(["shard"]).take(np.flatnonzero(asked))

    def compare(table):
        import pyarrow as pa

        node, grp, packed = table.column("node").to_numpy(), table.column("grp").to_numpy(), table.column("s")
        unpacked, root, out = {}, {}, []

        def whole(i):
            if node[i] not in unpacked:
                unpacked[node[i]] = unpack(packed[int(i)].as_py())
            return unpacked[node[i]]

        def named(g):
            while (up := root.get(g, g)) != g:
                root[g] = root.get(up, up)
                g = up
            return g

        for i, others, _ in likely(table, once=True):
            a = whole(i)
            for j in others:
                x, y = named(grp[i]), named(grp[j])
                if x == y:
                    continue
                b = whole(j)
                if len(np.intersect1d(a, b, assume_unique=True)) >= overlap(len(a), len(b)):
                    root[max(x, y)] = min(x, y)
                    out.append((max(node[i], node[j]), min(node[i], node[j])))
        u, v = zip(*out, strict=True) if out else ((), ())
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    found = shard(rows, shards).groupBy("shard").applyInArrow(find, rows.schema)
    found = materialize(found.join(sets, "node"), "compared")
    n, size = found.agg(F.count(F.lit(1)), F.sum(F.octet_length("s") + F.octet_length("sketch"))).first()
    shards = max(1, n // SHARD, int(size or 0) // SHARD_BYTES)
    return materialize(shard(found, shards).groupBy("shard").applyInArrow(compare, "u bigint, v bigint").distinct(), "links")


def shingle_sets(docs: DataFrame, wanted: DataFrame, key: list[str], text_col: str, shingle: int) -> DataFrame:
    """(node, s): packed sets of the classes in ``wanted`` (key, node)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            packed = [pack(np.unique(shingle_hashes(t, shingle) >> np.uint64(64 - BITS))) for t in each_bytes(batch, text_col)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(packed, pa.binary())], names=["node", "s"])

    texts = small_join(docs.select(*key, text_col), wanted, key).select("node", text_col)
    return materialize(texts.mapInArrow(run, "node bigint, s binary").dropDuplicates(["node"]), "sets")


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose whole sets are similar."""
    pairs = materialize(pairs, "candidates")
    side = lambda c: sets.select(F.col("node").alias(c), F.col("s").alias(f"s{c}"))

    def check(batches):
        import pyarrow as pa

        for batch in batches:
            sides = (map(unpack, (s.as_py() for s in batch.column(c))) for c in ("su", "sv"))
            ok = [len(np.intersect1d(a, b, assume_unique=True)) >= overlap(len(a), len(b)) for a, b in zip(*sides, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))

    both = skew_join(skew_join(pairs, side("u"), "u", hot=hot_keys(pairs, "u")), side("v"), "v", hot=hot_keys(pairs, "v"))
    return materialize(both.select("u", "v", "su", "sv").mapInArrow(check, "u bigint, v bigint"), "links")


def components(docs: DataFrame, *, key: list[str], keep: list[str], text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(key, keep, node, root) for each row of ``docs``: node names the row's set of shingles, root its component.

    ``key``: non-null columns; rows of equal keys have equal texts.
    """
    rows = materialize(describe(docs, [*key, *keep], text_col, shingle), "shingles")
    firsts = [F.first(c).alias(c) for c in ("n", "fp", "sketch")]
    classes = rows.groupBy("node").agg(F.min(F.struct(*key)).alias("key"), *firsts).select("node", "key.*", "n", "fp", "sketch")
    classes = materialize(classes, "classes")
    close = link_classes(classes.filter("n > 0").select("node", "fp"), RADIUS).filter("node != root")
    close = materialize(close.select(F.greatest("node", "root").alias("u"), F.least("node", "root").alias("v")), "close")
    met = shared_bands(classes)
    nodes = met.select("node").unionByName(close.select(F.explode(F.array("u", "v")).alias("node"))).distinct()
    wanted = materialize(classes.join(nodes, "node", "left_semi").select("node", *key), "wanted")
    sets = shingle_sets(docs, wanted, key, text_col, shingle)
    links = similar(close.unionByName(leaders(met)).distinct(), sets)
    sketches = classes.select("node", "sketch")
    for _ in range(ROUNDS):
        links = links.unionByName(similar(unjoined(met, joined(links), sketches, BEST), sets))
    groups = materialize(connected_components(links).select("node", F.col("component").alias("grp")), "components")
    links = links.unionByName(rest(met, groups, sketches, sets))
    roots = connected_components(links).select("node", F.col("component").alias("root"))
    named = classes.select("node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return skew_join(rows.select(*key, *keep, "node"), named, "node")
