"""Quality classifier: interpolated modified Kneser-Ney trigram models of trusted text.

Trusted documents are those labelled of good quality and not toxic.  All of
them train and all of them set the thresholds, by cross-fitting: documents are
halved by a hash of the id, the trusted ones of each half make a model, and
every document, trusted or not, is scored by the model of the other half.  A
document is rejected when its perplexity is above the QUANTILE of its
language's trusted documents, times MARGIN.  Languages with under MIN_HELD
trusted documents use the quantile of all languages.

Counts lie in hash shards and scoring joins the documents' trigrams to them:

1. Each chunk of trusted documents sends its distinct trigrams uvw with their
   counts to the shard of the middle word v.  There, c(uvw), the totals of uv,
   the distinct u before vw and what follows from them are complete.  A hot v is
   dealt over several shards by u; its counts of vw are added up apart and go
   back to those shards.  A sample of rows says which words are hot; it shapes
   the layout alone, results are the same for any list.
2. Counts of the distinct v before w are added up by w.  This table of the
   trusted texts' words is all that the driver collects and broadcasts; it grows
   with the vocabulary, which is the operator's limit of scale.
3. Chunks of all documents send their trigrams the same way, each shard returns
   the sum of log probabilities for each of a chunk's documents, and these are
   added up.  Large corpora go through in SLICES, one after the other, so that
   only a part of the trigrams lies on disk at a time: a part's exchanges go as
   soon as its perplexities are written.

Defined results.  Null or word-less text has perplexity null and is kept.
Null language is a language of its own.  Without trusted documents nothing is
rejected.  Repeated rows are scored alike; repeated labels count once.  An
empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import brief_exchanges, column_bytes, materialize, slices, small_join
from .ngram_exchange import CHUNK_BYTES, Chunk, mix, narrow, pack, pack_bytes, unpack, unpack_bytes

QUANTILE, MARGIN, MIN_HELD = 0.995, 1.1, 50
#: Perplexities are compared by bins of their logarithm, so many to a unit.
BINS = 1000
#: Text bytes of the corpus for each hash shard; above SLICED text bytes documents are scored in SLICES parts.
SHARD_BYTES, SLICED, SLICES = 24 << 20, 64 << 20, 6
#: About so many rows are read for the hot words, of which at most so many are kept.
HOT_SAMPLE, HOT_WORDS = 20_000, 2048
#: Hash of all words that no trusted text has.
UNKNOWN = np.uint64(1)
#: Kinds of messages: trigrams of a chunk or a shard, successors of a hot word in one shard and in all,
#: words with the distinct words before them, counts of counts, and a chunk's own columns.
GRAMS, PART, HOT, WORDS, TIMES, CONTENT = range(6)
WIRE = "shard int, kind int, name string, vocab binary, u binary, v binary, w binary, c binary, more binary"
NAMES = ["shard", "kind", "name", "vocab", "u", "v", "w", "c", "more"]


def _batch(rows: list[tuple]):
    import pyarrow as pa

    kinds = [pa.int32(), pa.int32(), pa.string(), *[pa.binary()] * 6]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=NAMES)


def _table(rows: list[tuple]):
    import pyarrow as pa

    return pa.Table.from_batches([_batch(rows)])


def word_ids(chunk: Chunk, known: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ascending hashes of the chunk's words, and for every word its two predecessors' and its own place in them.

    Hash 0 stands before a document's first word; all words outside ``known``, if given, are UNKNOWN.
    """
    table = np.append(chunk.hashes, np.uint64(0))
    if known is not None:
        table = np.where(known[np.minimum(np.searchsorted(known, table), len(known) - 1)] == table, table, UNKNOWN)
    table, rank = np.unique(table, return_inverse=True)
    w = rank[chunk.ids]
    back = []
    for k in (2, 1):
        x = np.full(len(w), rank[-1])
        x[k:] = np.where(chunk.doc[k:] == chunk.doc[:-k], w[:-k], rank[-1])
        back.append(x)
    return table, back[0], back[1], w


def homes(hashes: np.ndarray, shards: int) -> np.ndarray:
    """The (first) shard of each word as the middle of a trigram."""
    return (mix(hashes, np.uint64(0)) % np.uint64(shards)).astype(np.int64)


def places(table: np.ndarray, u: np.ndarray, v: np.ndarray, shards: int, hot: dict[int, int]) -> np.ndarray:
    """The shard of each trigram; ``hot``: over how many shards a word's trigrams are dealt.  Behind an unknown word any shard will do."""
    out = homes(table, shards)[v]
    strange = np.flatnonzero(table[v] == UNKNOWN)
    out[strange] = strange * shards // max(len(v), 1)
    if hot:
        spread = np.array([hot.get(h, 1) for h in table.tolist()])[v]
        many = spread > 1
        out[many] = (out[many] + (mix(table[u[many]], np.uint64(1)) % spread[many].astype(np.uint64)).astype(np.int64)) % shards
    return out


def local(table: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The part of ``table`` that the columns use, words of about equal counts together and frequent ones first, and their places in it.

    Small numbers for frequent words make most high bytes zero, which compress to nearly nothing.
    """
    n = sum(np.bincount(x, minlength=len(table)) for x in columns)
    used = np.flatnonzero(n)
    order = used[np.argsort(-np.frexp(n[used])[1], kind="stable")]
    at = np.empty(len(table), np.int64)
    at[order] = np.arange(len(order))
    return table[order], [at[x] for x in columns]


def added(n: int, f: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
    """Distinct (f, u, v, w) in the order of f, v, u, w, and the sums of their counts; words are below ``n``."""
    context = np.unique((f * n + v) * n + u, return_inverse=True)[1]
    code = context * n + w
    order = np.argsort(code, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(code[order]) != 0]) if len(code) else np.zeros(0, np.int64)
    at = order[first]
    return [f[at], u[at], v[at], w[at], np.add.reduceat(c[order], first) if len(code) else c]


def _grams(shard: int, name: str | None, vocab, f, u, v, w, c) -> tuple:
    """``vocab``: hashes of words, or their places among the known ones where a chunk has a name."""
    return (shard, GRAMS, name, pack(vocab), *(pack_bytes(narrow(x)) for x in (u, v, w, c)), pack_bytes(f.astype(np.uint8)))


def _messages(text_col: str, fold_col: str, shards: int, hot: dict[int, int], keep: list[str] | None = None, held=None):
    """Each chunk's trigrams by shard: with ``keep``, one for each word and its document, then those columns; without, distinct ones with counts."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        known = held.value["words"] if held else None
        for batch in batches:
            texts, folds = column_bytes(batch, text_col), batch.column(fold_col).to_numpy().astype(np.int64)
            for a, b in slices([len(t) for t in texts], CHUNK_BYTES):
                chunk, name = Chunk(texts[a:b]), f"{task}.{number}"
                number += 1
                table, *words = word_ids(chunk, known)
                shard = places(table, words[0], words[1], shards, hot)
                order = np.argsort(shard, kind="stable")
                cuts = np.searchsorted(shard[order], np.arange(shards + 1))
                for s in range(shards):
                    mine = order[cuts[s] : cuts[s + 1]]
                    if not len(mine):
                        continue
                    vocab, (u, v, w) = local(table, *(x[mine] for x in words))
                    doc = chunk.doc[mine].astype(np.int64)
                    if keep is None:
                        f, u, v, w, c = added(len(vocab), folds[a:b][doc], u, v, w, np.ones(len(mine), np.int64))
                    else:
                        f, c = folds[a:b][doc], np.diff(doc, prepend=0)
                        vocab = np.searchsorted(known, vocab).astype(np.uint64)
                    yield _batch([_grams(s, None if keep is None else name, vocab, f, u, v, w, c)])
                if keep is not None:
                    own = pa.RecordBatch.from_arrays([batch.column(c).slice(a, b - a) for c in keep], names=keep)
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, own.schema) as out:
                        out.write_batch(own)
                    yield _batch([((task + number) % shards, CONTENT, name, None, None, None, None, pack_bytes(narrow(chunk.lengths)), sink.getvalue().to_pybytes())])

    return run


def _gather(rows: dict[str, list], vocabs: dict[int, np.ndarray], vocab: np.ndarray) -> list[np.ndarray]:
    """Columns f, u, v, w, c of the messages that ``vocabs`` has the words of, by their places in ``vocab``."""
    out = []
    for i, words in vocabs.items():
        at = np.searchsorted(vocab, words)
        out.append([unpack_bytes(rows["more"][i]).astype(np.int64), *(at[unpack_bytes(rows[c][i])] for c in ("u", "v", "w")), unpack_bytes(rows["c"][i]).astype(np.int64)])
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5


def _times(fold: int, level: int, c: np.ndarray) -> tuple:
    """How many counts are 1, 2, 3 and 4."""
    return (0, TIMES, None, None, None, None, None, None, np.array([fold, level, *((c == k).sum() for k in (1, 2, 3, 4))], np.int64).tobytes())


def _by_word(fold: int, hashes: np.ndarray, n: np.ndarray, shards: int) -> list[tuple]:
    """Words with counts, cut into as many parts as there are shards."""
    part, out = homes(hashes, shards), []
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(shards + 1))
    for s in range(shards):
        at = np.sort(order[cuts[s] : cuts[s + 1]])
        if len(at):
            out.append((s, WORDS, f"{fold}.{s}", pack(hashes[at]), None, None, None, pack_bytes(narrow(n[at])), None))
    return out


def _count(shards: int, hot: dict[int, int]):
    """A shard's trigrams added up, and what the other levels need of them."""

    def run(table):
        rows = table.to_pydict()
        shard, vocabs = rows["shard"][0], dict(enumerate(map(unpack, rows["vocab"])))
        vocab = np.unique(np.concatenate(list(vocabs.values())))
        n = len(vocab)
        f, u, v, w, c = added(n, *_gather(rows, vocabs, vocab))
        is_hot = np.array([h in hot for h in vocab.tolist()])
        short, (lu, lv, lw) = local(vocab, u, v, w)
        out = [_grams(shard, None, short, f, lu, lv, lw, c)]
        for fold in np.unique(f).tolist():
            own = f == fold
            out.append(_times(fold, 3, c[own]))
            pairs, c2 = np.unique(v[own] * n + w[own], return_counts=True)
            first, last = pairs // n, pairs % n
            whole = ~is_hot[first]
            out.append(_times(fold, 2, c2[whole]))
            ends, c1 = np.unique(last[whole], return_counts=True)
            out += _by_word(fold, vocab[ends], c1, shards)
            for x in np.unique(first[~whole]).tolist():
                at = first == x
                out.append((shard, PART, f"{fold}.{vocab[x]}", pack(vocab[last[at]]), None, None, None, pack_bytes(narrow(c2[at])), None))
        return _table(out)

    return run


def _sum(rows: dict[str, list]) -> tuple[np.ndarray, np.ndarray]:
    hashes, at = np.unique(np.concatenate([unpack(x) for x in rows["vocab"]]), return_inverse=True)
    counts = np.concatenate([unpack_bytes(x) for x in rows["c"]]).astype(np.int64)
    total = np.zeros(len(hashes), np.int64)
    np.add.at(total, at, counts)
    return hashes, total


def _successors(shards: int, hot: dict[int, int]):
    """All successors of a hot word, for each of its shards, and what the unigrams need of them."""

    def run(table):
        rows = table.to_pydict()
        fold, v = map(int, rows["name"][0].split("."))
        hashes, n = _sum(rows)
        packed = pack(hashes), None, None, None, pack_bytes(narrow(n)), None
        home = int(homes(np.array([v], np.uint64), shards)[0])
        out = [((home + k) % shards, HOT, rows["name"][0], *packed) for k in range(hot[v])]
        return _table([*out, _times(fold, 2, n), *_by_word(fold, hashes, np.ones(len(n), np.int64), shards)])

    return run


def _words(table):
    rows = table.to_pydict()
    hashes, n = _sum(rows)
    return _table([(0, WORDS, rows["name"][0], pack(hashes), None, None, None, pack_bytes(narrow(n)), None)])


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of one, two, and three or more."""
    if not n1 or not n2:
        return (0.5, 0.75, 0.9)
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3 if n3 else 1.5)))


def fit(train: DataFrame, text_col: str = "text", fold_col: str | None = None, *, shards: int = 1, hot: dict[int, int] | None = None) -> dict:
    """Trigram counts by shard for the model that ``fold_col`` (0 or 1) names, successors of hot words and counts of words."""
    hot = hot or {}
    fold = F.col(fold_col) if fold_col else F.lit(0)
    sent = train.select(fold.cast("int").alias("fold"), F.col(text_col).alias("text")).mapInArrow(_messages("text", "fold", shards, hot), WIRE)
    with brief_exchanges(train.sparkSession):
        counts = materialize(sent.groupBy("shard").applyInArrow(_count(shards, hot), WIRE), "counts")
        if hot:
            found = counts.filter(F.col("kind") == PART).groupBy("name").applyInArrow(_successors(shards, hot), WIRE)
            counts = counts.filter(F.col("kind") != PART).unionByName(materialize(found, "successors"))
    return {"counts": counts, "shards": shards, "hot": hot}


def collect_model(fitted: dict) -> dict:
    """The same with the discounts of both upper levels and the words' probabilities, on which every shard depends, broadcast."""
    counts = fitted["counts"]
    times = np.zeros((2, 4, 4), np.int64)
    for r in counts.filter(F.col("kind") == TIMES).select("more").collect():
        fold, level, *n = np.frombuffer(r[0], np.int64).tolist()
        times[fold, level] += n
    with brief_exchanges(counts.sparkSession):
        found = counts.filter(F.col("kind") == WORDS).groupBy("name").applyInArrow(_words, WIRE).select("name", "vocab", "c").toArrow().to_pylist()
    by_fold = []
    for fold in (0, 1):
        mine = [r for r in found if r["name"].startswith(f"{fold}.")]
        words = np.concatenate([unpack(r["vocab"]) for r in mine]) if mine else np.zeros(0, np.uint64)
        c = np.concatenate([unpack_bytes(r["c"]).astype(np.int64) for r in mine]) if mine else np.zeros(0, np.int64)
        cut = np.array(discounts(*(int((c == k).sum()) for k in (1, 2, 3, 4))))[np.minimum(c, 3) - 1]
        # the probability mass of unseen words is shared by as many words as were seen
        even = float(cut.sum() / c.sum() / (2 * len(c))) if len(c) else 1e-9
        by_fold.append((words, (c - cut) / max(c.sum(), 1), even))
    known = np.unique(np.concatenate([np.array([0, UNKNOWN], np.uint64), *(x[0] for x in by_fold)]))
    small = {"words": known, "p1": [], "cuts": [[discounts(*times[fold, level].tolist()) for level in (2, 3)] for fold in (0, 1)]}
    for words, share, even in by_fold:
        p1 = np.full(len(known), even, np.float32)
        p1[np.searchsorted(known, words)] += share.astype(np.float32)
        small["p1"].append(p1)
    return fitted | {"small": counts.sparkSession.sparkContext.broadcast(small)}


def look_up(keys: np.ndarray, values: np.ndarray, asked: np.ndarray, missing: float) -> np.ndarray:
    """Values by ascending distinct keys."""
    if not len(keys):
        return np.full(len(asked), missing)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], missing)


def log_probabilities(n: int, grams: list[np.ndarray], seen: list[np.ndarray], p1: np.ndarray, cuts: list[tuple]) -> np.ndarray:
    """Of trigrams ``grams`` (u, v, w), given counted ones (u, v, w, c) and bigrams ``seen`` (v, w, c); words are below ``n``."""
    (u, v, w), (tu, tv, tw, tc), (bv, bw, bc) = grams, seen[:4], seen[4:]
    cut = np.array(cuts[0])[np.minimum(bc, 3) - 1]
    total = np.bincount(bv, bc, n)
    order = np.argsort(bv * n + bw)
    left = np.where(total > 0, np.bincount(bv, cut, n) / np.maximum(total, 1), 1.0)
    p = look_up((bv * n + bw)[order], ((bc - cut) / total[bv])[order], v * n + w, 0.0) + left[v] * p1[w]
    cut = np.array(cuts[1])[np.minimum(tc, 3) - 1]
    contexts, inverse = np.unique(tv * n + tu, return_inverse=True)
    total = np.bincount(inverse, tc, len(contexts))
    left = np.append(np.bincount(inverse, cut, len(contexts)) / np.maximum(total, 1), 1.0)
    # a context that isn't there has the number behind the last one, and no trigram
    at = look_up(contexts, np.arange(len(contexts)), v * n + u, len(contexts)).astype(np.int64)
    order = np.argsort(inverse * n + tw)
    p = look_up((inverse * n + tw)[order], ((tc - cut) / total[inverse])[order], at * n + w, 0.0) + left[at] * p
    return np.log(np.maximum(p, 1e-30))


def _score(hot: dict[int, int], held):
    """A shard's sums of log probabilities for each document of each chunk."""

    def run(table):
        rows = table.to_pydict()
        of = lambda kind, named: [i for i, k in enumerate(rows["kind"]) if k == kind and (rows["name"][i] is not None) == named]
        out, asked = [tuple(rows[c][i] for c in NAMES) for i in of(CONTENT, True)], of(GRAMS, True)
        if not asked:
            return _table(out)
        trained, successors = of(GRAMS, False), of(HOT, True)
        small = held.value
        vocabs = {i: small["words"][unpack(rows["vocab"][i])] for i in asked} | {i: unpack(rows["vocab"][i]) for i in [*trained, *successors]}
        vocab = np.unique(np.concatenate(list(vocabs.values())))
        n, is_hot = len(vocab), np.array([h in hot for h in vocab.tolist()])
        model, found = _gather(rows, {i: vocabs[i] for i in trained}, vocab), _gather(rows, {i: vocabs[i] for i in asked}, vocab)
        logs = np.zeros(len(found[0]))
        for fold in (0, 1):
            mine = np.flatnonzero(found[0] == fold)
            if not len(mine):
                continue
            seen = [x[model[0] == fold] for x in model[1:]]
            pairs, c2 = np.unique(seen[1] * n + seen[2], return_counts=True)
            whole = ~is_hot[pairs // n]
            bigrams = [[(pairs // n)[whole], (pairs % n)[whole], c2[whole]]]
            for i in successors:
                f, v = map(int, rows["name"][i].split("."))
                at = int(np.searchsorted(vocab, np.uint64(v)))
                if f == fold and at < n and vocab[at] == v:
                    last = np.searchsorted(vocab, vocabs[i])
                    bigrams.append([np.full(len(last), at), last, unpack_bytes(rows["c"][i]).astype(np.int64)])
            p1 = small["p1"][fold][np.searchsorted(small["words"], vocab)]
            seen += [np.concatenate(x) for x in zip(*bigrams, strict=True)]
            del pairs, c2, whole, bigrams
            logs[mine] = log_probabilities(n, [x[mine] for x in found[1:4]], seen, p1, small["cuts"][fold])
        del model, found
        at = 0
        for i in asked:
            step = unpack_bytes(rows["c"][i]).astype(np.int64)
            doc = np.cumsum(step)
            sums = np.bincount(doc - doc[0], logs[at : at + len(doc)])
            at += len(doc)
            kept = np.unique(doc)
            out.append((rows["shard"][i], GRAMS, rows["name"][i], pack(kept.astype(np.uint64)), None, None, None, None, sums[kept - doc[0]].tobytes()))
        return _table(out)

    return run


def _finish(table):
    """A chunk's own columns, its documents' numbers of words and perplexities."""
    import pyarrow as pa

    rows = table.to_pydict()
    at = rows["kind"].index(CONTENT)
    n = unpack_bytes(rows["c"][at]).astype(np.int64)
    sums = np.zeros(len(n))
    for _, i in sorted((rows["shard"][i], i) for i, k in enumerate(rows["kind"]) if k == GRAMS):
        sums[unpack(rows["vocab"][i]).astype(np.int64)] += np.frombuffer(rows["more"][i])
    with pa.ipc.open_stream(rows["more"][at]) as r:
        own = r.read_all().combine_chunks()
    perplexity = np.exp(np.minimum(-sums / np.maximum(n, 1), 700.0))
    return own.append_column("n_words", pa.array(n)).append_column("perplexity", pa.array(perplexity, mask=n == 0))


def score(docs: DataFrame, model: dict, *, keep: list[str], text_col: str = "text", fold_col: str | None = None) -> DataFrame:
    """``keep`` columns plus n_words and perplexity by the model that ``fold_col`` (0 or 1) names."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    fold = F.col(fold_col) if fold_col else F.lit(0)
    sent = docs.select(*keep, fold.cast("int").alias("__fold"), F.col(text_col).alias("__text"))
    sent = sent.mapInArrow(_messages("__text", "__fold", model["shards"], model["hot"], keep, model["small"]), WIRE)
    counts = model["counts"].filter(F.col("kind").isin(GRAMS, HOT))
    summed = sent.unionByName(counts).groupBy("shard").applyInArrow(_score(model["hot"], model["small"]), WIRE)
    return summed.filter("name is not null").groupBy("name").applyInArrow(_finish, f"{schema}, n_words bigint, perplexity double")


def hot_words(docs: DataFrame, rows: int, shards: int) -> dict[int, int]:
    """Words of over half a shard's share of the words, and over how many shards each is dealt; from about HOT_SAMPLE rows."""
    least = max(1 / (2 * shards), 1 / HOT_WORDS)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = column_bytes(batch, "text")
            for a, b in slices([len(t) for t in texts], CHUNK_BYTES):
                chunk = Chunk(texts[a:b])
                n = np.bincount(chunk.ids, minlength=len(chunk.hashes))
                often = np.flatnonzero(n > len(chunk.ids) * least / 4)
                hashes, counts = np.append(chunk.hashes[often], np.uint64(0)), np.append(n[often], len(chunk.ids))
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(counts)], names=["h", "n"])

    read = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit("layout")), F.lit(max(1, rows // HOT_SAMPLE))) == 0).select("text")
    n = dict(read.mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n")).collect()) if shards > 1 else {}
    total = n.pop(0, 0)
    return {h: min(shards, int(2 * shards * c / total) + 1) for h, c in n.items() if c > total * least}


def classify(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    train_docs: int | None = None,
    quantile: float = QUANTILE,
    margin: float = MARGIN,
) -> DataFrame:
    """(doc_id, lang, n_words, perplexity, threshold, kept) for each row of ``docs``; ``train_docs``: only so many trusted documents train, all where it is None."""
    trusted = labels.filter("quality = 1 and toxic = 0 and doc_id is not null").select(F.col("doc_id").cast(docs.schema[id_col].dataType).alias("doc_id")).distinct()
    trusted = materialize(trusted, "trusted")
    key = F.xxhash64(F.col("doc_id").cast("string"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.withColumn("half", F.pmod(key, F.lit(2)).cast("int"))
    many, size = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    shards = max(1, -(-int(size or 0) // SHARD_BYTES))
    train = trusted if train_docs is None else materialize(trusted.orderBy(key, "doc_id").limit(train_docs), "train")
    # each half trains the model that scores the other
    chosen = small_join(rows, train, ["doc_id"], "left_semi").withColumn("fold", 1 - F.col("half"))
    model = collect_model(fit(chosen, fold_col="fold", shards=shards, hot=hot_words(rows, many, shards)))
    parts = SLICES if int(size or 0) > SLICED else 1
    scored = None
    for k in range(parts):
        part = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit("slice")), F.lit(parts)) == k)
        with brief_exchanges(docs.sparkSession):
            done = materialize(score(part, model, keep=["doc_id", "lang"], fold_col="half"), "perplexity")
        scored = done if scored is None else scored.unionByName(done)
    scored = scored.withColumn("bin", F.ceil(F.log("perplexity") * BINS))
    counts = scored.filter("bin is not null").join(trusted, "doc_id", "left_semi")
    counts = counts.select(F.explode(F.array(F.lit("*"), F.concat(F.lit("="), F.coalesce("lang", F.lit("\x00"))))).alias("l"), "bin").groupBy("l", "bin").agg(F.count(F.lit(1)).alias("n"))
    run = counts.withColumn("c", F.sum("n").over(Window.partitionBy("l").orderBy("bin"))).withColumn("t", F.sum("n").over(Window.partitionBy("l")))
    bars = materialize(run.filter((F.col("c") >= F.col("t") * quantile) & ((F.col("t") >= MIN_HELD) | (F.col("l") == "*"))).groupBy("l").agg(F.min("bin").alias("bar")), "bars")
    every = bars.filter("l = '*'").first()
    # one row per language of at least MIN_HELD trusted documents
    joined = scored.withColumn("l", F.concat(F.lit("="), F.coalesce("lang", F.lit("\x00")))).join(F.broadcast(bars), "l", "left")
    bar = F.coalesce("bar", F.lit(every[1] if every else None).cast("bigint"))
    threshold = F.exp(bar / BINS) * margin
    return joined.select("doc_id", "lang", "n_words", "perplexity", threshold.alias("threshold"), F.coalesce(F.col("perplexity") <= threshold, F.lit(True)).alias("kept"))
