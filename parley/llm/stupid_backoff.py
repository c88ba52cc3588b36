"""Stupid-backoff scores: hash-partitioned n-gram counts joined to exploded n-grams.

Every document is scored against the counts of all other documents: a word
costs log(c(uvw) / c(uv)) if the trigram occurs elsewhere, else log 0.4 plus
the same for the bigram, else log 0.16 plus log(c(w) / N), and a word that
occurs nowhere else costs log 0.16 plus log(1 / N).  c(uv) and c(v) are counts
of the context as an n-gram of its own.

1. Documents are read in chunks of bounded size.  Each chunk sends the sorted
   hashes of its distinct n-grams with their counts, cut into hash shards,
   and its word sequence.  This is the map-side aggregate: however frequent an
   n-gram is, a chunk sends it once.
2. Each shard adds up its part of the count table and answers every chunk with
   the totals of the n-grams that it asked for.
3. Each chunk joins the answers with its exploded n-grams, takes off each
   document's own counts, and sums log scores per document.

The number of shards follows the corpus, so that no task holds more of the
table than about SHARD_BYTES of text brings; two exchanges in all, both by
evenly dealt keys.

Defined results.  Null or word-less text has 0 words and score 0.  A lone
document has nothing to compare with: every word costs log 0.16 (N counts as
1).  Repeated rows are documents of their own and support each other.  Null
ids pass through.  An empty table gives an empty result.  Extra columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_bytes, slices
from .ngram_exchange import BITS, CHUNK_BYTES, Chunk, narrow, pack, pack_bytes, unpack, unpack_bytes

ORDER = 3
ALPHA = 0.4
#: Text bytes of the corpus for each hash shard.
SHARD_BYTES = 24 << 20
#: ord 1..: an n-gram request or answer; 0: the chunk's words.  Unigrams are asked of every shard;
#: those answers repeat the hashes asked for and bear the shard's total of words.
WIRE = "shard int, chunk string, ord int, grams binary, counts binary, words binary, ids binary"
NAMES = ["shard", "chunk", "ord", "grams", "counts", "words", "ids"]


def _batch(rows: list[tuple]):
    import pyarrow as pa

    kinds = [pa.int32(), pa.string(), pa.int32(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=NAMES)


def _ids_to_bytes(column) -> bytes:
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([column], names=["doc_id"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _requests(id_col: str, text_col: str, order: int, shards: int):
    """Each chunk's n-grams, cut by shard, and its content, which rides along with one shard."""

    def run(batches):
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        cuts = np.array([(k << BITS) // shards for k in range(1, shards)], np.uint64)
        for batch in batches:
            texts = column_bytes(batch, text_col)
            for a, b in slices([len(t) for t in texts], CHUNK_BYTES):
                chunk, name = Chunk(texts[a:b]), f"{task}.{number}"
                number += 1
                for n in range(1, order + 1):
                    grams, counts = np.unique(chunk.grams(n)[0], return_counts=True)
                    at = np.searchsorted(grams, cuts)
                    parts = zip(np.split(grams, at), np.split(counts, at), strict=True)
                    yield _batch([(s, name, n, pack(g), pack_bytes(narrow(c)), None, None) for s, (g, c) in enumerate(parts) if len(g) or n == 1])
                rank = np.argsort(np.argsort(chunk.hashes))
                words = pack_bytes(narrow(rank[chunk.ids]))
                content = (0, None, pack_bytes(narrow(chunk.lengths)), words, _ids_to_bytes(batch.column(id_col).slice(a, b - a)))
                yield _batch([((task + number) % shards, name, *content)])

    return run


def _answer(table):
    """Totals of a shard's n-grams, in the order of each chunk's request."""
    import pyarrow as pa

    rows = table.to_pydict()
    out = []
    for n in sorted({n for n in rows["ord"] if n > 0}):
        mine = [i for i, o in enumerate(rows["ord"]) if o == n]
        asked = [unpack(rows["grams"][i]) for i in mine]
        flat = np.concatenate(asked)
        order = np.argsort(flat, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(flat[order]) != 0])) if len(flat) else np.zeros(0, np.int64)
        counts = np.concatenate([unpack_bytes(rows["counts"][i]).astype(np.int64) for i in mine])
        total = np.add.reduceat(counts[order], first) if len(flat) else counts
        words = int(counts.sum()).to_bytes(8, "little") if n == 1 else None
        repeated = [rows["grams"][i] if n == 1 else None for i in mine]
        reply = np.empty(len(flat), np.int64)
        reply[order] = np.repeat(total, np.diff(first, append=len(flat)))
        for i, part, grams in zip(mine, np.split(reply, np.cumsum([len(x) for x in asked])[:-1]), repeated, strict=True):
            out.append((rows["shard"][i], rows["chunk"][i], n, grams, pack_bytes(narrow(part)), words, None))
    out += [tuple(rows[c][i] for c in NAMES) for i, o in enumerate(rows["ord"]) if o == 0]
    return pa.Table.from_batches([_batch(out)])


def _own(inverse: np.ndarray, doc: np.ndarray, distinct: int) -> np.ndarray:
    """How often each n-gram occurs in its own document, at each of its places; ``inverse``: its number among ``distinct``."""
    key = doc * np.int64(max(distinct, 1)) + inverse
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    times = np.diff(first, append=len(key))
    out = np.empty(len(key), np.int32)
    out[order] = np.repeat(times, times)
    return out


def chunk_scores(chunk: Chunk, totals: dict[int, np.ndarray], n_total: int, order: int = ORDER, alpha: float = ALPHA) -> np.ndarray:
    """Sum of log scores of each document; ``totals``: corpus counts of the chunk's distinct n-grams in hash order."""
    words = len(chunk.ids)
    others = np.maximum(n_total - chunk.lengths, 1)
    rest, score = {}, np.full(words, math.log(alpha) * (order - 1)) - np.log(others)[chunk.doc]
    for n in range(1, order + 1):
        grams, last = chunk.grams(n)
        inverse = np.unique(grams, return_inverse=True)[1]
        del grams
        c = totals[n][inverse] - _own(inverse, chunk.doc[last], len(totals[n])) if len(last) else np.zeros(0, np.int64)
        del inverse
        rest[n] = np.zeros(words, np.int64)
        rest[n][last] = c
        if n == 1:
            found = rest[1] > 0
            score[found] += np.log(rest[1][found])
        else:
            hit = last[c > 0]
            score[hit] = math.log(alpha) * (order - n) + np.log(rest[n][hit]) - np.log(rest[n - 1][hit - 1])
    return np.bincount(chunk.doc, score, minlength=len(chunk.lengths))


def _finish(order: int):
    def run(table):
        import pyarrow as pa

        rows = table.to_pydict()
        at = rows["ord"].index(0)
        lengths = unpack_bytes(rows["counts"][at]).astype(np.int64)
        own = sorted((rows["shard"][i], i) for i, o in enumerate(rows["ord"]) if o == 1)
        hashes = np.concatenate([unpack(rows["grams"][i]) for _, i in own])
        chunk = Chunk.of_ids(unpack_bytes(rows["words"][at]).astype(np.int64), hashes, lengths)
        totals = {}
        for n in range(1, order + 1):
            mine = sorted((rows["shard"][i], i) for i, o in enumerate(rows["ord"]) if o == n)
            totals[n] = np.concatenate([unpack_bytes(rows["counts"][i]).astype(np.int64) for _, i in mine]) if mine else np.zeros(0, np.int64)
        n_total = sum(int.from_bytes(rows["words"][i], "little") for i, o in enumerate(rows["ord"]) if o == 1)
        with pa.ipc.open_stream(rows["ids"][at]) as r:
            ids = r.read_all().column(0).combine_chunks()
        return pa.table({"doc_id": ids, "n_words": pa.array(lengths), "log_score": pa.array(chunk_scores(chunk, totals, n_total, order))})

    return run


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_words, log_score) for each row of ``docs``."""
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0]
    shards = max(1, -(-int(total or 0) // shard_bytes))
    kind = docs.schema[id_col].dataType.simpleString()
    asked = docs.select(id_col, text_col).mapInArrow(_requests(id_col, text_col, order, shards), WIRE)
    answered = asked.groupBy("shard").applyInArrow(_answer, WIRE)
    return answered.groupBy("chunk").applyInArrow(_finish(order), f"doc_id {kind}, n_words bigint, log_score double")

