"""Token counts from flat token files by a separator scan.

Documents are encoded with a public byte-level BPE vocabulary (its path is a
parameter) and written as flat token files: one stream of 16-bit identifiers
for each task, an end-of-document identifier after each document, cut into
blocks of fixed length wherever that falls.  The files have no index.

The scan looks at each block alone: a vectorised search for the separator
gives the lengths that lie inside the block, the tokens before its first and
after its last separator.  A prefix scan over the blocks of a file, in two
levels so that no task holds a whole file's blocks, gives the number of
documents before each block and the tokens carried into it, which completes
the document that its first separator ends.

Defined results.  Null or empty text has 0 tokens.  The separator can't occur
in a text: no text encodes to it.  Repeated rows are counted each.  Null ids
pass through.  An empty table gives an empty result.  Extra columns are
ignored.
"""

from __future__ import annotations

import base64
import os

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column_bytes, materialize

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The vocabulary's first free identifier.
EOD = 50256
#: Tokens in a block, and blocks in a group of the prefix scan.
BLOCK, GROUP = 1 << 18, 1 << 10
#: Splits text into words, numbers and runs of other characters before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
FILE = "file string, block bigint, tokens binary, first bigint, ids binary"


def vocabulary(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_encoders: dict[int, object] = {}


def encoder(ranks: dict[bytes, int]):
    """One encoder for each worker process."""
    import tiktoken

    key = id(ranks)
    if key not in _encoders:
        _encoders[key] = tiktoken.Encoding("parley", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def _encode(id_col: str, text_col: str, held, eod: int, block: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        name, number, docs = f"{TaskContext.get().partitionId():06d}", 0, 0
        encode = encoder(held.value).encode_ordinary
        stream = np.zeros(0, np.uint16)

        def rows(tokens, number, first, ids):
            kinds = [pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((name, number, tokens, first, ids), kinds, strict=True)], names=["file", "block", "tokens", "first", "ids"])

        for batch in batches:
            texts = [t.decode() for t in column_bytes(batch, text_col)]
            sink = pa.BufferOutputStream()
            ids = pa.RecordBatch.from_arrays([batch.column(id_col)], names=["doc_id"])
            with pa.ipc.new_stream(sink, ids.schema) as w:
                w.write_batch(ids)
            yield rows(None, None, docs, sink.getvalue().to_pybytes())
            docs += len(texts)
            parts, held_tokens = [stream], len(stream)
            for text in texts:
                own = np.array([*encode(text), eod], np.uint16)
                parts.append(own)
                held_tokens += len(own)
                if held_tokens >= block:
                    stream = np.concatenate(parts)
                    for k in range(0, len(stream) - block + 1, block):
                        yield rows(stream[k : k + block].tobytes(), number, None, None)
                        number += 1
                    parts = [stream[len(stream) // block * block :]]
                    held_tokens = len(parts[0])
            stream = np.concatenate(parts)
        if len(stream):
            yield rows(stream.tobytes(), number, None, None)

    return run


def write_files(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY, eod: int = EOD, block: int = BLOCK) -> DataFrame:
    """Flat token files in the shared folder: rows (file, block, tokens) and, beside them, the ids in order (file, first, ids)."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary(os.fspath(path)))
    return materialize(docs.select(id_col, text_col).mapInArrow(_encode(id_col, text_col, held, eod, block), FILE), "tokens")


def scan_block(tokens: np.ndarray, eod: int = EOD) -> tuple[int, np.ndarray, int]:
    """(tokens before the first separator, lengths of the documents begun and ended inside, tokens after the last);
    without a separator all tokens are before and after at once."""
    at = np.flatnonzero(tokens == eod)
    if not len(at):
        return len(tokens), np.zeros(0, np.int64), len(tokens)
    return int(at[0]), np.diff(at) - 1, len(tokens) - 1 - int(at[-1])


def scan(files: DataFrame, eod: int = EOD, group: int = GROUP) -> DataFrame:
    """(file, ordinal, n_tokens) of every document of the token files, ordinals from 0."""

    def search(batches):
        import pyarrow as pa

        for batch in batches:
            blocks = [scan_block(np.frombuffer(t, "<u2"), eod) for t in batch.column("tokens").to_pylist()]
            heads, inner, tails = zip(*blocks, strict=True) if blocks else ((), (), ())
            seps = [len(x) + 1 if t != h or len(x) else int(np.any(np.frombuffer(k, "<u2") == eod)) for h, x, t, k in zip(heads, inner, tails, batch.column("tokens").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("block"), pa.array(heads, pa.int64()), pa.array([x.tolist() for x in inner], pa.list_(pa.int64())), pa.array(tails, pa.int64()), pa.array(seps, pa.int64())],
                names=["file", "block", "head", "inner", "tail", "seps"],
            )

    blocks = files.filter("block is not null").select("file", "block", "tokens")
    found = blocks.mapInArrow(search, "file string, block bigint, head bigint, inner array<bigint>, tail bigint, seps bigint")
    found = materialize(found.withColumn("grp", F.floor(F.col("block") / group)), "separators")
    # carry: tokens after the last separator so far; a run of blocks without one adds up
    within = Window.partitionBy("file", "grp").orderBy("block")
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    run = found.withColumn("docs_before", F.coalesce(F.sum("seps").over(before), F.lit(0)))
    run = run.withColumn("run", F.coalesce(F.sum((F.col("seps") > 0).cast("int")).over(before), F.lit(0)))
    same = Window.partitionBy("file", "grp", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last_tail = F.coalesce(F.max(F.when(F.col("seps") > 0, F.struct("block", "tail"))).over(before)["tail"], F.lit(0))
    run = run.withColumn("carried", F.coalesce(F.sum(F.when(F.col("seps") == 0, F.col("head"))).over(same), F.lit(0)) + last_tail)
    groups = found.groupBy("file", "grp").agg(
        F.sum("seps").alias("g_seps"),
        F.max(F.when(F.col("seps") > 0, F.struct("block", "tail"))).alias("last"),
        F.sum("head").alias("g_tokens_if_none"),
    )
    tail_sum = found.join(groups.select("file", "grp", F.col("last.block").alias("lb")), ["file", "grp"]).groupBy("file", "grp").agg(
        F.sum(F.when(F.col("lb").isNull() | (F.col("block") > F.col("lb")), F.col("head")).otherwise(0)).alias("after")
    )
    groups = groups.join(tail_sum, ["file", "grp"]).withColumn("open", F.coalesce(F.col("last.tail"), F.lit(0)) + F.col("after"))
    over = Window.partitionBy("file").orderBy("grp")
    prior = over.rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("docs_to", F.coalesce(F.sum("g_seps").over(prior), F.lit(0))).withColumn("g_run", F.coalesce(F.sum((F.col("g_seps") > 0).cast("int")).over(prior), F.lit(0)))
    g_same = Window.partitionBy("file", "g_run").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    g_last = F.coalesce(F.max(F.when(F.col("g_seps") > 0, F.struct("grp", "open"))).over(prior)["open"], F.lit(0))
    groups = groups.withColumn("carry_to", F.coalesce(F.sum(F.when(F.col("g_seps") == 0, F.col("open"))).over(g_same), F.lit(0)) + g_last)
    stitched = run.join(groups.select("file", "grp", "docs_to", "carry_to"), ["file", "grp"])
    first = F.col("head") + F.col("carried") + F.when(F.col("run") == 0, F.col("carry_to")).otherwise(0)
    lengths = F.when(F.col("seps") > 0, F.concat(F.array(first), F.col("inner"))).otherwise(F.array().cast("array<bigint>"))
    return stitched.select("file", (F.col("docs_before") + F.col("docs_to")).alias("at"), F.posexplode(lengths).alias("i", "n_tokens")).select("file", (F.col("at") + F.col("i")).alias("ordinal"), "n_tokens")


def ids(files: DataFrame, kind: str) -> DataFrame:
    """(file, ordinal, doc_id) in the order of writing."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for file, first, blob in zip(*(batch.column(c).to_pylist() for c in ("file", "first", "ids")), strict=True):
                with pa.ipc.open_stream(blob) as r:
                    own = r.read_all().column(0).combine_chunks()
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(own), pa.string()), pa.array(np.arange(first, first + len(own))), own], names=["file", "ordinal", "doc_id"])

    return files.filter("ids is not null").select("file", "first", "ids").mapInArrow(run, f"file string, ordinal bigint, doc_id {kind}")


def count(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """(doc_id, n_tokens) for each row of ``docs``, by way of token files."""
    files = write_files(docs, id_col=id_col, **options)
    eod = options.get("eod", EOD)
    return ids(files, docs.schema[id_col].dataType.simpleString()).join(scan(files, eod), ["file", "ordinal"]).select("doc_id", "n_tokens")
