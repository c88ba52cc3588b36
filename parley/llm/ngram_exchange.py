"""Chunked n-grams as compact blobs.

Documents are handled in chunks of bounded size.  A chunk knows its words by
local numbers and its n-grams by 64-bit hashes; sorted hashes are sent as
deltas whose byte planes compress well.
"""

from __future__ import annotations

import numpy as np

from .common import ALNUM

#: Text bytes of a chunk.
CHUNK_BYTES = 12 << 20
SEED = 42
#: Hashes of words and n-grams have so many bits; what chunks exchange is mostly those.
BITS = 60
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the pair (a, b), order matters; wraps modulo 2**64."""
    with np.errstate(over="ignore"):
        x = (a ^ (a >> np.uint64(29))) * M1 + b
        x = (x ^ (x >> np.uint64(32))) * M2
        return x ^ (x >> np.uint64(29))


def pack(values: np.ndarray) -> bytes:
    """Ascending unsigned integers, as deltas."""
    return pack_bytes(np.diff(values.astype("<u8"), prepend=np.uint64(0)))


def unpack(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack_bytes(blob), dtype=np.uint64)


def pack_bytes(values: np.ndarray) -> bytes:
    """Unsigned integers of any width, by byte planes."""
    import zstandard

    width = values.dtype.itemsize
    planes = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_bytes(blob: bytes) -> np.ndarray:
    import zstandard

    width = blob[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel()


def narrow(values: np.ndarray) -> np.ndarray:
    """The narrowest unsigned type that holds the values."""
    top = int(values.max()) if len(values) else 0
    return values.astype("<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8")


def word_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word, SEED) >> 64 - BITS


class Chunk:
    """Words of some documents: ``ids`` into ``hashes`` (one per distinct word), and ``doc`` of each word."""

    def __init__(self, texts: list[bytes]):
        import pyarrow as pa
        import pyarrow.compute as pc

        spaced = [t.translate(ALNUM).strip() for t in texts]
        lists = pc.ascii_split_whitespace(pa.array([t or None for t in spaced], pa.large_binary()).cast(pa.large_string()))
        coded = lists.flatten().dictionary_encode()
        distinct = coded.dictionary.cast(pa.large_binary()).to_pylist()
        self._set(
            coded.indices.to_numpy(zero_copy_only=False).astype(np.int64),
            np.fromiter(map(word_hash, distinct), np.uint64, len(distinct)),
            pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64),
        )

    def _set(self, ids: np.ndarray, hashes: np.ndarray, lengths: np.ndarray) -> None:
        self.ids, self.hashes, self.lengths = ids, hashes, lengths
        self.doc = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)

    @classmethod
    def of_ids(cls, ids: np.ndarray, hashes: np.ndarray, lengths: np.ndarray) -> "Chunk":
        self = cls.__new__(cls)
        self._set(ids, hashes, lengths)
        return self

    def grams(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, index of the last word) of every n-gram of ``order`` words within a document."""
        h = self.hashes[self.ids] if len(self.ids) else np.zeros(0, np.uint64)
        out = h[: max(0, len(h) - order + 1)]
        for k in range(1, order):
            out = mix(out, h[k : len(h) - order + 1 + k])
        if order > 1:
            out = out >> np.uint64(64 - BITS)
        last = np.arange(order - 1, len(h))
        same = self.doc[last - order + 1] == self.doc[last]
        return out[same], last[same]
