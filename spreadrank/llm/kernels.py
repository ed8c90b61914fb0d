"""Vectorised text kernels over Arrow string columns.

A column of texts is one byte buffer plus offsets. Word boundaries, word hashes
and hashes of word windows are found for a whole chunk of documents with NumPy,
so no Python loop touches single words. Chunks hold a bounded number of text
bytes (a single longer text makes a chunk of its own), so memory follows the
chunk and not the partition. Hashes are built from mixed blocks of bytes; they
are no polynomials, which repetitive words would defeat.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 1 << 20
#: Two independent hashes of words and windows; together they are 128 bits wide.
SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_FACTOR = 0xFF51AFD7ED558CCD
_LONG = 512
_KEEP = np.array([(1 << (8 * i)) - 1 for i in range(9)], U64)

_ALL = np.arange(256)
#: Words are runs of bytes other than space and \t..\r.
SPACED = ~((_ALL == 0x20) | ((_ALL >= 0x09) & (_ALL <= 0x0D)))
#: Words are runs of ASCII letters and digits (after lower-casing) and of bytes over 0x7F.
ALNUM = (_ALL >= 0x80) | ((_ALL >= 0x30) & (_ALL <= 0x39)) | ((_ALL >= 0x61) & (_ALL <= 0x7A))
LOWER = np.where((_ALL >= 0x41) & (_ALL <= 0x5A), _ALL + 32, _ALL).astype(np.uint8)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and len(col) + 1 offsets; null is empty."""
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    kind = np.int64 if wide else np.int32
    if len(col) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    o = np.frombuffer(offs, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[o[0] : o[-1]]
    return raw, o - o[0]


#: What tasks keep in a worker for later tasks; a task of another operator drops it.
KEPT: list[dict] = []


def release(keep: dict | None = None) -> None:
    """Drops what other operators' tasks keep in this worker, and gives freed memory back to the system."""
    for cache in KEPT:
        if cache is not keep:
            cache.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES, keep=None) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``limit`` text bytes, or of one row; drops what others than ``keep`` keep."""
    release(keep)
    for batch in batches:
        if not batch.num_rows:
            continue
        _, o = text_bytes(column(batch, text))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(o, o[at] + limit, side="right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = SEEDS[0]) -> np.ndarray:
    """64-bit hash of the bytes data[s:e] of every span.

    Eight bytes at a time go through the mixer, which is a bijection of them; spans over ``_LONG`` bytes take BLAKE2.
    """
    size = ends - starts
    out = mix(size.astype(U64) * U64(_FACTOR) + U64(seed))
    lanes = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))
    live = np.flatnonzero((size > 0) & (size <= _LONG))
    at, left = starts[live], size[live]
    while len(live):
        lane = lanes[at] & _KEEP[np.minimum(left, 8)]
        out[live] = mix(out[live] ^ (lane * U64(_FACTOR)))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > _LONG):
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, key=seed.to_bytes(8, "little"))
        out[i] = int.from_bytes(digest.digest(), "little")
    return out


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a sequence whose two parts have the hashes a and b."""
    return mix(a * U64(_FACTOR) + b)


class Words:
    """Words of a chunk: byte spans, hashes, and the range of words of each document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, hashed: bool = True):
        self.data, self.offsets = data, offsets
        mask = is_word[data]
        begins, stops = mask.copy(), mask.copy()
        begins[1:] &= ~mask[:-1]
        stops[:-1] &= ~mask[1:]
        full = offsets[1:] > offsets[:-1]
        first, last = offsets[:-1][full], offsets[1:][full] - 1
        begins[first] = mask[first]
        stops[last] = mask[last]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(stops) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.bounds)
        self.n = len(self.starts)
        self.mask = mask
        self._doc: np.ndarray | None = None
        if hashed:
            self.hash = span_hashes(data, self.starts, self.ends)

    @property
    def doc(self) -> np.ndarray:
        """Ordinal of the document of each word."""
        if self._doc is None:
            self._doc = np.repeat(np.arange(len(self.counts)), self.counts)
        return self._doc

    @property
    def second(self) -> np.ndarray:
        """Another 64 bits of hash of each word."""
        return span_hashes(self.data, self.starts, self.ends, SEEDS[1])

    def windows(self, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all windows of m words within one document, and their hashes."""
        return windows(self.hash, self.doc, m)


def windows(hashes: np.ndarray, doc: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(hashes)
    if n < m:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    s = np.flatnonzero(doc[: n - m + 1] == doc[m - 1 :])
    return s, window_hashes(hashes, m)[s]


def window_hashes(hashes: np.ndarray, m: int) -> np.ndarray:
    """Hash of hashes[i:i + m] for each i, from hashes of windows of powers of two."""
    n, out, size, power, wide = len(hashes) - m + 1, None, 0, 1, hashes
    while power <= m:
        if m & power:
            part = wide[size : size + n]
            out = part if out is None else _joined(out, part)
            size += power
        if 2 * power <= m:
            wide = _joined(wide[:-power], wide[power:])
        power *= 2
    return mix(out + U64(m))


def sequence_hash(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of hashes[s:e] of every span; for spans of few hashes."""
    size = ends - starts
    out, live = mix(size.astype(U64)), np.flatnonzero(size > 0)
    at = starts[live]
    while len(live):
        out[live] = _joined(out[live], hashes[at])
        at = at + 1
        more = at < ends[live]
        live, at = live[more], at[more]
    return out


def words_of(col: pa.Array, is_word: np.ndarray = SPACED, lower: bool = False, hashed: bool = True) -> Words:
    data, offsets = text_bytes(col)
    return Words(LOWER[data] if lower else data, offsets, is_word, hashed)


def per_doc(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[o[i]:o[i+1]]."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def covered(starts: np.ndarray, m: int, n: int) -> np.ndarray:
    """Which of n positions lie in a window of m that begins at one of the starts."""
    delta = np.zeros(n + 1, np.int32)
    np.add.at(delta, starts, 1)
    np.add.at(delta, np.minimum(starts + m, n), -1)
    return np.cumsum(delta[:-1]) > 0


def pack(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())
