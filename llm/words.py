"""Words, word hashes and n-gram hashes of whole Arrow text columns, in numpy.

A word is a run of `[^\\x20\\x09-\\x0D]+`. All functions work on the UTF-8 bytes of a
batch at once; nulls and empty texts have no words. Hashes are 64 bits wide and depend
on the bytes alone, so that every executor computes the same values.
"""

from __future__ import annotations

import ctypes
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Text bytes that are hashed at once; bounds the memory of a task whatever its batch holds.
CHUNK_BYTES = 4 << 20
#: Bytes whose positions and powers are in memory at once while they are hashed.
HASH_BYTES = 1 << 19

U = np.uint64
try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:  # another C library
    _LIBC = None
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.Generator(np.random.PCG64(20_240_101)).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_LOWER = _BYTE.copy()
_LOWER[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_BASE = U(0x9E3779B97F4A7C15 | 5)
_STEP = U(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every output bit depends on every input bit."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _BASE, U)
    out[0] = 1
    return np.multiply.accumulate(out)


class Words(NamedTuple):
    """start, end: byte positions in `buf`; doc: row in the batch; first: index of each row's first word, and the number of words at the end."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    offsets: np.ndarray


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows, one after another, and where each row begins and ends."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(texts) + 1 + texts.offset)[texts.offset :] if len(texts) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0]


def split_words(buf: np.ndarray, offsets: np.ndarray) -> Words:
    n = len(offsets) - 1
    if not len(buf):
        none = np.zeros(0, np.int64)
        return Words(buf, none, none, none, np.zeros(n + 1, np.int64), offsets)
    space = _SPACE[buf]
    opens, closes = ~space, ~space
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(buf))]
    before = np.empty(len(buf), bool)
    before[0], before[1:] = True, space[:-1]
    before[edges] = True
    opens &= before
    before[-1], before[:-1] = True, space[1:]
    before[edges - 1] = True
    closes &= before
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(n), np.diff(first))
    return Words(buf, start, end, doc, first, offsets)


def segment_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """One 64-bit hash for each non-empty piece buf[start:end], pieces in rising order; with `lower`, A-Z count as a-z."""
    out = np.empty(len(start), U)
    if not len(out):
        return out
    table = _LOWER if lower else _BYTE
    power = _powers(int((end - start).max()))
    cuts = np.unique(np.searchsorted(start, np.arange(0, len(buf) + HASH_BYTES, HASH_BYTES)))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        size = end[a:b] - start[a:b]
        begin = np.cumsum(size) - size
        at = np.arange(begin[-1] + size[-1]) - np.repeat(begin, size)
        value = table[buf[at + np.repeat(start[a:b], size)]] * power[at]
        out[a:b] = np.add.reduceat(value, begin)
    return mix(out)


def word_hashes(w: Words, lower: bool = False) -> np.ndarray:
    return segment_hashes(w.buf, w.start, w.end, lower)


def ngrams(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A hash for each run of n neighbouring word hashes, whichever rows they are in; shorter by n - 1."""
    size = max(0, len(h) - n + 1)
    out = np.full(size, U(0x5851F42D4C957F2D + 2 * seed), U)
    for j in range(n):
        out *= _STEP
        out += h[j : j + size]
    return mix(out)


def chunks(texts: pa.Array, size: int = CHUNK_BYTES):
    """(first row, row after the last) of runs of rows of about `size` bytes; a longer row is a run of its own."""
    _, offsets = text_bytes(texts)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, to
        at = to


def release() -> None:
    """Give memory that is no longer used back to the system: Python workers live on while their executor does other work."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)
