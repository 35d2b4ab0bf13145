"""Vectorised words and hashes over the byte buffers of Arrow string columns.

A word is ``[^\\x20\\x09-\\x0D]+``.  Everything works on UTF-8 bytes: the separators are
ASCII, so no character is ever cut.  Hashes of 64 bits are chains of avalanche steps over
whole machine words and the same in every process; callers for whom a chance collision would
change a result compare more (see ``grams``, which gives independent keys by ``seed``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_GRAM = 0xD6E8FEB86659FD93
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
LONG = 512


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def doc_blocks(offsets: np.ndarray, limit: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes; a longer row stands alone."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, high
        low = high


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of unsigned 64-bit values, in place."""
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one little-endian number, zeros after the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash for each span ``data[start:end]``, seeded with its length.

    Eight bytes a step, each step a one-to-one avalanche of the state, so spans of one length
    that differ in one step can't meet again but by chance; spans over ``LONG`` bytes take
    BLAKE2b, as a chain of so many steps would be slow for a few of them.
    """
    size = ends - starts
    out = mix(size.astype(U64) * U64(_GRAM) + U64(_BASE))
    words, todo, at = eights(data), np.flatnonzero(size <= LONG), 0
    while len(todo):
        left = size[todo] - at
        chunk = words[starts[todo] + at] & _LOW_BYTES[np.minimum(left, 8)]
        state = out[todo] ^ chunk
        state *= U64(_BASE)
        out[todo] = mix(state)
        at += 8
        todo = todo[left > 8]
    raw = None
    for i in np.flatnonzero(size > LONG).tolist():
        raw = memoryview(np.ascontiguousarray(data)) if raw is None else raw
        out[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, and for each row the index of its first word (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~(SEPARATOR[data] if gaps is None else gaps)
    edge = np.empty(len(data) + 1, bool)
    edge[0], edge[-1] = word[0], False
    edge[1:-1] = word[1:] & ~word[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    edge[first] = word[first]
    starts = np.flatnonzero(edge)
    edge[0], edge[-1] = False, word[-1]
    edge[1:-1] = word[:-1] & ~word[1:]
    edge[first[1:]] = word[first[1:] - 1]
    ends = np.flatnonzero(edge)
    return starts, ends, np.searchsorted(starts, offsets)


def hash_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words, and each row's first word."""
    starts, ends, rows = word_spans(data, offsets)
    return hash_spans(data, starts, ends), starts, ends, rows


def grams(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A hash for each run of ``n`` neighbours; runs may cross rows, ``inside`` tells which don't."""
    m = max(0, len(words) - n + 1)
    out = np.full(m, n + (seed << 32), U64)
    for k in range(n):
        out ^= out >> U64(29)
        out *= U64(_GRAM)
        out += words[k : k + m]
    return mix(out)


def inside(rows: np.ndarray, n: int) -> np.ndarray:
    """Indices of the runs of ``n`` words that stay in one row, in order."""
    total = int(rows[-1])
    ok = np.ones(max(0, total - n + 1), bool)
    for k in range(1, n):
        at = rows[1:-1] - k
        ok[at[(at >= 0) & (at < len(ok))]] = False
    return np.flatnonzero(ok)


def binaries(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())


def split_binary(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary column whose row i holds the bytes of ``flat[bounds[i]:bounds[i + 1]]``."""
    flat = np.ascontiguousarray(flat)
    off = np.asarray(bounds, np.int64) * (flat.dtype.itemsize * (flat.shape[1] if flat.ndim > 1 else 1))
    if len(off) and off[-1] >= 1 << 31:
        raise OverflowError(f"{off[-1]} bytes in one Arrow column; binary columns hold 2 GB")
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(flat)])
