"""Vectorised work on the UTF-8 bytes of Arrow string columns: words, word hashes, shingle sets."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: What parts words (a fixed value).
SPACES = bytes([0x20, *range(0x09, 0x0E)])
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[list(SPACES)] = False
CHUNK = 1 << 20
_U = np.uint64

#: Translation tables: A-Z to a-z, and also all ASCII but letters and digits to blanks.
LOWER = bytes(range(256)).lower()
LETTERS = bytes(c if c > 127 or chr(c).isalnum() else 0x20 for c in LOWER)


def trimmed(run):
    """run, a function of Arrow batches, and after its last batch the memory that it held back to the system.

    Workers serve one task after the other, and what one has freed would else stay with it.
    """

    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # another C library
            ctypes.CDLL(None).malloc_trim(0)

    return whole


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def column_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column one after the other, and the rows' offsets; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    array = array.cast(pa.large_binary())
    _, offsets, data = array.buffers()
    o = np.frombuffer(offsets, dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    d = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def row_chunks(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows with about so many bytes; a longer row is alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def split(d: np.ndarray, o: np.ndarray, table: bytes) -> list[list[bytes]]:
    """The words of each row, bytes being translated by table first; what split() parts are just the bytes SPACES."""
    text = d.tobytes().translate(table)
    return [text[a:b].split() for a, b in zip(o[:-1].tolist(), o[1:].tolist(), strict=True)]


def word_spans(d: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and the rows' offsets into them; words never cross rows. o starts at 0."""
    w = np.zeros(len(d) + 2, dtype=bool)
    w[1:-1] = IS_WORD[d]
    cut = np.zeros(len(d) + 1, dtype=bool)  # a row ends before this byte
    cut[o] = True
    starts = np.flatnonzero(w[1:-1] & (~w[:-2] | cut[:-1]))
    ends = np.flatnonzero(w[1:-1] & (~w[2:] | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, o)


#: Longer words are hashed by a digest each.
LANES = 8
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def span_hashes(d: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of each span's bytes, the same wherever the span stands.

    Two states of 64 bits take eight bytes at a time through a scramble that is no polynomial; spans of more than LANES
    steps get 64 bits of blake2b.
    """
    size = ends - starts
    padded = np.concatenate((d, np.zeros(8, dtype=np.uint8)))
    eight = np.ndarray((len(d) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    with np.errstate(over="ignore"):
        x = size.astype(np.uint64) * _U(0x9E3779B97F4A7C15)
        y = x ^ _U(0xC2B2AE3D27D4EB4F)
        live = np.flatnonzero(size <= 8 * LANES)
        for k in range(LANES):
            live = live[size[live] > 8 * k]
            if not len(live):
                break
            v = eight[starts[live] + 8 * k] & _MASK[np.minimum(size[live] - 8 * k, 8)]
            x[live], y[live] = mix(x[live] ^ v), mix(y[live] * _U(0xD6E8FEB86659FD93) + v)
        out = mix(x + (y << _U(32) | y >> _U(32)))
    for i in np.flatnonzero(size > 8 * LANES).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(d[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def shingle_sets(d: np.ndarray, o: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles, A-Z lower-cased; a row of fewer words has one, of no words none."""
    low = np.frombuffer(LOWER, dtype=np.uint8)[d]
    s, e, first = word_spans(low, o)
    h = span_hashes(low, s, e)
    n = len(o) - 1
    count = np.diff(first)
    with np.errstate(over="ignore"):
        m = len(h) - k + 1
        acc = np.full(max(m, 0), k, dtype=np.uint64)
        for j in range(k if m > 0 else 0):
            acc = mix(acc * _U(0xD6E8FEB86659FD93) + h[j : j + m])
        out = []
        for i in range(n):
            a, c = first[i], count[i]
            if c >= k:
                out.append(np.unique(acc[a : a + c - k + 1]))
            elif c:
                v = np.array([c], dtype=np.uint64)
                for j in range(c):
                    v = mix(v * _U(0xD6E8FEB86659FD93) + h[a + j])
                out.append(v)
            else:
                out.append(np.zeros(0, dtype=np.uint64))
    return out


def lists(parts: list[np.ndarray], kind=np.int64) -> pa.ListArray:
    """A list column from one array a row."""
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts).astype(kind, copy=False) if parts else np.zeros(0, dtype=kind)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
