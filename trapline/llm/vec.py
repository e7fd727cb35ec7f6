"""Vectorised byte and word kernels shared by the corpus operators.

Texts of an Arrow batch are laid end to end in one uint8 buffer; every kernel is a few
NumPy passes over it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text handled by one pass of a kernel; a longer text is a pass of its own.
BLOCK = 2 << 20

_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bits of the low 0 to 8 bytes of a number.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Slices longer than this are hashed one by one.
LONG = 512


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def eights(buf: np.ndarray) -> np.ndarray:
    """For every byte, it and the seven after it as one number (zeros after the end)."""
    pad = np.concatenate((buf, np.zeros(8, np.uint8)))
    return np.ndarray(len(buf) + 1, np.uint64, pad, strides=(1,))


def slices_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[starts[i]:ends[i]] (bytes): eight bytes at a time are added to a state that is
    then mixed, so that no arrangement of symbols cancels out as in a polynomial modulo 2**64."""
    n = ends - starts
    w = eights(buf)
    with np.errstate(over="ignore"):
        h = n.astype(np.uint64) * BASE
    h = mix(h ^ (w[starts] & _LOW[np.minimum(n, 8)]))
    at, k = np.flatnonzero((n > 8) & (n <= LONG)), 8
    while at.size:
        h[at] = mix((h[at] << np.uint64(1) | h[at] >> np.uint64(63)) ^ (w[starts[at] + k] & _LOW[np.minimum(n[at] - k, 8)]))
        k += 8
        at = at[n[at] > k]
    for i in np.flatnonzero(n > LONG):
        h[i] = xxhash.xxh3_64_intdigest(buf[starts[i] : ends[i]].tobytes())
    return h


def slices_equal(w: np.ndarray, starts: np.ndarray, sizes: np.ndarray, w2: np.ndarray, starts2: np.ndarray, sizes2: np.ndarray) -> np.ndarray:
    """Which slices of one buffer hold the same bytes as those of another (w, w2: their `eights`)."""
    ok = sizes == sizes2
    ok &= (w[starts] ^ w2[starts2]) & _LOW[np.minimum(sizes, 8)] == 0
    at, k = np.flatnonzero(ok & (sizes > 8)), 8
    while at.size:
        bad = (w[starts[at] + k] ^ w2[starts2[at] + k]) & _LOW[np.minimum(sizes[at] - k, 8)] != 0
        ok[at[bad]] = False
        k += 8
        at = at[~bad & (sizes[at] > k)]
    return ok


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n + 1 offsets; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, at - at[0]


def blocks(buf: np.ndarray, at: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of documents holding up to `size` bytes, one document at least."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


#: Separators under which words are runs of ASCII letters, digits and bytes beyond ASCII.
PLAIN = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])


def word_spans(buf: np.ndarray, at: np.ndarray, sep: np.ndarray = _SEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, `[^\\x20\\x09-\\x0D]+` by default, and the first word of each text (n + 1)."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(at), np.int64)
    word = ~sep[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[at] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at)


def lower(buf: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes kept."""
    return _LOWER[buf]


def mask_of(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """True where some half-open interval covers the position."""
    return np.cumsum(np.bincount(starts, minlength=n + 1)[:n] - np.bincount(ends, minlength=n + 1)[:n]) > 0


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    d = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)
