"""Vectorised work on the UTF-8 bytes of many texts at a time: words, hashes, shingles."""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
LANES_AT_ONCE = 1 << 18
U = np.uint64
# Multipliers of the splitmix64 finaliser, and odd constants of our own.
MIX = (U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB))
BASE = U(0x9E3779B97F4A7C15 | 1)
LANES = tuple(U(pow(0xD1342543DE82EF95, 2 * i + 1, 1 << 64)) for i in range(8))

KEEP = np.array([(1 << 8 * i) - 1 for i in range(9)], U)  # the first i bytes of a lane

SPACES = np.zeros(256, bool)
SPACES[[0x20, 9, 10, 11, 12, 13]] = True
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32

_found = ctypes.util.find_library("c")
_libc = ctypes.CDLL(_found) if _found and hasattr(ctypes.CDLL(_found), "malloc_trim") else None


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * MIX[0]
    x = (x ^ (x >> U(27))) * MIX[1]
    return x ^ (x >> U(31))


def plain(column: pa.Array) -> pa.Array:
    """A string column without nulls (null becomes empty) and with 64-bit offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows with about 'limit' bytes; a longer text is a chunk of its own."""
    column = plain(column)
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    offs = np.frombuffer(off, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi
    if offs[n] - offs[0] > limit:
        trim()


def trim() -> None:
    """Give freed memory back to the system: a Python worker lives on after a task and shares its executor's memory."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def edges(offs: np.ndarray, n: int) -> np.ndarray:
    """True at the first byte of each text, and at n."""
    first = np.zeros(n + 1, bool)
    first[offs] = True
    return first


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of each word."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    dark, first = ~SPACES[buf], edges(offs, n)
    left, right = np.empty(n, bool), np.empty(n, bool)
    left[0], right[-1] = True, True
    left[1:] = ~dark[:-1]
    right[:-1] = ~dark[1:]
    starts = np.flatnonzero(dark & (left | first[:-1]))
    ends = np.flatnonzero(dark & (right | first[1:])) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def _lanes(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number; zeros follow the last byte."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes: its lanes of 8 bytes, each mixed with its place, in one sum.

    Mixing comes before the sum, so no arrangement of repeated parts cancels out,
    as it does in a polynomial modulo 2^64.
    """
    lanes, size = _lanes(buf), ends - starts
    total = mixed((lanes[starts] & KEEP[np.minimum(size, 8)]) ^ BASE)
    more = np.flatnonzero(size > 8)
    if len(more):
        count = (size[more] - 1) >> 3  # lanes after the first
        upto = np.cumsum(count)
        for lo, hi in _runs(upto, LANES_AT_ONCE):
            n = count[lo:hi]
            first = upto[lo:hi] - n - (upto[lo] - count[lo])
            nth = np.arange(int(n.sum())) - np.repeat(first, n) + 1
            own = np.repeat(more[lo:hi], n)
            left = np.minimum(size[own] - 8 * nth, 8)
            x = mixed((lanes[starts[own] + 8 * nth] & KEEP[left]) ^ mixed(nth.astype(U) * BASE))
            total[more[lo:hi]] += np.add.reduceat(x, first)
    return mixed(total ^ (size.astype(U) * LANES[7]))


def _runs(upto: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges whose sums are about 'limit'; upto: cumulative sums."""
    lo = 0
    while lo < len(upto):
        before = upto[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(upto, before + limit, "right")))
        yield lo, hi
        lo = hi


def shingles(h: np.ndarray, doc: np.ndarray, n_docs: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of 'size' words in a row and their texts, in text order; a text of fewer words has one, its whole sequence."""
    count = np.bincount(doc, minlength=n_docs)
    m = len(h) - size + 1
    total = np.zeros(max(m, 0), U)
    for i in range(size):
        total += h[i : i + max(m, 0)] * LANES[i]
    whole = doc[: max(m, 0)] == doc[size - 1 :][: max(m, 0)]
    hashes, of = [mixed(total[whole])], [doc[: max(m, 0)][whole]]
    first = np.concatenate(([0], np.cumsum(count)[:-1]))
    for c in range(1, size):
        few = np.flatnonzero(count == c)
        short = np.full(len(few), c, U)
        for i in range(c):
            short += h[first[few] + i] * LANES[i]
        hashes.append(mixed(short))
        of.append(few)
    hashes, of = np.concatenate(hashes), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return hashes[order], of[order]


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text, words with A-Z in lower case."""
    for lo, hi, buf, offs in chunks(column):
        low = LOWERED[buf]
        starts, ends, doc = words(low, offs)
        h, of = shingles(span_hashes(low, starts, ends), doc, hi - lo, size)
        cuts = np.searchsorted(of, np.arange(hi - lo + 1))
        for i in range(hi - lo):
            yield np.unique(h[cuts[i] : cuts[i + 1]])
