"""Words of Arrow text columns as byte offsets, for numpy inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once inside a task, unless one text is longer.
SLICE_BYTES = 1 << 20

#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def texts_of(column: pa.Array) -> pa.Array:
    """A text column as large_binary with nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()).cast(pa.large_binary()), b"")


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets of rows + 1) in runs of about ``most`` bytes."""
    arr = texts_of(column)
    if not len(arr):
        return
    off = np.frombuffer(arr.buffers()[1], np.int64, len(arr) + 1, arr.offset * 8)
    data = np.frombuffer(arr.buffers()[2], np.uint8) if arr.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(arr):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        hi = min(hi, len(arr))
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and each row's first word (rows + 1).

    No word goes over the end of a row.
    """
    solid = (data != 32) & ((data < 9) | (data > 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    before = np.empty(len(data), bool)  # does a word go on from the byte before?
    if len(data):
        before[0] = False
        np.logical_and(solid[:-1], ~edge[1:-1], out=before[1:])
    starts = np.flatnonzero(solid & ~before)
    after = np.empty(len(data), bool)
    if len(data):
        after[-1] = False
        np.logical_and(solid[1:], ~edge[1:-1], out=after[:-1])
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def single_spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with one space after each: bytes, starts, ends."""
    size = ends - starts
    to = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(size + 1, out=to[1:])
    out = np.full(int(to[-1]), 32, np.uint8)
    step = np.zeros(len(data) + 1, np.int8)
    step[starts] += 1
    step[ends] -= 1
    inside = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
    keep = np.ones(len(out), bool)
    keep[to[1:] - 1] = False
    out[keep] = data[inside]
    return out, to[:-1], to[1:] - 1


def per_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values over [first[i], first[i + 1]); zero where that is empty."""
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[first[1:]] - sums[first[:-1]]


def within(size: np.ndarray) -> np.ndarray:
    """0, 1, ... inside each run of the given sizes, one run after the other."""
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)


_R = 0x9E3779B97F4A7C15
_R_BACK = pow(_R, -1, 1 << 64)
_VALUES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... modulo 2 ** 64; kept for the size of slices, made anew for longer words."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        known[0] = 1
        known = np.multiply.accumulate(known)
        if n <= SLICE_BYTES + 1:
            _powers[base] = known
    return known[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, the same wherever the span stands.

    Spans are in order and apart. They are worked on in runs of about SLICE_BYTES.
    """
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + SLICE_BYTES, "right")))
        a, z = starts[lo:hi] - starts[lo], ends[lo:hi] - starts[lo]
        part = data[starts[lo] : ends[hi - 1]]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_VALUES[part] * _power(_R, len(part)), out=sums[1:])
        out[lo:hi] = mix((sums[z] - sums[a]) * _power(_R_BACK, len(part) + 1)[a])
        lo = hi
    return out
