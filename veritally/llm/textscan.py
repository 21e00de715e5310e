"""Numpy kernels over Arrow text columns.

A batch of texts is one byte buffer with offsets, so words, lines and shingles of thousands of
documents are found in a handful of array operations. Slices bound what is in memory at once:
they end at document borders, and only a single text longer than the slice makes one larger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

#: White space of the word pattern [^\x20\x09-\x0D]+.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True

#: Lower-cases A-Z and leaves every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
BYTE_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Scatters 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def binary_parts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a text or binary column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return at - at[0], data


def slices(column, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, offsets, bytes) of runs of documents of at most `limit` bytes, or of one longer document."""
    offsets, data = binary_parts(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last, offsets[first : last + 1] - offsets[first], data[offsets[first] : offsets[last]]
        first = last


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that do not cross a document border."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(len(inside), bool)
    before[0] = False
    before[1:] = inside[:-1]
    borders = offsets[:-1][offsets[:-1] < len(inside)]
    before[borders] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(inside), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[borders[borders > 0] - 1] = False
    return starts, np.flatnonzero(inside & ~after) + 1


def owners(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Index of the document that holds each position."""
    return np.searchsorted(offsets, starts, "right") - 1


def counts_per(owner: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    found = np.bincount(owner, weights, minlength=n)
    return found.astype(np.int64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each span's bytes: a polynomial taken from prefix sums, then mixed with the length.

    The spans ascend and do not overlap. Long buffers are walked in blocks that end between
    spans, so a block only grows past its size when a single span is longer.
    """
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(int(np.searchsorted(ends, starts[i] + block, "right")), i + 1)
        low, high = int(starts[i]), int(ends[j - 1])
        powers, inverses = _powers(high - low)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(BYTE_VALUE[data[low:high]] * powers, out=sums[1:])
        a, b = starts[i:j] - low, ends[i:j] - low
        out[i:j] = mix((sums[b] - sums[a]) * inverses[a] + (b - a).astype(np.uint64))
        i = j
    return out


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(20, int(n - 1).bit_length()) if n else 1 << 20
    if size not in _POWERS:
        if size > 1 << 20:  # one very long span: not kept
            return _power_table(size)
        _POWERS[size] = _power_table(size)
    powers, inverses = _POWERS[size]
    return powers[:n], inverses


def _power_table(size: int) -> tuple[np.ndarray, np.ndarray]:
    table = np.full(size, BASE, np.uint64)
    table[0] = 1
    inverse = np.full(size, BASE_INVERSE, np.uint64)
    inverse[0] = 1
    return np.multiply.accumulate(table), np.multiply.accumulate(inverse)


def window_hashes(hashes: np.ndarray, owner: np.ndarray, n: int, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-item windows that stay within one owner, and the index each begins at.

    `among` limits the windows to those that begin at one of these indexes.
    """
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.arange(m) if among is None else among[among < m]
    at = at[owner[at] == owner[at + n - 1]]
    total = np.zeros(len(at), np.uint64)
    for k in range(n):
        total = total * np.uint64(0xD1342543DE82EF95) + hashes[at + k]
    return mix(total + np.uint64(n)), at


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: does it occur more than once, and is this occurrence one after the first."""
    several, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    if len(keys):
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        later[order[1:]] = same
        several[order[1:]] |= same
        several[order[:-1]] |= same
    return several, later


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n items lie inside a window of `width` items beginning at one of `starts`."""
    steps = np.bincount(starts, minlength=n + 1) - np.bincount(starts + width, minlength=n + 1)
    return np.cumsum(steps[:n]) > 0
