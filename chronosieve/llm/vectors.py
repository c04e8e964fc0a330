"""Numpy helpers on Arrow batches of texts: slices of a batch, words, rolling hashes, minimisers.

They run inside Spark's tasks, on slices of bounded size, however long a batch
or a single text is.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

#: Symbols that are worked on at once; a longer text is cut into overlapping pieces.
SLICE = 1 << 19
POSITION = np.uint64((1 << 21) - 1)
_SEED = 7349
IS_WORD = np.ones(256, bool)
IS_WORD[[9, 10, 11, 12, 13, 32]] = False
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


@functools.cache
def byte_table(which: int) -> np.ndarray:
    return np.random.default_rng(_SEED + which).integers(0, 1 << 64, 256, np.uint64)


@functools.cache
def _powers(which: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for an odd B."""
    base = int(np.random.default_rng(_SEED + 100 + which).integers(1 << 62, 1 << 63)) * 2 + 1
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(size, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(1 << 16, 1 << (int(n) + 1).bit_length())
    return _powers(which, size)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of h over all bits."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def prefix_sums(values: np.ndarray, which: int) -> np.ndarray:
    """Sums S such that span(S, a, b) is a hash of values[a:b] alone."""
    p, _ = powers(which, len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * p[: len(values)], out=out[1:])
    return out


def span(sums: np.ndarray, a, b, which: int) -> np.ndarray:
    _, inv = powers(which, len(sums) - 1)
    return mixed((sums[b] - sums[a]) * inv[a])


def binary_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without nulls; offsets are relative to the bytes."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if len(column) and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def texts(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    return binary_parts(batch.column(name).fill_null(""))


def slices(offsets: np.ndarray, overlap: int = 0, limit: int = SLICE):
    """Cuts a batch: yields (first row, row offsets relative to the first byte, first byte's place).

    Rows are taken together while they fit; a row longer than the limit comes in
    pieces that overlap by `overlap` symbols.
    """
    row, n = 0, len(offsets) - 1
    while row < n:
        last = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        if last > row:
            yield row, offsets[row : last + 1] - offsets[row], int(offsets[row])
            row = last
        else:
            at, end = int(offsets[row]), int(offsets[row + 1])
            while True:
                stop = min(end, at + limit)
                yield row, np.array([0, stop - at]), at
                if stop == end:
                    break
                at = stop - overlap
            row += 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of each row, and how many words precede each row."""
    inside = IS_WORD[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    at = offsets[:-1][np.diff(offsets) > 0]
    begins[at] = inside[at]
    last = at[at > 0] - 1
    ends[last] = inside[last]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    return span(prefix_sums(byte_table(which)[data], which), starts, ends, which)


def super_windows(symbols: np.ndarray, rows: np.ndarray, window: int, gram: int):
    """Super-k-mers: maximal runs of consecutive windows that share their minimiser.

    symbols: a 64-bit value for each symbol; rows: offsets of the texts in it.
    Returns for each run: row, start, end (its symbols are start:end), anchor (the
    minimiser's hash). The minimiser of a window is the gram of smallest hash, the
    leftmost of equals, so it depends on nothing but the window.
    """
    none = np.zeros(0, np.int64)
    n = len(symbols)
    if n < window:
        return none, none, none, none.astype(np.uint64)
    sums = prefix_sums(symbols, 5)
    places = np.arange(n - gram + 1)
    grams = span(sums, places, places + gram, 5)
    key = (grams & ~POSITION) | places.astype(np.uint64)
    width, have = window - gram + 1, 1
    while have * 2 <= width:
        key = np.minimum(key[:-have], key[have:])
        have *= 2
    if width > have:
        key = np.minimum(key[: len(key) - (width - have)], key[width - have :])
    valid = np.zeros(n, bool)
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if b - a >= window:
            valid[a : b - window + 1] = True
    begins = np.flatnonzero(valid)
    if not len(begins):
        return none, none, none, none.astype(np.uint64)
    place = (key[begins] & POSITION).astype(np.int64)
    cut = np.flatnonzero((place[1:] != place[:-1]) | (begins[1:] != begins[:-1] + 1)) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(begins)]]) - 1
    start = begins[first]
    return np.searchsorted(rows, start, "right") - 1, start, begins[last] + window, mixed(grams[place[first]] + np.uint64(1))  # minimisers are small by choice, so they are spread again
