"""Vectorised work on Arrow string columns: words, word hashes, shingles.

A word is a maximal run of bytes other than space and 0x09-0x0D; only A-Z are
lower-cased. Words are known by a 64-bit hash that is the same on every
machine and in every run (Python's own hash is not used). All functions take
whole texts; callers walk a batch in slices of a few megabytes so that the
scratch arrays (about 30 bytes for each byte of text) stay small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift), elementwise."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(31))
        x = x * np.uint64(0x7FB5D329728EA185)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))


def keyed(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit numbers that depend on the seed alone."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_BYTE = keyed(256, 11)
_BYTE[_SPACE] = 0
_STEP = np.uint64(0x5851F42D4C957F2D)


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) over runs of rows of about ``most`` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        end = min(end, len(column))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of each word, its length, words before each row and at the end)."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] = inside[ends]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) - start + 1, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each lower-cased word, words before each row and at the end)."""
    start, length, rows = words(data, offsets)
    if len(start) == 0:
        return np.zeros(0, np.uint64), rows
    with np.errstate(over="ignore"):
        powers = np.full(int(length.max()) + 1, _STEP, dtype=np.uint64)
        powers[0] = 1
        powers = np.cumprod(powers)
        # place in the word; white space has weight 0, so its place is of no account
        place = np.arange(len(data), dtype=np.int64) - np.repeat(np.concatenate([[0], start]), np.diff(np.concatenate([[0], start, [len(data)]])))
        weight = _BYTE[_LOWER[data]]
        place[weight == 0] = 0
        parts = weight * powers[place]
        sums = np.add.reduceat(parts, start)
        return mix(sums + length.astype(np.uint64)), rows


def shingles(hashes: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words in each row (the whole row if it has fewer), with row bounds."""
    n = np.diff(rows)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(n.dtype))
    bounds = np.concatenate([[0], np.cumsum(count)])
    if bounds[-1] == 0:
        return np.zeros(0, np.uint64), bounds
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1], count) + np.repeat(rows[:-1], count)
    stop = np.minimum(at + width, np.repeat(rows[1:], count))
    factor = keyed(width, 29)
    with np.errstate(over="ignore"):
        out = np.zeros(bounds[-1], dtype=np.uint64)
        for i in range(width):
            here = at + i
            inside = here < stop
            out += np.where(inside, hashes[np.minimum(here, len(hashes) - 1)] * factor[i], np.uint64(i + 1))
        return mix(out), bounds


def distinct(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, with row bounds."""
    kept = [np.unique(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return (np.concatenate(kept) if kept else values[:0]), np.concatenate([[0], np.cumsum([len(x) for x in kept])]).astype(np.int64)


def row_reduce(function: np.ufunc, values: np.ndarray, bounds: np.ndarray, empty) -> np.ndarray:
    """function.reduceat over each row; rows without values get ``empty``."""
    out = np.full(len(bounds) - 1, empty, dtype=values.dtype)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        out[full] = function.reduceat(values, bounds[full])
    return out
