"""Words of many texts as flat numpy arrays.

A batch of texts is one byte array with row offsets. Words are runs of bytes other than
space and ``\\t \\n \\v \\f \\r``; in UTF-8 these bytes never occur inside a longer character.
Hashes are 64-bit polynomials over a table of random values, taken from running sums, so a
hash of any span costs two look-ups. Batches are worked through in slices of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.RandomState(20240131).randint(0, 2**63 - 1, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, size: int) -> np.ndarray:
    """The first ``size`` powers of the base, or of its inverse modulo 2**64."""
    have = _powers[kind]
    if len(have) < size:
        base = _BASE if kind == "up" else pow(_BASE, -1, 2**64)
        steps = np.full(max(size, SLICE_BYTES + 1), base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if len(have) <= 2 * SLICE_BYTES:  # one very long text does not keep its tables
            _powers[kind] = have
    return have[:size]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over the whole word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, ends, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with at most ``limit`` bytes of text, one row at least."""
    _, offsets = utf8(batch.column(column))
    at, rows = 0, batch.num_rows
    while at < rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


@dataclass
class Words:
    """Words of the rows of a slice, in order."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray  # first word of each row, then the number of words

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


def _runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of marked bytes; a run never crosses a row."""
    begin, stop = inside.copy(), inside.copy()
    if len(inside):
        begin[1:] &= ~inside[:-1]
        stop[:-1] &= ~inside[1:]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(inside))]
        begin[inner] = inside[inner]
        stop[inner - 1] = inside[inner - 1]
    return np.flatnonzero(begin), np.flatnonzero(stop) + 1


def split_words(column: pa.Array) -> Words:
    data, offsets = utf8(column)
    start, end = _runs(~SPACE[data], offsets)
    return Words(data, offsets, start, end, np.searchsorted(start, offsets))


def split_lines(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the non-empty parts between line feeds, over all rows."""
    return _runs(words.data != 0x0A, words.offsets)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash per byte span; equal spans have equal hashes."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * _power("up", len(data)), out=total[1:])
    return mix((total[end] - total[start]) * _power("down", len(data) + 1)[start] + (end - start).astype(np.uint64))


def word_hashes(words: Words) -> np.ndarray:
    return span_hashes(words.data, words.start, words.end)


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` consecutive words; windows over a row's end must be ignored."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * _power("up", n), out=total[1:])
    return mix((total[size:] - total[:-size]) * _power("down", n)[: n - size + 1])


def window_starts(bounds: np.ndarray, size: int) -> np.ndarray:
    """The word positions at which a window of ``size`` words lies within its row."""
    fit = np.maximum(np.diff(bounds) - size + 1, 0)
    return ranges(bounds[:-1], fit)


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """``start[i], start[i] + 1, …`` for ``length[i]`` values, all rows in one array."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(length) - length
    return np.arange(total) + np.repeat(start - before, length)


def occurrence(values: np.ndarray, row: np.ndarray) -> np.ndarray:
    """How many equal values precede each value within its row."""
    n = len(values)
    if not n:
        return np.zeros(0, np.int64)
    own = mix(values ^ mix(row.astype(np.uint64) + np.uint64(_BASE)))
    order = np.argsort(own, kind="stable")
    ranked = own[order]
    fresh = np.ones(n, bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    first = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    out = np.empty(n, np.int64)
    out[order] = np.arange(n) - first
    return out


def covered(start: np.ndarray, size: int, total: int) -> np.ndarray:
    """Which of ``total`` words lie in a window of ``size`` words at one of the starts."""
    change = np.bincount(start, minlength=total + 1) - np.bincount(np.minimum(start + size, total), minlength=total + 1)
    return np.cumsum(change[:total]) > 0


def sequence_hashes(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each run of words ``start[i] … end[i] - 1``."""
    n = len(hashes)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * _power("up", n), out=total[1:])
    return mix((total[end] - total[start]) * _power("down", n + 1)[start] + (end - start).astype(np.uint64))
