"""Whole Arrow columns of texts as bytes, words and hashes, in NumPy.

Every function works on a slice of a column: the texts lie one after the other in one
byte array, ``bounds`` holds where each begins and where the last ends. A slice is bounded
in bytes and in rows, so a task's memory does not follow the size of an Arrow batch; one
text longer than the bound is a slice of its own. A null text is an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
SLICE_ROWS = 2_000

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_FIRST = np.uint64(0xBF58476D1CE4E5B9)
_SECOND = np.uint64(0x94D049BB133111EB)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _table(ranges: list[tuple[int, int]]) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = False
    return table


#: Bytes of the words ``[^\x20\x09-\x0D]+``.
NOT_SPACE = _table([(0x20, 0x20), (0x09, 0x0D)])
#: Bytes of the words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of a text in lower case.
LETTERS = _table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _FIRST
    x ^= x >> np.uint64(27)
    x *= _SECOND
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Slice:
    """Rows ``first`` to ``last`` of a batch; ``bounds`` counts within ``data``."""

    first: int
    last: int
    data: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return self.last - self.first


def slices(column: pa.Array, limit: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[Slice]:
    """Consecutive slices of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = max(first + 1, min(last, len(column), first + rows))
        base, end = int(offsets[first]), int(offsets[last])
        yield Slice(first, last, data[base:end], offsets[first : last + 1] - base)
        first = last


@dataclass
class Words:
    """Words of a slice in order: where they start and end, their text's row, their hash."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    per_row: np.ndarray
    first_of_row: np.ndarray


def words(part: Slice, kept: np.ndarray, lower: bool) -> Words:
    """Longest runs of bytes of one class; class 0 (or False) separates."""
    data = LOWER[part.data] if lower else part.data
    kind = kept[data]
    n = len(data)
    edge = np.zeros(n + 1, dtype=bool)
    edge[part.bounds] = True  # a text's first byte, and the end
    edge[1:n] |= kind[1:] != kind[:-1]
    inside = kind > 0
    start = np.flatnonzero(inside & edge[:n])
    end = np.flatnonzero(inside & edge[1:]) + 1
    row = np.searchsorted(part.bounds, start, "right") - 1
    per_row = np.bincount(row, minlength=len(part)).astype(np.int64)
    first_of_row = np.concatenate([[0], np.cumsum(per_row)[:-1]]) if len(part) else per_row
    return Words(start, end, row, hash_spans(data, start, end), per_row, first_of_row)


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes at a time."""
    if not len(start):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
    value = mix((end - start).astype(np.uint64) * _MULTIPLY)
    active, at = np.arange(len(start)), start.copy()
    while len(active):
        left = end[active] - at
        block = eight[at]
        short = left < 8
        shift = np.where(short, 64 - 8 * left, 0).astype(np.uint64)
        block = (block << shift) >> shift
        value[active] = mix(value[active] * _MULTIPLY + block)
        more = left > 8
        active, at = active[more], at[more] + 8
    return value


def grams(found: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of every run of ``n`` words inside one text."""
    count = len(found.hash) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value = found.hash[:count].copy()
    for j in range(1, n):
        value = mix(value * _MULTIPLY + found.hash[j : count + j])
    first = np.flatnonzero(found.row[:count] == found.row[n - 1 :])
    return value[first], first


def fold(columns: np.ndarray) -> np.ndarray:
    """One hash for each row of a matrix of hashes."""
    value = columns[:, 0].copy()
    for j in range(1, columns.shape[1]):
        value = mix(value * _MULTIPLY + columns[:, j])
    return value


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the smallest of each ``width`` neighbours; of equal ones the last."""
    count = len(values) - width + 1
    if count <= 0:
        return np.zeros(0, np.int64)
    best = np.arange(len(values))
    span = 1
    while span < width:  # windows of doubling width; the last step overlaps
        step = min(span, width - span)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(values[right] <= values[left], right, left)
        span += step
    return best


def concatenated_ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (count[0] of them), then the same for the next."""
    total = int(count.sum())
    ends = np.cumsum(count)
    return np.arange(total) - np.repeat(ends - count, count) + np.repeat(start, count)


def mapped(spark_batches: Iterator[pa.RecordBatch], work: Callable, schema: pa.Schema):
    """Run ``work(batch) -> iterator of pa.Table`` over batches and emit record batches."""
    for batch in spark_batches:
        for table in work(batch):
            yield from table.cast(schema).to_batches()
