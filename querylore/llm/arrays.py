"""Numpy helpers that work on whole Arrow batches of texts: words, word-gram hashes, segment sums.

A word is a maximal run of bytes other than space and the control characters 9 to 13. UTF-8 never uses those bytes inside
another character, so bytes can be read in place of code points. Hashes are 64 bits wide and the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18  # text bytes that are hashed at once, which takes some 60 bytes each; a longer text is hashed alone

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of the splitmix generator)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64; at least ``n`` of them."""
    have = _tables.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if n <= 4 * CHUNK_BYTES:
            _tables[base] = have
    return have[:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of values[starts[i]:ends[i]] for each i: polynomial prefix sums, shifted back by the inverse power."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _powers(_BASE, n), out=sums[1:])
    raw = (sums[ends] - sums[starts]) * _powers(_INVERSE, n + 1)[starts]
    return mix(raw ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    column = column.cast(pa.string()) if not pa.types.is_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches again, in batches of about ``limit`` text bytes, so that work arrays stay small."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, bounds = text_bytes(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    pa.default_memory_pool().release_unused()  # the worker may wait idle beside others


class Words:
    """Word hashes of a string column. ``first[i] : first[i + 1]`` are the words of row i."""

    def __init__(self, column: pa.Array, lower: bool):
        raw, bounds = text_bytes(column)
        data = _LOWER[raw] if lower else raw
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[bounds] = True
        space = _SPACE[data]
        apart = np.ones(n + 1, bool)  # space, or nothing, before position i
        apart[1:n] = space[:-1]
        self.starts = np.flatnonzero(~space & (apart[:n] | edge[:n]))
        apart[: n - 1] = space[1:]
        apart[max(n - 1, 0) :] = True
        self.ends = np.flatnonzero(~space & (apart[:n] | edge[1:])) + 1
        self.raw = raw
        self.hashes = span_hashes(_BYTE[data], self.starts, self.ends)
        self.first = np.searchsorted(self.starts, bounds)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of all k consecutive words within a row, the position of each first word, and bounds by row."""
        m = len(self.hashes)
        row_end = np.repeat(self.first[1:], np.diff(self.first))
        at = np.flatnonzero(row_end - np.arange(m) >= k)
        return span_hashes(self.hashes, at, at + k), at, np.searchsorted(at, self.first)


def sliding_min(values: np.ndarray, k: int) -> np.ndarray:
    """Minimum of every k consecutive values."""
    out, width = values, 1
    while width < k:
        step = min(width, k - width)
        out = np.minimum(out[:-step], out[step:])
        width += step
    return out


def lists(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """An Arrow list column from flat values and row bounds."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat))
