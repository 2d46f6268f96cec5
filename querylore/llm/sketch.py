"""Count-min sketches of corpus-wide counts: built per partition, merged by Spark in two steps, read by every task.

A sketch has a fixed number of cells, so what is merged, sent to the driver and shared with tasks is bounded
(``ROWS * 2**MOST_BITS`` bytes) however large the input. With more distinct keys than cells, estimates are higher and more
keys pass the filters built on them; no key is ever estimated below its count (up to the ceiling of the cells: 255, or two).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from querylore.llm.arrays import mix

ROWS = 2
LEAST_BITS, MOST_BITS = 18, 25
SLICES = 32
_SALTS = (np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0x2545F4914F6CDD1D))


def bits_for(keys: float) -> int:
    """Cells (as a power of two) for an expected number of distinct keys: four per key, within the fixed limits."""
    return int(min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(keys, 1) * 4)))))


def cells(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(keys ^ _SALTS[row]) >> np.uint64(64 - bits)).astype(np.int64)


class Sketch:
    """Saturating counts; ``estimate`` never falls below a true count of at most 255."""

    def __init__(self, bits: int, table: np.ndarray | None = None):
        self.bits = bits
        self.table = np.zeros((ROWS, 1 << bits), np.uint8) if table is None else table

    def add(self, keys: np.ndarray) -> None:
        for row in range(ROWS):
            at, n = np.unique(cells(keys, row, self.bits), return_counts=True)
            self.table[row, at] = np.minimum(self.table[row, at].astype(np.int64) + n, 255)

    def estimate(self, keys: np.ndarray) -> np.ndarray:
        return np.minimum.reduce([self.table[row, cells(keys, row, self.bits)] for row in range(ROWS)])

    def slices(self) -> np.ndarray:
        return self.table.reshape(SLICES, -1)

    @staticmethod
    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.minimum(a.astype(np.uint16) + b, 255).astype(np.uint8)

    @classmethod
    def of(cls, bits: int, slices: np.ndarray) -> Sketch:
        return cls(bits, slices.reshape(ROWS, -1))


def _set_bits(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes, and their bits, of ascending cells that hold one bit each, the first cell in the highest bit."""
    if not len(at):
        return at, np.zeros(0, np.uint8)
    first = np.flatnonzero(np.concatenate([[True], (at[1:] >> 3) != (at[:-1] >> 3)]))
    return at[first] >> 3, np.bitwise_or.reduceat((128 >> (at & 7)).astype(np.uint8), first)


class Twice:
    """Counts up to two as two bits a cell: met at all, and met again. A quarter of the bytes of ``Sketch`` where only repeats matter."""

    def __init__(self, bits: int, table: np.ndarray | None = None):
        self.bits = bits
        self.table = np.zeros((2, ROWS, 1 << bits >> 3), np.uint8) if table is None else table

    def add(self, keys: np.ndarray) -> None:
        once, again = self.table
        for row in range(ROWS):
            at, n = np.unique(cells(keys, row, self.bits), return_counts=True)
            byte, mask = _set_bits(at)
            again[row, byte] |= once[row, byte] & mask
            once[row, byte] |= mask
            byte, mask = _set_bits(at[n > 1])
            again[row, byte] |= mask

    def slices(self) -> np.ndarray:
        return self.table.reshape(2, SLICES, -1).transpose(1, 0, 2).reshape(SLICES, -1)

    @staticmethod
    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        half = len(a) // 2
        return np.concatenate([a[:half] | b[:half], a[half:] | b[half:] | (a[:half] & b[:half])])

    @classmethod
    def of(cls, bits: int, slices: np.ndarray) -> Twice:
        return cls(bits, slices.reshape(SLICES, 2, -1).transpose(1, 0, 2).reshape(2, ROWS, -1))


def merged(df: DataFrame, bits: int, keys: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], kind: type = Sketch):
    """One sketch of all keys that ``keys`` yields from the partitions of ``df``."""

    def build(batches):
        sketch = kind(bits)
        for found in keys(batches):
            sketch.add(found)
        part, flat = TaskContext.get().partitionId(), sketch.slices()
        for i in range(SLICES):
            yield pa.RecordBatch.from_arrays([pa.array([part % 64], pa.int32()), pa.array([i], pa.int32()), pa.array([zlib.compress(flat[i].tobytes(), 1)], pa.binary())], ["part", "slice", "counts"])

    def merge(keep: list[str]):
        def add(table: pa.Table) -> pa.Table:
            total = None
            for blob in table.column("counts"):
                counts = np.frombuffer(zlib.decompress(blob.as_py()), np.uint8)
                total = counts if total is None else kind.joined(total, counts)
            arrays = [table.column(k).combine_chunks()[:1] for k in keep] + [pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())]
            return pa.Table.from_arrays(arrays, [*keep, "counts"])

        return add

    parts = df.mapInArrow(build, "part int, slice int, counts binary")
    some = parts.groupBy("part", "slice").applyInArrow(merge(["part", "slice"]), "part int, slice int, counts binary")
    rows = some.groupBy("slice").applyInArrow(merge(["slice"]), "slice int, counts binary").collect()
    if not rows:
        return kind(bits)
    flat = b"".join(zlib.decompress(r["counts"]) for r in sorted(rows, key=lambda r: r["slice"]))
    return kind.of(bits, np.frombuffer(flat, np.uint8).reshape(SLICES, -1))


class Repeated:
    """Of a merged sketch of the kind ``Twice`` whether an estimate is two or more, for the tasks."""

    def __init__(self, df: DataFrame, sketch: Twice):
        self._bits = sketch.bits
        self._flags = df.sparkSession.sparkContext.broadcast(sketch.table[1].copy())

    def test(self, keys: np.ndarray) -> np.ndarray:
        """True for every key whose estimate is two or more."""
        flags, out = self._flags.value, np.ones(len(keys), bool)
        for row in range(ROWS):
            at = cells(keys, row, self._bits)
            out &= (flags[row, at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
        return out


class Shared:
    """A sketch as a Spark broadcast, for use inside tasks."""

    def __init__(self, df: DataFrame, sketch: Sketch):
        self._bits, self._table = sketch.bits, df.sparkSession.sparkContext.broadcast(sketch.table)

    def get(self) -> Sketch:
        return Sketch(self._bits, self._table.value)
