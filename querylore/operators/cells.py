"""Exact vector search that skips what cannot be among the best.

Chunks are stored by cells: each belongs to the nearest of some sampled centres, and a cell knows its radius and rows. No vector of a cell has a
higher product with a question than the centre's product plus the question's length times the radius. A search has two rounds: a
question first looks into the one cell whose centre fits it best, and then into the cells whose bound is not below the k-th score it found there.
Vectors that lie in groups let most cells be skipped; where nothing can be skipped all are compared, and the rows are the same.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querylore.functions import blocks
from querylore.operators.relational import last_per_group
from querylore.operators.retrieval import SHARED_BYTES, VECTOR_CHUNKS, VECTOR_QUESTIONS, _once, _schema, blockwise

MOST_CELLS = 4_096  # centres are sent to every task
CELL_ROWS = 2_000


class CellTable:
    """Chunks by cells in a folder, with (cell, centre, radius, rows) of each cell."""

    def __init__(self, spark: SparkSession, path: str):
        self.chunks = spark.read.parquet(f"{path}/chunks")
        self.cells = spark.read.parquet(f"{path}/cells")
        got = self.cells.orderBy("cell").toArrow()  # MOST_CELLS rows at most
        self.number = got["cell"].to_numpy()
        self.rows = got["rows"].to_numpy()
        size = int(self.number.max()) + 1 if len(self.number) else 0
        centres = blocks.vectors(got["centre"]) if len(self.number) else np.zeros((0, 0))
        self.centres, self.radius = np.zeros((size, centres.shape[1])), np.zeros(size)
        if size:
            self.centres[self.number], self.radius[self.number] = centres, got["radius"].to_numpy()


def write_cells(chunks: DataFrame, path: str, cells: int | None = None) -> str:
    """Stores chunks (chunk_id, embedding, ...) by cells below ``path``; returns it. Chunks without a vector are left out.

    Centres are the vectors with the least hash of chunk_id, one for about ``CELL_ROWS`` rows or the square root of the rows, whichever gives more, at
    most ``MOST_CELLS``. Rows are dealt by ranges of (cell, chunk_id), so a cell that holds very many is many files.
    """
    have = chunks.filter("embedding IS NOT NULL")
    total = have.count()
    wanted = cells or min(MOST_CELLS, max(1, total // CELL_ROWS, math.isqrt(total)))
    centres = have.select(F.xxhash64("chunk_id").alias("h"), "chunk_id", "embedding").orderBy("h", "chunk_id").limit(wanted).select("embedding").distinct().toArrow()
    points = blocks.vectors(centres["embedding"]) if total else np.zeros((0, 0))
    points = points[np.lexsort(points.T[::-1])] if total else points
    names = have.columns
    at = names.index("embedding")

    def assign(batches):
        for batch in batches:
            cell, distance = blocks.nearest(blocks.vectors(batch.column(at)), points)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(distance)], [*names, "cell", "distance"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in have.schema)
    have.mapInArrow(assign, f"{schema}, cell int, distance double").repartitionByRange("cell", "chunk_id").sortWithinPartitions("cell").write.mode("overwrite").parquet(f"{path}/chunks")
    spark = chunks.sparkSession
    table = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "cell int, centre array<double>")
    sizes = spark.read.parquet(f"{path}/chunks").groupBy("cell").agg(F.max("distance").alias("radius"), F.count("*").alias("rows"))
    table.join(sizes, "cell").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    return path


def _asked(questions: DataFrame, keys: list[str], table: CellTable, k: int, by: str | None) -> DataFrame:
    """The questions with their seed: of the cells with k rows or more, the one whose centre has the highest product."""
    only = [by] if by else []
    asked = questions.filter("embedding IS NOT NULL").select(*dict.fromkeys([*keys, *only]), "embedding")
    large = table.number[table.rows >= k] if (table.rows >= k).any() else table.number
    centres, names = table.centres[large], asked.columns

    def seeded(batches):
        for batch in batches:
            wanted = blocks.vectors(batch.column(len(names) - 1))
            seed = np.zeros(len(wanted), np.int64)
            step = max(1, blocks.CELLS // max(1, len(large)))
            for start in range(0, len(wanted), step):
                seed[start:start + step] = large[(wanted[start:start + step] @ centres.T).argmax(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(seed, pa.int32())], [*names, "seed"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema)
    return asked.mapInArrow(seeded, f"{schema}, seed int")


def _with_floor(asked: DataFrame, table: CellTable, k: int, keys: list[str], by: str | None, shared_bytes: int) -> DataFrame:
    """The questions with the k-th score of their seed cell, or less than any score where it has fewer than k."""
    kernel = partial(blocks.cell_top_k, keys=keys, k=k, by=by, carry=None, centres=table.centres, radius=table.radius, seeds=True)
    have = table.chunks.select("chunk_id", "embedding", "cell", *([by] if by else []))
    seeds = asked.select(F.col("seed").alias("cell")).distinct()
    found = blockwise(asked, have.join(seeds, "cell", "left_semi"), keys, kernel, _schema(asked, keys, None), shared_bytes, VECTOR_QUESTIONS, VECTOR_CHUNKS)
    first = last_per_group(found, keys, [F.desc("score"), F.col("chunk_id")], k, rank="rank")
    floors = first.groupBy(*keys).agg(F.count("*").alias("n"), F.min("score").alias("kth")).filter(F.col("n") == k).drop("n")
    return asked.join(floors, keys, "left").withColumn("floor", F.coalesce("kth", F.lit(float("-inf")))).drop("kth")


def cell_top_k(questions: DataFrame, table: CellTable, k: int = 5, keys: tuple[str, ...] = ("query_id",), by: str | None = None,
               carry: str | None = None, shared_bytes: int = SHARED_BYTES) -> DataFrame:
    """The rows of ``retrieval.top_k``: keys, chunk_id, score, rank."""
    keys = list(keys)
    if not len(table.number):
        return table.chunks.sparkSession.createDataFrame([], _schema(questions, keys, carry) + ", rank int")
    asked = _once(_asked(questions, keys, table, k, by), "asked")
    asked = _once(_with_floor(asked, table, k, keys, by, shared_bytes), "asked-floors")
    have = table.chunks.select("chunk_id", "embedding", "cell", *([by] if by else []), *([carry] if carry else []))
    kernel = partial(blocks.cell_top_k, keys=keys, k=k, by=by, carry=carry, centres=table.centres, radius=table.radius, seeds=False)
    best = blockwise(asked, have, keys, kernel, _schema(asked, keys, carry), shared_bytes, VECTOR_QUESTIONS, VECTOR_CHUNKS)
    return last_per_group(best.repartition(keys[0]), keys, [F.desc("score"), F.col("chunk_id")], k, rank="rank")


def compared_pairs(questions: DataFrame, table: CellTable, k: int = 5, keys: tuple[str, ...] = ("query_id",), by: str | None = None,
                   shared_bytes: int = SHARED_BYTES) -> DataFrame:
    """(keys, compared): how many chunks each question is compared with in both rounds at most; the k-th score seen on the way can spare more."""
    keys = list(keys)
    asked = _with_floor(_once(_asked(questions, keys, table, k, by), "asked"), table, k, keys, by, shared_bytes)
    names, number, rows, centres, radius = asked.columns, table.number, table.rows, table.centres, table.radius

    def counted(batches):
        for batch in batches:
            wanted = blocks.vectors(batch.column(names.index("embedding")))
            norms, floor = np.sqrt((wanted**2).sum(1)), batch.column(names.index("floor")).to_numpy()
            seed = batch.column(names.index("seed")).to_numpy()
            total = np.zeros(len(wanted), np.int64)
            for cell, n in zip(number.tolist(), rows.tolist()):
                total += n * ((blocks.bounds_in(cell, wanted, norms, centres, radius) >= floor).astype(np.int64) + (seed == cell))
            yield pa.RecordBatch.from_arrays([batch.column(names.index(c)) for c in keys] + [pa.array(total)], [*keys, "compared"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema if f.name in keys)
    return asked.mapInArrow(counted, f"{schema}, compared bigint")

