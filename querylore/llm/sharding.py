"""Shards of near equal size, by sampled splitters. DataFrame functions only.

Records are ordered by a hash of their text, so equal texts are neighbours. A size-weighted sample of keys (a record is drawn with
a chance in proportion to its bytes; at most about ``DRAWS`` draws a range reach the driver) gives the quantile boundaries of many
key ranges. Exact bytes are then counted per range: an overfull range is subdivided by a second hash of the text, and a text whose
copies alone overfill a range is a piece of its own, counted in parts by doc_id. The pieces, a few for each range, are packed into the
shards, the heaviest first into the lightest shard. Copies of one text share a shard; they are parted only where they exceed a shard's mean, or
where shards that hold such groups whole would not come out even (``packed``).
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from querylore.llm.common import stored

SHARDS = 16
RANGES_PER_SHARD = 16
ROWS_PER_RANGE = 50_000
MOST_RANGES = 8192
DRAWS = 16
OVERFULL = 2.0  # times the mean bytes of a range
EVEN = 1.02  # times the mean bytes of a shard that the fullest may have before groups of copies are parted


def _range_of(key, bounds: list[int]):
    """Number of boundaries at or below the key, by two short scans."""
    step = max(1, math.isqrt(len(bounds)))
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    if not blocks:
        return F.lit(0)
    block = F.size(F.filter(F.array(*[F.lit(b[0]) for b in blocks]), lambda b: b <= key))
    inner = F.element_at(F.array(*[F.array(*[F.lit(v) for v in b]) for b in blocks]), F.greatest(block, F.lit(1)))
    return F.when(block == 0, 0).otherwise((block - 1) * step + F.size(F.filter(inner, lambda b: b <= key))).cast("int")


def packed(pieces: dict[tuple, int], shards: int) -> dict[tuple, int]:
    """The shard of each piece (range, text or part, part of copies or -1), by bytes: the heaviest first into the lightest shard.

    The parts of one text's copies go together as long as the text fits a shard's mean and the shards still come out even; else the texts above
    half that size, and so on, are dealt part by part.
    """
    mean = max(1.0, sum(pieces.values()) / shards)
    groups: dict[tuple, list[tuple]] = {}
    for r, s, t in sorted(pieces):
        groups.setdefault((r, s, t >= 0), []).append((r, s, t))
    sizes = {g: sum(pieces[p] for p in own) for g, own in groups.items()}
    whole = mean
    while True:
        units = [own for g, own in groups.items() if sizes[g] <= whole] + [[p] for g, own in groups.items() if sizes[g] > whole for p in own]
        lightest = [(0, shard) for shard in range(shards)]
        where = {}
        for own in sorted(units, key=lambda u: (-sum(pieces[p] for p in u), u)):
            filled, shard = heapq.heappop(lightest)
            where.update(dict.fromkeys(own, shard))
            heapq.heappush(lightest, (filled + sum(pieces[p] for p in own), shard))
        if max(lightest)[0] <= EVEN * mean or all(len(own) == 1 for own in units):
            return where
        whole /= 2


def assign_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for each row of ``docs`` (doc_id, text, ...).

    size is the UTF-8 bytes of the text plus 1, a null text counting as empty, as it does for text_crc32. Slots run from 0 in each
    shard without gaps, over pieces in key order. Rows without a doc_id and repeated rows are placed like any other. Other columns
    are ignored. An empty table gives an empty table.
    """
    text = F.coalesce("text", F.lit(""))
    rows = stored(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("key")), "shard-rows")
    count, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = min(MOST_RANGES, max(shards * RANGES_PER_SHARD, count // ROWS_PER_RANGE))
    share = max(1.0, total / ranges)
    # floor(size * rate + u) draws with u uniform from hashes: the expected number is in proportion to size
    uniform = (F.shiftrightunsigned(F.xxhash64("doc_id", "key", F.lit(1)), 11) / F.lit(float(1 << 53)))
    draws = F.floor(F.col("size") * (DRAWS / share) + uniform).cast("int")
    sample = rows.withColumn("draws", draws).filter("draws > 0").groupBy("key").agg(F.sum("draws").alias("draws")).orderBy("key").collect()
    bounds, seen, drawn = [], 0, sum(r["draws"] for r in sample)
    for row in sample:
        if seen * ranges >= (len(bounds) + 1) * drawn and (not bounds or bounds[-1] < row["key"]):
            bounds.append(row["key"])
        seen += row["draws"]

    # texts whose copies alone overfill a range, fewer than the ranges; every other text lies whole in one piece
    heavy = rows.groupBy("key").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > OVERFULL * share).select("key", F.ceil(F.col("bytes") / share).cast("int").alias("copies"))
    placed = rows.withColumn("r", _range_of(F.col("key"), bounds)).join(F.broadcast(heavy), "key", "left")
    first = placed.filter("copies IS NULL").groupBy("r").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > OVERFULL * share)
    by_text = first.select("r", F.ceil(F.col("bytes") / share).cast("int").alias("parts"))  # at most a row for each range
    placed = placed.join(F.broadcast(by_text), "r", "left")
    among = F.when(F.col("copies").isNotNull(), F.col("key")).otherwise(F.coalesce(F.pmod(F.xxhash64("key", F.lit(2)), F.col("parts")), F.lit(0)))
    copy = F.coalesce(F.pmod(F.xxhash64("doc_id", "key", F.lit(3)), F.col("copies")).cast("int"), F.lit(-1))
    placed = placed.withColumn("s", among).withColumn("t", copy).drop("parts", "copies")

    # one row for each piece: fewer than ranges * (1 + 2 / OVERFULL) + total / share, whatever the input
    pieces = {(p["r"], p["s"], p["t"]): (p["bytes"], p["n"]) for p in placed.groupBy("r", "s", "t").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}
    where = packed({piece: size for piece, (size, _) in pieces.items()}, shards)
    begun, table = [0] * shards, []
    for piece in sorted(pieces):
        table.append((*piece, where[piece], begun[where[piece]]))
        begun[where[piece]] += pieces[piece][1]
    plan = docs.sparkSession.createDataFrame(table, "r int, s long, t int, shard int, begun long")
    number = F.row_number().over(Window.partitionBy("r", "s", "t").orderBy("key", "doc_id"))
    numbered = placed.withColumn("number", number - 1)
    return numbered.join(F.broadcast(plan), ["r", "s", "t"]).select("doc_id", "size", "text_crc32", "shard", (F.col("begun") + F.col("number")).alias("slot"))
