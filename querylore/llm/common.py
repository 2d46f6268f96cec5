"""Shared steps of the operators: scratch tables, components, running sums and the next row of an ordered table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querylore.session import scratch_dir

SPAN_BITS = 8  # ids per level of the ordered helpers: 256
LEVELS = 3


BATCH_ROWS = 512  # rows of whole texts that Spark hands to a Python worker at once


def text_batches(spark: SparkSession) -> None:
    """Limits the batches between Spark and Python workers for the session: texts are thousands of bytes, and the default of 10,000 rows
    is held on both sides, once or twice. A smaller setting of the caller stays. Results do not depend on it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The frame written once to the shared folder and read back, so that lost executors cost a reread at most."""
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over the undirected links ``a``, ``b`` (longs), of all nodes but these smallest.

    Alternating large-star and small-star steps. A node with very many links is an aggregation with partial sums and a join
    whose large side Spark can split; no neighbour list is ever collected. Each round is a stored table.
    """
    edges = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = stored(small.filter("a <> b").distinct(), "edges")
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))


def following(ids: DataFrame) -> DataFrame:
    """(id, next_id) for the distinct ids of a one-column frame ``id``: the next larger id, null for the last.

    Ids are windowed in spans of 256 values; the first id of the span after next is found by the same step on the spans
    themselves. The last level has a 2**24th of the ids' range and is the only window without a partition.
    """

    def level(df: DataFrame, depth: int) -> DataFrame:
        if depth == LEVELS:
            return df.select("id", F.lead("id").over(Window.partitionBy(F.lit(0)).orderBy("id")).alias("next_id"))
        spans = df.withColumn("span", F.shiftright("id", SPAN_BITS))
        firsts = spans.groupBy("span").agg(F.min("id").alias("first"))
        nexts = level(firsts.select(F.col("span").alias("id")), depth + 1)
        after = nexts.join(firsts.select(F.col("span").alias("next_id"), F.col("first").alias("after")), "next_id").select(F.col("id").alias("span"), "after")
        inside = spans.withColumn("next_id", F.lead("id").over(Window.partitionBy("span").orderBy("id")))
        return inside.join(after, "span", "left").select("id", F.coalesce("next_id", "after").alias("next_id"))

    return level(ids.distinct(), 0)


def word_array(text: Column) -> Column:
    """The words of a text by built-in functions; none for null or blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
