"""Relational building blocks that more than one operator uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank: str = "position") -> DataFrame:
    """First ``n`` rows of each group in the given order, which must end in a unique column.

    Spark cuts each map task to ``n`` rows per group before the shuffle (WindowGroupLimit), so a hot group does not
    reach one task whole.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def count_by(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def with_share(counts: DataFrame, value: str, share: str, digits: int = 2) -> DataFrame:
    """Share of the grand total in percent. The total is a scalar subquery, so no task sees all rows."""
    everything = counts.agg(F.sum(value).cast("double")).scalar()
    return counts.withColumn(share, F.round(F.col(value).cast("double") / F.nullif(everything, F.lit(0.0)) * 100, digits))


def joined_list(value: str, order: str, separator: str = ",") -> Column:
    """Ordered string aggregation. The lists are key columns of one table or index, so they stay short."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return F.array_join(F.transform(pairs, lambda p: p["v"]), separator)


def ordered_distinct(array: Column) -> Column:
    """Distinct values in order of first occurrence."""
    return F.array_distinct(array)


def unshared(df: DataFrame) -> DataFrame:
    """The side of a join that grows with the input: both sides are dealt by key and merged.

    Spark takes a table made by ``inline`` or ``explode`` for as small as the rows it is made from, and would pass all of it through the
    driver to every task.
    """
    return df.hint("merge")


def keep_known(df: DataFrame, known: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys exist in the other table."""
    return df.join(unshared(known.select(*keys)), list(keys), "left_semi")


def insert_missing(existing: DataFrame, incoming: DataFrame, keys: list[str], id_column: str) -> DataFrame:
    """Existing rows plus the incoming ones whose key is new, with ids that follow the largest existing id."""
    new = incoming.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")
    return existing.unionByName(number_rows(new, keys, id_column, F.coalesce(existing.agg(F.max(id_column)).scalar(), F.lit(-1))))


def number_rows(df: DataFrame, keys: list[str], name: str, start: Column) -> DataFrame:
    """Dense numbers ``start + 1, start + 2, ...`` without sorting everything in one task.

    Rows are numbered inside 4,096 even buckets, the first three hex digits of a hash of the key, and shifted by the
    size of the buckets before theirs. The order is (bucket, key), so the numbers are the same on every run; the keys
    must be unique. Only the 4,096 bucket sizes are ever brought together.
    """
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    marked = df.withColumn("_bucket", F.left(F.md5(text), F.lit(3)))
    sizes = marked.groupBy("_bucket").agg(F.count("*").alias("_size"))
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_bucket", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(*keys))
    return (
        marked.withColumn("_row", inside)
        .join(F.broadcast(before), "_bucket")
        .withColumn(name, (start + F.col("_before") + F.col("_row")).cast("bigint"))
        .drop("_bucket", "_row", "_before")
    )
