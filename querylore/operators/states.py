"""States that add up: stored aggregates to which a batch is added without reading what was read before.

A state has a few rows a key; ``merged_*`` makes one row a key of any number of them, in any order, so states of batches, days or machines can
be put together at will. ``stores.KeyedTable.merge`` keeps them in place and rewrites touched buckets only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querylore.functions import sqltext as S
from querylore.operators.reports import item_counts

# --- sales: exact distinct customers of any period from states of days -----------------------------------------------

SALES_KEYS = ["order_date", "range"]
PERIODS = ("day", "week", "month", "quarter")
_COUNTS, _AMOUNTS = ["orders", "item_lines"], ["revenue", "line_revenue", "items_sold"]


def _sums() -> list[Column]:
    return [F.sum(name).alias(name) for name in _COUNTS + _AMOUNTS]


def _sales_row(states: DataFrame) -> DataFrame:
    """Fixed widths, so that merged sums have the type of what they are merged with."""
    return states.select(*SALES_KEYS, "customers", *_COUNTS, *[F.col(name).cast("decimal(38,4)").alias(name) for name in _AMOUNTS])


def counted_orders(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Confirmed orders that have items, with the number and quantity of these."""
    confirmed = orders.filter(F.col("status") >= 1).select("wo", "order_date", F.col("customer").cast("bigint").alias("customer"), "total")
    return confirmed.join(item_counts(items), "wo")


def sales_state(counted: DataFrame) -> DataFrame:
    """Counted orders as a row per day and range of 32,768 customer numbers: which customers of the range ordered, as a bitmap of 4 KB, and
    sums. An order goes to the range of its customer, so sums over the ranges of a day are those of the day; orders without a customer are in the
    range null. All of it is partial aggregation: a hot customer or day is a row a task. Customer numbers should be dense (as serial numbers are);
    a state grows with days times ranges, not with orders."""
    states = counted.groupBy("order_date", F.bitmap_bucket_number("customer").alias("range")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("customer")).alias("customers"), F.count("*").alias("orders"), F.sum("item_count").alias("item_lines"),
        F.sum("total").alias("revenue"), F.sum(F.col("total") * F.col("item_count")).alias("line_revenue"), F.sum("total_qty").alias("items_sold"))
    return _sales_row(states)


def merged_sales(states: DataFrame) -> DataFrame:
    """One row per day and range. Each order may be in one of the states only; customers may be in any number of them."""
    return _sales_row(states.groupBy(*SALES_KEYS).agg(F.bitmap_or_agg("customers").alias("customers"), *_sums()))


def _level(states: DataFrame, period: str) -> DataFrame:
    """States of days to those of a period, still by range: bitmaps are or-ed, sums added."""
    start = F.date_trunc(period, "order_date").cast("date")
    by_range = states.groupBy(start.alias("start"), "range").agg(F.bitmap_or_agg("customers").alias("customers"), *_sums())
    found = F.when(F.col("range").isNotNull(), F.bitmap_count("customers")).otherwise(0)
    return by_range.groupBy("start").agg(F.sum(found).alias("unique_customers"), *_sums()).select(
        F.lit(period).alias("period"), F.col("start").cast("string").alias("start"), "unique_customers", *_COUNTS, *_AMOUNTS)


def sales_of_periods(states: DataFrame, since: Column | None = None, periods: tuple[str, ...] = PERIODS) -> DataFrame:
    """Sales per day, week (Monday start), month and quarter from merged states: orders once, and (``line``) once per item line.

    Distinct customers are exact at every level because bitmaps of days are or-ed, which counts could not be. Give a stored state: every
    level reads it. Only days from ``since`` on are read if it is given.
    """
    kept = states if since is None else states.filter(F.col("order_date") >= since)
    levels = reduce(DataFrame.unionByName, [_level(kept, p) for p in periods])
    revenue, line_revenue = F.col("revenue").cast("double"), F.col("line_revenue").cast("double")
    return levels.select(
        "period", "start", F.col("orders").alias("order_count"), "unique_customers",
        revenue.alias("total_revenue"), (revenue / F.col("orders")).alias("average_order_value"),
        line_revenue.alias("total_line_revenue"), (line_revenue / F.col("item_lines")).alias("average_line_value"),
        F.col("items_sold").cast("double").alias("total_items_sold"))


# --- query logs: a growing catalog of unique queries -----------------------------------------------------------------

CATALOG_KEYS = ["hash"]


def _first() -> Column:
    return F.min(F.struct(F.col("query_id").isNull(), "query_id", "sql")).alias("first")


def query_state(extracted: DataFrame) -> DataFrame:
    """A row per hash: first id and its text, databases, number of files. Files without SQL are the row of the null hash, without a text. Of
    files with one id the smallest text is first, so the state does not depend on the order of files."""
    return extracted.groupBy("hash").agg(
        _first(), F.array_sort(F.collect_set("database")).alias("databases"), F.count("*").alias("files"),
    ).select("hash", "first.query_id", "first.sql", "databases", "files")


def merged_queries(states: DataFrame) -> DataFrame:
    """One row per hash. Databases are made distinct per state before lists meet, so a list holds names of databases only."""
    merged = states.groupBy("hash").agg(
        _first(), F.collect_set("databases").alias("lists"), F.sum("files").alias("files"))
    return merged.select("hash", "first.query_id", "first.sql", F.array_sort(F.array_distinct(F.flatten("lists"))).alias("databases"), "files")


def catalog_queries(state: DataFrame) -> DataFrame:
    """Unique queries, in the form that the operators on query logs take."""
    return (
        state.filter(F.col("hash").isNotNull())
        .withColumn("main_table", S.main_table(F.col("sql"))).withColumn("tables", S.from_and_join_tables(F.col("sql")))
    )


def catalog_counts(state: DataFrame) -> DataFrame:
    """Files, files with SQL, unique queries and removed duplicates of all batches so far."""
    has_sql = F.col("hash").isNotNull()
    return state.agg(
        F.coalesce(F.sum("files"), F.lit(0)).alias("total_files"), F.coalesce(F.sum(F.when(has_sql, F.col("files"))), F.lit(0)).alias("files_with_queries"),
        F.count(F.when(has_sql, 1)).alias("unique_queries"),
    ).select("total_files", F.col("total_files").alias("processed_files"), "files_with_queries", "unique_queries",
             (F.col("files_with_queries") - F.col("unique_queries")).alias("duplicates_removed"))
