"""States that add up: any split into batches gives what one pass over all rows gives."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from querylore.operators import querylog as Q
from querylore.operators import states as A
from querylore.sources.stores import KeyedTable
from querylore.streaming import jobs as Z

COUNTED = "wo bigint, order_date date, customer bigint, total decimal(18,2), item_count bigint, total_qty decimal(28,2)"
FILES = "query_id bigint, fname string, content string"


def counted(spark):
    """Customers of several ranges, negative, zero and missing ones, repeated over days that lie in several weeks, months and quarters."""
    customers = [1, 1, 32768, 32769, 0, -5, -40000, None, 7_000_000_000, 1]
    rows = [(i, dt.date(2024, 1, 28) + dt.timedelta(days=i % 70), customers[i % 10], Decimal(i) + Decimal("0.25"), 1 + i % 4, Decimal(i % 9)) for i in range(300)]
    return spark.createDataFrame(rows, COUNTED)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def plain_sales(counted_rows):
    start = {"day": lambda d: d, "week": lambda d: d - dt.timedelta(days=d.weekday()), "month": lambda d: d.replace(day=1),
             "quarter": lambda d: d.replace(month=(d.month - 1) // 3 * 3 + 1, day=1)}
    out = []
    for period, first in start.items():
        groups = {}
        for r in counted_rows:
            groups.setdefault(first(r.order_date), []).append(r)
        for at, g in groups.items():
            once, lines = sum(r.total for r in g), sum(r.total * r.item_count for r in g)
            out.append((period, str(at), len(g), len({r.customer for r in g} - {None}), float(once), float(once) / len(g), float(lines),
                        float(lines) / sum(r.item_count for r in g), float(sum(r.total_qty for r in g))))
    return sorted(out, key=repr)


def test_distinct_customers_add_up(spark):
    orders = counted(spark)
    want = plain_sales(orders.collect())
    assert rows(A.sales_of_periods(A.sales_state(orders))) == want
    for parts in (2, 5):
        states = [A.sales_state(orders.filter(F.col("wo") % parts == i)) for i in range(parts)]
        merged = states[0]
        for state in states[1:]:
            merged = A.merged_sales(merged.unionByName(state))
        assert merged.schema.simpleString() == A.sales_state(orders).schema.simpleString() and rows(A.sales_of_periods(merged)) == want


def test_periods_from_a_date_and_without_orders(spark):
    state = A.sales_state(counted(spark))
    got = A.sales_of_periods(state, F.lit("2024-03-01").cast("date"), ("month",))
    assert sorted(r["start"] for r in got.collect()) == ["2024-03-01", "2024-04-01"]
    assert A.sales_of_periods(state.limit(0)).collect() == []


def test_levels_do_not_expand(spark):
    plan = A.sales_of_periods(A.sales_state(counted(spark)))._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan


def test_counted_orders(spark):
    orders = spark.sql("SELECT * FROM VALUES (1L, DATE '2024-01-01', 5L, 2.50, 1), (2L, DATE '2024-01-01', 5L, 1.00, 0), (3L, DATE '2024-01-01', 6L, 1.00, 1) AS t(wo, order_date, customer, total, status)")
    items = spark.sql("SELECT * FROM VALUES (1L, 2.0), (1L, 3.0), (2L, 9.0) AS t(wo, qty)")
    assert [tuple(r) for r in A.counted_orders(orders, items).select("wo", "item_count", "total_qty").collect()] == [(1, 2, Decimal("5.0"))]


def files(spark):
    def page(sql):
        return f"# Query\n## Embedding-Ready Query\n```sql\n{sql}\n```" if sql else "no sql"

    texts = ["SELECT a FROM x", "select  a from X", None, "SELECT b FROM y JOIN x ON 1 = 1", "", "SELECT 1"]
    return spark.createDataFrame([(100 - i, f"epic{i % 3}_query_{i}.md" if i % 5 else "odd.md", page(texts[i % 6])) for i in range(60)] + [(None, "odd.md", page(texts[0]))], FILES)


def test_catalog_grows_by_any_split(spark):
    extracted = Q.extract_sql(files(spark))
    whole = A.query_state(extracted)
    unique = Q.dedup_queries(extracted)
    shown = ["hash", "query_id", "sql", "databases", "files", "main_table", "tables"]
    want = rows(unique.select(shown))
    for parts in (1, 3, 7):
        numbered = extracted.withColumn("part", F.coalesce(F.col("query_id") % parts, F.lit(0)))
        states = [A.query_state(numbered.filter(F.col("part") == i)) for i in range(parts)]
        merged = states[0]
        for state in states[1:]:
            merged = A.merged_queries(state.unionByName(merged))
        assert merged.schema.simpleString() == whole.schema.simpleString()
        assert rows(A.catalog_queries(merged).select(shown)) == want
        assert rows(A.catalog_counts(merged)) == rows(Q.corpus_counts(extracted))
    assert rows(A.catalog_counts(whole.limit(0))) == [(0, 0, 0, 0, 0)]


def test_merge_counts_a_batch_once(spark, tmp_path):
    state = A.query_state(Q.extract_sql(files(spark)))
    table = KeyedTable.open(spark, str(tmp_path / "t"), state.schema, A.CATALOG_KEYS, 8)
    assert table.read().count() == 0 and table.merge(state, A.merged_queries, 0)
    once = rows(table.read())
    assert table.merge(state, A.merged_queries, 0) == [] and rows(table.read()) == once
    again = KeyedTable.open(spark, str(tmp_path / "t"), state.schema, A.CATALOG_KEYS, 8)
    assert again.applied == 0 and again.merge(state, A.merged_queries, 0) == []
    # a batch that fails leaves its number free
    with pytest.raises(Exception, match="stop"):
        again.merge(state.withColumn("sql", F.raise_error(F.lit("stop")).cast("string")), A.merged_queries, 1)
    assert again.applied == 0 and rows(KeyedTable(spark, str(tmp_path / "t")).read()) == once
    assert again.merge(state.limit(0), A.merged_queries, 1) == [] and KeyedTable(spark, str(tmp_path / "t")).applied == 1
    # the null key (files without SQL) is one row, and untouched buckets keep their version
    before = dict(again.versions)
    touched = again.merge(state.filter(F.col("hash").isNull()), A.merged_queries, 2)
    assert len(touched) == 1 and {b for b, v in again.versions.items() if before[b] != v} == set(touched)
    twice = {r["hash"]: r["files"] for r in again.read().collect()}
    assert twice == {r["hash"]: r["files"] * (2 if r["hash"] is None else 1) for r in state.collect()}


def test_catalog_of_a_stream(spark, tmp_path):
    source, path = str(tmp_path / "files"), str(tmp_path / "catalog")
    first, second = files(spark).filter("query_id > 70"), files(spark).filter("query_id <= 70 OR query_id IS NULL")
    first.repartition(3).write.parquet(source)

    def run():
        Z.growing_catalog(Z.arriving(spark, source, first.schema, files_per_batch=1), path, 8).awaitTermination()
        return rows(KeyedTable(spark, path).read())

    run()
    second.repartition(2).write.mode("append").parquet(source)
    want = rows(A.query_state(Q.extract_sql(files(spark))))
    assert run() == want and run() == want


def test_sales_of_a_stream(spark, tmp_path):
    source, path = str(tmp_path / "orders"), str(tmp_path / "sales")
    counted(spark).repartition(3).write.parquet(source)
    Z.growing_sales(Z.arriving(spark, source, counted(spark).schema, files_per_batch=2), path, 8).awaitTermination()
    assert rows(A.sales_of_periods(KeyedTable(spark, path).read())) == plain_sales(counted(spark).collect())
