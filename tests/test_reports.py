"""Null, zero and fan-out rules of the reports on literal rows."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from querylore.operators import pages as P
from querylore.operators import querylog as Q
from querylore.operators import relational as L
from querylore.operators import reports as R

ORDERS = "wo bigint, customer bigint, order_date date, total decimal(18,2), status int, salesperson bigint, priority string"
ITEMS = "wo bigint, item int, product bigint, qty decimal(18,2), subtotal decimal(18,2), stock bigint, ship_date date"
PRODUCTS = "product bigint, description string, category string, brand string, capacity_group int, reorder_point int, reorder_qty int, standard_cost decimal(18,2), status string"


def d(text):
    return dt.date.fromisoformat(text)


@pytest.fixture(scope="module")
def orders(spark):
    return spark.createDataFrame([
        (1, 1, d("2024-03-10"), D(100), 1, 0, "a"), (2, 1, d("2024-02-01"), D(50), 2, 0, "a"), (3, 2, d("2023-03-01"), D(40), 1, 1, "b"),
        (4, 2, d("2023-02-01"), D(0), 1, 1, "b"), (5, 3, d("2024-03-11"), D(9), 0, 11, "c")], ORDERS)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([
        (1, 1, 1, D(2), D(10), 1, d("2024-03-12")), (1, 2, 2, D(0), D(7), 1, d("2024-03-12")), (2, 1, 1, D(5), D(20), 1, d("2024-02-02")), (3, 1, 3, D(1), D(3), 1, d("2023-03-02"))], ITEMS)


@pytest.fixture(scope="module")
def products(spark):
    return spark.createDataFrame([(1, "p one", "x", "b", 1, 10, 20, D(4), "Active"), (2, "p two", "x", "b", 2, 1, 2, D(5), "Active"), (3, "p three", "y", "b", 3, 0, 1, D(6), "Retired"),
                                  (4, "p four", "y", "b", 4, 2, 1, D(6), "Active")], PRODUCTS)


@pytest.fixture(scope="module")
def customers(spark):
    return spark.createDataFrame([(1, "one", "t", "c", "s", "Active"), (2, "two", "t", "c", "s", "Active"), (3, "three", "t", "c", "s", "Active"), (4, "four", "t", "c", "s", "Closed"), (5, "five", "t", "c", "s", "Active")],
                                 "customer bigint, name string, type string, city string, state string, status string")


def test_year_over_year(orders):
    got = {r["month"]: (r["current_year_revenue"], r["previous_year_revenue"], r["percent_change"]) for r in R.year_over_year(orders).collect()}
    # a year without sales or with sales of zero gives no percentage
    assert got == {2: (50.0, 0.0, None), 3: (100.0, 40.0, 150.0)}


def test_fan_out(orders, items):
    assert R.newest(orders, "order_date") is not None
    one = {r["month"]: (r["order_count"], r["total_revenue"], r["average_order_value"]) for r in R.sales_by_period(orders, items).collect()}
    two = {r["month"]: (r["order_count"], r["total_revenue"], r["average_order_value"]) for r in R.sales_by_period(orders, items, fan_out=False).collect()}
    assert one == {2: (1, 50.0, 50.0), 3: (1, 200.0, 100.0)} and two == {2: (1, 50.0, 50.0), 3: (1, 100.0, 100.0)}
    assert {r["week_start"] for r in R.sales_by_period(orders, items, "week").collect()} == {"2024-03-04", "2024-01-29"}


def test_customer_activity(orders, items, customers):
    got = {r["customer"]: (r["total_orders"], r["total_revenue"], r["activity_status"], r["unique_products_purchased"]) for r in R.customer_activity(customers, orders, items).collect()}
    # customer 1 has an order with two lines; 2 has one without lines; 3 has no confirmed order; 5 none at all
    assert got == {1: (3, 250.0, "Active", 2), 2: (2, 40.0, "Inactive", 1), 3: (0, None, "Inactive", 0), 5: (0, None, "Inactive", 0)}


def test_inventory(spark, orders, items, products):
    stock = spark.createDataFrame([(1, D(30), "Available", 0), (1, D(99), "Hold", 0), (2, D(2), "Available", 0)], "product bigint, qty decimal(18,2), status string, warehouse bigint")
    got = {r["product"]: (r["available_qty"], r["stock_status"]) for r in R.inventory_status(products, stock, items, orders).collect()}
    assert got == {1: (23.0, "Adequate"), 2: (2.0, "Adequate"), 4: (0.0, "Reorder Needed")}
    lines = {(r["wo"], r["item"]): r["stock_status"] for r in R.lines_with_stock_status(orders, items, products, stock).collect()}
    assert lines == {(1, 1): "In Stock", (1, 2): "In Stock", (3, 1): "Out of Stock"}


def test_product_share_and_zero_quantity(orders, items, products):
    got = {r["product"]: (r["total_revenue"], r["average_unit_price"], r["revenue_percentage"]) for r in R.product_performance(products, items, orders).collect()}
    # product 2 was sold with quantity zero only and drops out; 3 is retired
    assert got == {1: (30.0, 4.5, 100.0)}


def test_related_and_codes(spark, products):
    assert {r["related_product"] for r in R.related_products(products, 1).collect()} == {2}
    row = spark.createDataFrame([("W=3;L=12",), ("W=;X",), (None,)], "a string").select(R.prompt_code(F.col("a"), "W"), R.prompt_code(F.col("a"), "L")).collect()
    assert [tuple(r) for r in row] == [("3", "12"), ("", None), (None, None)]


def test_tracking(orders, items, customers):
    got = {(r["order_number"], r["item_number"]): r["dependent_item"] for r in R.order_tracking(orders, items, customers, "2024-01-01").collect()}
    assert got == {(1, 1): "2", (1, 2): "No Dependencies"}


def test_optional_limits(orders, items, customers):
    assert R.orders_by_ranges(orders, items, customers).count() == 4
    assert R.orders_by_ranges(orders, items, customers, status=(2, None)).count() == 1
    assert R.orders_by_ranges(orders, items, customers, dates=(None, R.day("2023-12-31"))).count() == 1


def test_share_of_nothing(spark):
    assert L.with_share(spark.createDataFrame([("a", 0)], "k string, v int"), "v", "s").first()["s"] is None


def test_corpus_pages(spark):
    log = spark.createDataFrame([(1, "SELECT a FROM db_order o JOIN db_customer c ON o.k = c.k WHERE o.s = 1"), (2, "SELECT b FROM db_order WHERE s = 2"), (3, "SELECT c FROM other")], "query_id int, sql string")
    queries = P.page_input(Q.business_areas(Q.analyze_queries(log)))
    levels = [(r["complexity"], r["n"], r["pct"]) for r in P.category_levels(queries).filter("category = 'customer_management'").orderBy("level_no").collect()]
    assert levels == [("Low", 0, 0.0), ("Medium", 1, 100.0), ("High", 0, 0.0), ("Very High", 0, 0.0)]
    assert {(r["table_name"], r["total"]) for r in P.used_tables(queries).collect()} == {("db_order", 2)}
    assert {(r["table_name"], r["partner"], r["n"], r["pct"]) for r in P.table_partners(queries).collect()} == {("db_order", "db_customer", 1, 50.0)}
    assert {(r["column"], r["n"]) for r in P.table_filters(queries).collect()} == {("s", 2), ("k", 1)}
    page = {r["path"]: r["content"] for r in P.category_pages(queries).collect()}["query_patterns/customer_management.md"]
    assert page.startswith("# customer_management Queries\n\nThis document contains 1 queries") and "| Medium | 1 | 100.0% |" in page and "| [db_customer](../tables_usage/db_customer.md) | 1 | 100.0% |" in page
    assert "**Tables**: db_order, db_customer  \n**Description**: No description available  \n\n```sql\nSELECT a" in page
    index = P.index_page(queries).first()["content"]
    assert "from a repository of 3 queries.\n" in index and "| [db_order](tables_usage/db_order.md) | 2 |\n" in index
    known = spark.createDataFrame([("t", "db_order", "Orders")], "tenant string, table_name string, description string")
    usage = {r["path"]: r["content"] for r in P.table_usage_pages(queries, known).collect()}
    assert list(usage) == ["tables_usage/db_order.md"]
    text = usage["tables_usage/db_order.md"]
    assert text.startswith("# db_order Usage Documentation\n\nOrders\n\nSee [full schema documentation](../../schema/tables/db_order.md) for this table.\n\nThis document describes how the `db_order` table is used across 2 queries.")
    assert "| [db_customer](./db_customer.md) | 1 | 50.0% |" in text and "| s | 2 | 100.0% |" in text and text.count("```sql") == 2
    pair = spark.createDataFrame([("a_JOIN_b",)], "p string")
    assert tuple(pair.select(*[P.join_partner(F.col("p"), F.lit(x)) for x in "abc"]).first()) == ("b", "a", None)
    sample = Q.representative_sample(Q.business_areas(Q.analyze_queries(log)), 2).collect()
    assert len(sample) == 2 and len({r["query_id"] for r in sample}) == 2
