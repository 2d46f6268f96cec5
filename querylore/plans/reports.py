"""Business reports and their DuckDB twins."""

from pyspark.sql import functions as F

from querylore.functions.columns import as_double, as_text, average, total
from querylore.operators import reports as R
from querylore.plans.registry import plan

SINCE = "2000-01-01"
ANCHOR = "(SELECT max(order_date) FROM db_order)"
YEAR_AGO = f"CAST({ANCHOR} - INTERVAL 12 MONTH AS DATE)"


@plan("b01_active_customers", "SELECT customer, name, city FROM db_customer WHERE status = 'Active'")
def _(t):
    return R.active_customers(t.db_customer)


@plan("b02_orders_of_month", """
SELECT wo, customer, CAST(order_date AS VARCHAR) AS order_date, CAST(total AS DOUBLE) AS total
FROM db_order WHERE order_date >= DATE '1999-04-01' AND order_date < DATE '1999-05-01' AND status = 1""")
def _(t):
    return R.orders_between(t.db_order, "1999-04-01", "1999-05-01", 1)


@plan("b03_monthly_summary", """
SELECT CAST(year(order_date) AS INT) AS year, CAST(month(order_date) AS INT) AS month, count(*) AS order_count,
  CAST(sum(total) AS DOUBLE) AS total_revenue, CAST(sum(total) AS DOUBLE) / count(*) AS average_order_value
FROM db_order WHERE status >= 1 GROUP BY 1, 2""")
def _(t):
    return R.monthly_summary(t.db_order)


@plan("b04_orders_with_customer", f"""
SELECT o.wo, CAST(o.order_date AS VARCHAR) AS order_date, c.name AS customer_name, CAST(o.total AS DOUBLE) AS total
FROM db_order o JOIN db_customer c ON o.customer = c.customer WHERE o.order_date >= DATE '{SINCE}'""")
def _(t):
    return R.orders_with_customer(t.db_order, t.db_customer, SINCE)


@plan("b05_complete_order_lines", f"""
SELECT o.wo AS order_number, c.name AS customer_name, i.item, p.description AS product_description,
  CAST(i.qty AS DOUBLE) AS quantity, CAST(i.subtotal AS DOUBLE) AS line_total, CAST(o.total AS DOUBLE) AS order_total,
  s.description AS order_status
FROM db_order o JOIN db_customer c ON o.customer = c.customer JOIN db_orderitem i ON o.wo = i.wo
JOIN db_product p ON i.product = p.product JOIN db_status s ON o.status = s.status AND s.type = 'ORDER'
WHERE o.order_date >= DATE '{SINCE}'""")
def _(t):
    return R.complete_order_lines(t.db_order, t.db_customer, t.db_orderitem, t.db_product, t.db_status, SINCE)


@plan("b06_orders_with_shipping", f"""
SELECT o.wo, c.name AS customer_name, CAST(o.total AS DOUBLE) AS total, coalesce(s.tracking, 'Not Shipped') AS tracking,
  coalesce(CAST(s.ship_date AS VARCHAR), 'Pending') AS ship_date
FROM db_order o JOIN db_customer c ON o.customer = c.customer LEFT JOIN db_shipping s ON o.wo = s.wo
WHERE o.order_date >= DATE '{SINCE}'""")
def _(t):
    return R.orders_with_shipping(t.db_order, t.db_customer, t.db_shipping, SINCE)


@plan("b07_orders_with_item_counts", f"""
SELECT o.wo, c.name AS customer_name, CAST(o.total AS DOUBLE) AS total, n.item_count, CAST(n.total_qty AS DOUBLE) AS total_qty
FROM db_order o JOIN db_customer c ON o.customer = c.customer
JOIN (SELECT wo, count(*) AS item_count, sum(qty) AS total_qty FROM db_orderitem GROUP BY wo) n ON o.wo = n.wo
WHERE o.order_date >= DATE '{SINCE}'""")
def _(t):
    return R.orders_with_item_counts(t.db_order, t.db_customer, t.db_orderitem, SINCE)


@plan("b08_related_products", """
SELECT p1.product AS main_product, p1.description AS main_description, p2.product AS related_product,
  p2.description AS related_description
FROM db_product p1 JOIN db_product p2 ON p1.category = p2.category AND p1.product <> p2.product WHERE p1.product = 1""")
def _(t):
    return R.related_products(t.db_product, 1)


@plan("b09_customers_with_large_order", f"""
SELECT DISTINCT c.customer, c.name, CAST(l.m AS DOUBLE) AS max_order_value FROM db_customer c
JOIN (SELECT customer, max(total) AS m FROM db_order WHERE order_date >= DATE '{SINCE}' GROUP BY customer
      HAVING max(total) > 300000) l ON c.customer = l.customer""")
def _(t):
    return R.customers_with_large_order(t.db_order, t.db_customer, SINCE, 300000)


@plan("b10_lines_with_stock_status", """
SELECT o.wo, i.item, p.description, CAST(i.qty AS DOUBLE) AS ordered_qty, CAST(coalesce(v.q, 0) AS DOUBLE) AS available_qty,
  CASE WHEN coalesce(v.q, 0) >= i.qty THEN 'In Stock' WHEN coalesce(v.q, 0) > 0 THEN 'Partial Stock' ELSE 'Out of Stock' END AS stock_status
FROM db_order o JOIN db_orderitem i ON o.wo = i.wo JOIN db_product p ON i.product = p.product
LEFT JOIN (SELECT product, sum(qty) AS q FROM db_stock WHERE status = 'Available' GROUP BY product) v ON p.product = v.product
WHERE o.status = 1""")
def _(t):
    return R.lines_with_stock_status(t.db_order, t.db_orderitem, t.db_product, t.db_stock)


def _period_sql(keys: str, groups: str) -> str:
    return f"""
SELECT {keys}, count(DISTINCT o.wo) AS order_count, count(DISTINCT o.customer) AS unique_customers,
  CAST(sum(o.total) AS DOUBLE) AS total_revenue, CAST(sum(o.total) AS DOUBLE) / count(*) AS average_order_value,
  CAST(sum(i.qty) AS DOUBLE) AS total_items_sold
FROM db_order o JOIN db_orderitem i ON o.wo = i.wo
WHERE o.status >= 1 AND o.order_date >= {YEAR_AGO} GROUP BY {groups}"""


MONTH_KEYS = "CAST(year(o.order_date) AS INT) AS year, CAST(month(o.order_date) AS INT) AS month, monthname(o.order_date) AS month_name"


@plan("b11_monthly_sales", _period_sql(MONTH_KEYS, "1, 2, 3"))
def _(t):
    return R.sales_by_period(t.db_order, t.db_orderitem)


@plan("b11_daily_sales", _period_sql("CAST(o.order_date AS VARCHAR) AS day", "1"))
def _(t):
    return R.sales_by_period(t.db_order, t.db_orderitem, "day")


@plan("b11_weekly_sales", _period_sql("CAST(CAST(date_trunc('week', o.order_date) AS DATE) AS VARCHAR) AS week_start", "1"))
def _(t):
    return R.sales_by_period(t.db_order, t.db_orderitem, "week")


@plan("b11_quarterly_sales", _period_sql("CAST(year(o.order_date) AS INT) AS year, CAST(quarter(o.order_date) AS INT) AS quarter", "1, 2"))
def _(t):
    return R.sales_by_period(t.db_order, t.db_orderitem, "quarter")


@plan("b11_monthly_sales_per_order", f"""
SELECT {MONTH_KEYS}, count(DISTINCT o.wo) AS order_count, count(DISTINCT o.customer) AS unique_customers,
  CAST(sum(o.total) AS DOUBLE) AS total_revenue, CAST(sum(o.total) AS DOUBLE) / count(*) AS average_order_value,
  CAST(sum(i.q) AS DOUBLE) AS total_items_sold
FROM db_order o JOIN (SELECT wo, sum(qty) AS q FROM db_orderitem GROUP BY wo) i ON o.wo = i.wo
WHERE o.status >= 1 AND o.order_date >= {YEAR_AGO} GROUP BY 1, 2, 3""")
def _(t):
    return R.sales_by_period(t.db_order, t.db_orderitem, "month", fan_out=False)


@plan("b12_top_customers", f"""
SELECT c.customer, c.name AS customer_name, c.city, c.state, count(o.wo) AS order_count, CAST(sum(o.total) AS DOUBLE) AS total_revenue,
  CAST(sum(o.total) AS DOUBLE) / count(*) AS average_order_value, CAST(max(o.order_date) AS VARCHAR) AS last_order_date,
  CAST(date_diff('day', max(o.order_date), {ANCHOR}) AS INT) AS days_since_last_order
FROM db_customer c JOIN db_order o ON c.customer = o.customer WHERE o.order_date >= {YEAR_AGO} AND o.status >= 1
GROUP BY c.customer, c.name, c.city, c.state HAVING sum(o.total) > 0 ORDER BY sum(o.total) DESC, c.customer LIMIT 10""")
def _(t):
    return R.top_customers(t.db_order, t.db_customer)


def _top_sql(key: str, source: str) -> str:
    return f"""
SELECT {source}.{key}, count(*) AS line_count, CAST(sum(i.subtotal) AS DOUBLE) AS total_revenue
FROM db_order o JOIN db_orderitem i ON o.wo = i.wo JOIN db_product p ON i.product = p.product
WHERE o.order_date >= {YEAR_AGO} AND o.status >= 1 GROUP BY {source}.{key} HAVING sum(i.subtotal) > 0
ORDER BY CAST(sum(i.subtotal) AS DOUBLE) DESC, {source}.{key} LIMIT 10"""


@plan("b12_top_products", _top_sql("product", "i"))
def _(t):
    return R.top_by(t.db_order, t.db_orderitem, t.db_product, "product")


@plan("b12_top_salespeople", _top_sql("salesperson", "o"))
def _(t):
    return R.top_by(t.db_order, t.db_orderitem, t.db_product, "salesperson")


@plan("b12_top_categories", _top_sql("category", "p"))
def _(t):
    return R.top_by(t.db_order, t.db_orderitem, t.db_product, "category").withColumn("line_count", F.col("line_count").cast("bigint"))


@plan("b13_year_over_year", f"""
SELECT c.month, c.month_name, c.r AS current_year_revenue, p.r AS previous_year_revenue,
  round((c.r - p.r) / nullif(p.r, 0) * 100, 2) AS percent_change, c.n AS current_year_orders, p.n AS previous_year_orders
FROM (SELECT CAST(month(order_date) AS INT) AS month, monthname(order_date) AS month_name, CAST(sum(total) AS DOUBLE) AS r, count(*) AS n
      FROM db_order WHERE year(order_date) = year({ANCHOR}) AND status >= 1 GROUP BY 1, 2) c
LEFT JOIN (SELECT CAST(month(order_date) AS INT) AS month, CAST(sum(total) AS DOUBLE) AS r, count(*) AS n
      FROM db_order WHERE year(order_date) = year({ANCHOR}) - 1 AND status >= 1 GROUP BY 1) p ON c.month = p.month""")
def _(t):
    return R.year_over_year(t.db_order)


@plan("b14_inventory_status", """
WITH on_hand AS (SELECT product, sum(qty) AS q FROM db_stock WHERE status = 'Available' GROUP BY product),
held AS (SELECT i.product, sum(i.qty) AS q FROM db_orderitem i JOIN db_order o ON i.wo = o.wo WHERE o.status IN (1, 2) GROUP BY i.product),
x AS (SELECT p.*, coalesce(h.q, 0) AS have, coalesce(r.q, 0) AS res, coalesce(h.q, 0) - coalesce(r.q, 0) AS free
  FROM db_product p LEFT JOIN on_hand h ON p.product = h.product LEFT JOIN held r ON p.product = r.product WHERE p.status = 'Active')
SELECT product, description, category, CAST(have AS DOUBLE) AS on_hand_qty, CAST(res AS DOUBLE) AS reserved_qty,
  CAST(free AS DOUBLE) AS available_qty, reorder_point, reorder_qty,
  CASE WHEN free <= reorder_point THEN 'Reorder Needed' WHEN free <= reorder_point * 1.5 THEN 'Low Stock' ELSE 'Adequate' END AS stock_status
FROM x""")
def _(t):
    return R.inventory_status(t.db_product, t.db_stock, t.db_orderitem, t.db_order)


@plan("b15_customer_activity", f"""
SELECT c.customer, c.name AS customer_name, c.type AS customer_type, count(o.wo) AS total_orders,
  CAST(sum(o.total) AS DOUBLE) AS total_revenue, CAST(sum(o.total) AS DOUBLE) / nullif(count(o.wo), 0) AS average_order_value,
  CAST(min(o.order_date) AS VARCHAR) AS first_order_date, CAST(max(o.order_date) AS VARCHAR) AS last_order_date,
  CAST(date_diff('day', min(o.order_date), max(o.order_date)) AS INT) AS customer_lifespan_days,
  CASE WHEN max(o.order_date) >= {ANCHOR} - 30 THEN 'Active' WHEN max(o.order_date) >= {ANCHOR} - 90 THEN 'Recent'
       WHEN max(o.order_date) >= {ANCHOR} - 365 THEN 'Dormant' ELSE 'Inactive' END AS activity_status,
  count(DISTINCT i.product) AS unique_products_purchased
FROM db_customer c LEFT JOIN db_order o ON c.customer = o.customer AND o.status >= 1 LEFT JOIN db_orderitem i ON o.wo = i.wo
WHERE c.status = 'Active' GROUP BY c.customer, c.name, c.type""")
def _(t):
    return R.customer_activity(t.db_customer, t.db_order, t.db_orderitem)


@plan("b16_product_performance", f"""
SELECT p.product, p.description, p.category, count(DISTINCT i.wo) AS orders_containing, CAST(sum(i.qty) AS DOUBLE) AS total_quantity_sold,
  CAST(sum(i.subtotal) AS DOUBLE) AS total_revenue, CAST(sum(CAST(CAST(i.subtotal AS DOUBLE) / nullif(CAST(i.qty AS DOUBLE), 0) AS DECIMAL(28,10))) AS DOUBLE) / nullif(count(*) FILTER (WHERE i.qty <> 0), 0) AS average_unit_price,
  count(DISTINCT o.customer) AS unique_customers, CAST(min(o.order_date) AS VARCHAR) AS first_sale_date,
  CAST(max(o.order_date) AS VARCHAR) AS last_sale_date,
  round(CAST(sum(i.subtotal) AS DOUBLE) / CAST(sum(sum(i.subtotal)) OVER () AS DOUBLE) * 100, 2) AS revenue_percentage
FROM db_product p JOIN db_orderitem i ON p.product = i.product JOIN db_order o ON i.wo = o.wo
WHERE o.order_date >= {YEAR_AGO} AND o.status >= 1 AND p.status = 'Active'
GROUP BY p.product, p.description, p.category HAVING sum(i.qty) > 0""")
def _(t):
    return R.product_performance(t.db_product, t.db_orderitem, t.db_order)


@plan("b17_export_format", """
SELECT wo, strftime(order_date, '%Y-%m-%d') AS order_date, format('{:,.2f}', CAST(total AS DOUBLE)) AS formatted_total FROM db_order""")
def _(t):
    return R.export_format(t.db_order)


_COSTED = """
WITH costed AS (SELECT o.wo, i.item, i.ship_date, p.description, i.qty, i.subtotal,
    CAST(p.standard_cost AS DOUBLE) * (CAST(i.qty AS DOUBLE) / (1 + i.product % 4)) AS cost
  FROM db_order o JOIN db_orderitem i ON o.wo = i.wo JOIN db_product p ON i.product = p.product
  JOIN db_customer c ON o.customer = c.customer JOIN db_status s ON o.status = s.status AND s.type = 'ORDER'
  WHERE o.status >= 1)"""
_COST_COLUMNS = """min(description) AS product, CAST(min(qty) AS DOUBLE) AS qty, CAST(min(subtotal) AS DOUBLE) AS unit_price,
  CAST(sum(CAST(cost / nullif(CAST(qty AS DOUBLE), 0) AS DECIMAL(28,10))) AS DOUBLE) AS unit_cost, CAST(min(subtotal * qty) AS DOUBLE) AS line_price,
  CAST(sum(CAST(cost AS DECIMAL(28,10))) AS DOUBLE) AS line_cost"""


@plan("b18_order_cost_by_box", f"{_COSTED} SELECT CAST(ship_date AS VARCHAR) AS box, wo, item, {_COST_COLUMNS} FROM costed GROUP BY ship_date, wo, item")
def _(t):
    return R.order_cost(t.db_order, t.db_orderitem, t.db_product, t.db_customer, t.db_status, by_box=True)


@plan("b18_order_cost_by_line", f"{_COSTED} SELECT wo, item, {_COST_COLUMNS} FROM costed GROUP BY wo, item")
def _(t):
    return R.order_cost(t.db_order, t.db_orderitem, t.db_product, t.db_customer, t.db_status, by_box=False)


@plan("b18_order_cost_by_order", f"""{_COSTED}
SELECT wo, count(*) AS lines, CAST(sum(CAST(cost AS DECIMAL(28,10))) AS DOUBLE) AS order_cost, CAST(sum(subtotal) AS DOUBLE) AS order_price FROM costed GROUP BY wo""")
def _(t):
    return R.batch_cost(t.db_order, t.db_orderitem, t.db_product)


def _scan_sql(customer: str) -> str:
    extra = f" AND o.customer = {customer}" if customer else ""
    return f"""
SELECT '2000-01-01 - 2000-03-31' AS search, CAST(i.ship_date AS VARCHAR) AS ship_date, c.name,
  CAST(o.wo AS VARCHAR) || '-' || CAST(i.item AS VARCHAR) AS scan, o.wo, i.item, CAST(i.qty AS DOUBLE) AS qty,
  CAST(p.capacity_group AS DOUBLE) AS width, CAST(p.reorder_qty AS DOUBLE) AS length,
  CASE WHEN i.product IN (1, 2, 3) THEN 'Si' ELSE '' END AS no_tools, i.stock, p.description
FROM db_order o JOIN db_orderitem i ON o.wo = i.wo JOIN db_product p ON i.product = p.product JOIN db_customer c ON o.customer = c.customer
WHERE i.ship_date BETWEEN DATE '2000-01-01' AND DATE '2000-03-31' AND o.status >= 1{extra}"""


@plan("b19_box_scan_list", _scan_sql(""))
def _(t):
    return R.box_scan_list(t.db_order, t.db_orderitem, t.db_product, t.db_customer, "2000-01-01", "2000-03-31")


@plan("b19_box_scan_list_one_customer", _scan_sql("5"))
def _(t):
    return R.box_scan_list(t.db_order, t.db_orderitem, t.db_product, t.db_customer, "2000-01-01", "2000-03-31", customer="5")


@plan("b20_open_lines", """
SELECT o.salesperson AS batch, CAST(o.order_date AS VARCHAR) AS order_date, o.status, o.wo, i.item, CAST(i.qty AS DOUBLE) AS qty,
  i.stock, i.product, p.description, p.category
FROM db_order o JOIN db_orderitem i ON o.wo = i.wo JOIN db_product p ON i.product = p.product
WHERE o.status IN (0, 1, 2) AND i.qty - CASE WHEN o.status = 0 THEN i.qty ELSE 0 END - CASE WHEN i.item = 7 THEN i.qty ELSE 0 END > 0
  AND p.description LIKE '%ring%' AND p.capacity_group BETWEEN 1 AND 40""")
def _(t):
    return R.open_lines(t.db_order, t.db_orderitem, t.db_product)


@plan("b21_sales_by_salesperson", """
SELECT o.salesperson, s.first_name || ' ' || s.name AS name, p.capacity_group, i.product, p.description AS product_description,
  CAST(sum(i.subtotal * i.qty) AS DOUBLE) AS sales_total
FROM db_order o JOIN db_orderitem i ON o.wo = i.wo JOIN db_product p ON i.product = p.product
LEFT JOIN db_salesperson s ON o.salesperson = s.salesperson
WHERE o.order_date BETWEEN DATE '1999-01-01' AND DATE '2000-12-31' AND o.salesperson BETWEEN 0 AND 9 AND o.status <> 1
  AND (o.total > 100000 OR i.product BETWEEN 1 AND 100) AND p.capacity_group BETWEEN 1 AND 40
GROUP BY o.salesperson, 2, p.capacity_group, i.product, p.description""")
def _(t):
    return R.sales_by_salesperson(t.db_order, t.db_orderitem, t.db_product, t.db_salesperson, "1999-01-01", "2000-12-31", 100000)


@plan("b22_sales_by_site", """
SELECT o.salesperson % 3 AS site, p.capacity_group, p.category AS group_description, i.product, p.description AS product_description,
  count(DISTINCT o.wo) AS invoice_count, CAST(sum(i.subtotal * i.qty) AS DOUBLE) AS sales_total
FROM db_order o JOIN db_orderitem i ON o.wo = i.wo JOIN db_product p ON i.product = p.product
WHERE o.order_date BETWEEN DATE '1999-01-01' AND DATE '2000-12-31' AND o.status <> 1 AND o.total > 0
GROUP BY 1, 2, 3, 4, 5""")
def _(t):
    return R.sales_by_site(t.db_order, t.db_orderitem, t.db_product, "1999-01-01", "2000-12-31")


@plan("b23_invoices_of_period", """
SELECT o.wo AS invoice, min(o.status) AS status, CAST(min(o.order_date) AS VARCHAR) AS order_date, min(strftime(o.order_date, '%Y%m')) AS gl_period,
  min(o.customer) AS customer, CAST(min(o.total) AS DOUBLE) AS total, min(o.salesperson) AS salesperson
FROM db_order o JOIN db_orderitem i ON o.wo = i.wo JOIN db_product p ON i.product = p.product
WHERE o.order_date BETWEEN DATE '1999-01-01' AND DATE '1999-12-31' AND o.status = 0 GROUP BY o.wo""")
def _(t):
    return R.invoices_of_period(t.db_order, t.db_orderitem, t.db_product, "1999-01-01", "1999-12-31")


@plan("b24_stock_on_hand", """
SELECT p.product, p.description, CAST(sum(s.qty) AS DOUBLE) AS on_hand_qty
FROM db_product p LEFT JOIN db_stock s ON p.product = s.product GROUP BY p.product, p.description""")
def _(t):
    return R.stock_on_hand(t.db_product, t.db_stock)


@plan("b25_order_tracking", f"""
WITH lines AS (SELECT DISTINCT wo, item FROM db_orderitem)
SELECT o.wo AS order_number, c.name AS customer_name, l.item AS item_number,
  coalesce(CAST(d.item AS VARCHAR), 'No Dependencies') AS dependent_item, CAST(o.order_date AS VARCHAR) AS order_date,
  CAST(CAST(o.order_date + 30 AS DATE) AS VARCHAR) AS required_date
FROM db_order o JOIN lines l ON o.wo = l.wo LEFT JOIN lines d ON d.wo = l.wo AND d.item = l.item + 1
JOIN db_customer c ON o.customer = c.customer
WHERE o.status BETWEEN 1 AND 3 AND o.order_date >= DATE '{SINCE}' AND o.order_date + 30 >= {ANCHOR}""")
def _(t):
    return R.order_tracking(t.db_order, t.db_orderitem, t.db_customer, SINCE)


# Each pair of forms must give the same rows. Both forms are summarised so that a difference shows.
_PAIRS = {
    "range_or_function": ("SELECT wo, total FROM db_order WHERE order_date >= DATE '1999-01-01' AND order_date < DATE '2000-01-01'",
                          "SELECT wo, total FROM db_order WHERE year(order_date) = 1999"),
    "in_or_or": ("SELECT wo, total FROM db_order WHERE priority IN ('1-URGENT', '2-HIGH', '5-LOW')",
                 "SELECT wo, total FROM db_order WHERE priority = '1-URGENT' OR priority = '2-HIGH' OR priority = '5-LOW'"),
    "exists_or_distinct": (f"SELECT c.customer AS wo, 1 AS total FROM db_customer c WHERE EXISTS (SELECT 1 FROM db_order o WHERE o.customer = c.customer AND o.order_date >= DATE '{SINCE}')",
                           f"SELECT DISTINCT c.customer AS wo, 1 AS total FROM db_customer c JOIN db_order o ON c.customer = o.customer WHERE o.order_date >= DATE '{SINCE}'"),
    "subquery_or_where": (f"SELECT o.wo, o.total FROM (SELECT wo, customer, total FROM db_order WHERE order_date >= DATE '{SINCE}' AND status = 1) o JOIN db_customer c ON o.customer = c.customer",
                          f"SELECT o.wo, o.total FROM db_order o JOIN db_customer c ON o.customer = c.customer WHERE o.order_date >= DATE '{SINCE}' AND o.status = 1"),
    "unused_join": (f"SELECT wo, total FROM db_order WHERE order_date >= DATE '{SINCE}'",
                    f"SELECT o.wo, o.total FROM db_order o JOIN db_customer c ON o.customer = c.customer WHERE o.order_date >= DATE '{SINCE}'"),
}


def _pair_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS pair, '{form}' AS form, count(*) AS n, CAST(sum(wo) AS BIGINT) AS key_sum, CAST(sum(total) AS DOUBLE) AS amount FROM ({sql}) x_{name}_{form}"
        for name, forms in _PAIRS.items() for form, sql in zip(("first", "second"), forms)
    )


@plan("b26_rewrite_pairs", _pair_sql())
def _(t):
    orders, customers = t.db_order, t.db_customer
    since = F.col("order_date") >= R.day(SINCE)
    listed = ("1-URGENT", "2-HIGH", "5-LOW")
    either = (F.col("priority") == listed[0]) | (F.col("priority") == listed[1]) | (F.col("priority") == listed[2])
    buyers = customers.select(F.col("customer"), F.lit(1).alias("total"))
    pairs = {
        "range_or_function": (orders.filter(R.year_range("order_date", 1999)), orders.filter(F.year("order_date") == 1999)),
        "in_or_or": (orders.filter(F.col("priority").isin(*listed)), orders.filter(either)),
        "exists_or_distinct": (
            buyers.join(orders.filter(since).select("customer"), "customer", "left_semi").withColumnRenamed("customer", "wo"),
            buyers.join(orders.filter(since).select("customer"), "customer").distinct().withColumnRenamed("customer", "wo"),
        ),
        "subquery_or_where": (
            orders.filter(since & (F.col("status") == 1)).select("wo", "customer", "total").join(customers.select("customer"), "customer"),
            orders.join(customers.select("customer"), "customer").filter(since & (F.col("status") == 1)),
        ),
        "unused_join": (orders.filter(since), orders.filter(since).join(customers.select("customer"), "customer")),
    }
    parts = [
        side.agg(F.count("*").alias("n"), F.sum("wo").alias("key_sum"), total("total", "amount"))
        .select(F.lit(name).alias("pair"), F.lit(form).alias("form"), "n", "key_sum", "amount")
        for name, sides in pairs.items() for form, side in zip(("first", "second"), sides)
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _page(df):
    return df.select("wo", as_text("order_date"), as_double("total"))


@plan("b27_first_page", """
SELECT wo, CAST(order_date AS VARCHAR) AS order_date, CAST(total AS DOUBLE) AS total FROM db_order
ORDER BY db_order.order_date DESC, wo LIMIT 10""")
def _(t):
    return _page(t.db_order.orderBy(F.desc("order_date"), "wo").limit(10))


@plan("b27_offset_page", """
SELECT wo, CAST(order_date AS VARCHAR) AS order_date, CAST(total AS DOUBLE) AS total FROM db_order
ORDER BY db_order.order_date DESC, wo LIMIT 20 OFFSET 100""")
def _(t):
    return _page(t.db_order.orderBy(F.desc("order_date"), "wo").offset(100).limit(20))


@plan("b27_keyset_page", """
SELECT wo, CAST(order_date AS VARCHAR) AS order_date, CAST(total AS DOUBLE) AS total FROM db_order
WHERE order_date < DATE '2000-03-15' OR (order_date = DATE '2000-03-15' AND wo > 100)
ORDER BY db_order.order_date DESC, wo LIMIT 20""")
def _(t):
    last = R.day("2000-03-15")
    after = (F.col("order_date") < last) | ((F.col("order_date") == last) & (F.col("wo") > 100))
    return _page(t.db_order.filter((F.col("order_date") <= last) & after).orderBy(F.desc("order_date"), "wo").limit(20))


@plan("b28_filter_aggregate_having", f"""
SELECT customer, count(*) AS order_count, CAST(sum(total) AS DOUBLE) AS total_revenue, CAST(sum(total) AS DOUBLE) / count(*) AS average_order_value
FROM db_order WHERE order_date >= DATE '{SINCE}' AND status = 1 GROUP BY customer HAVING count(*) > 1""")
def _(t):
    return (
        t.db_order.filter((F.col("order_date") >= R.day(SINCE)) & (F.col("status") == 1)).groupBy("customer")
        .agg(F.count("*").alias("order_count"), total("total", "total_revenue"), average("total", "average_order_value"))
        .filter(F.col("order_count") > 1)
    )


@plan("b29_companies_with_application", """
SELECT 'C' || CAST(c.customer AS VARCHAR) AS company_code, c.name AS company_name, a.name AS application
FROM db_customer c JOIN application a ON c.customer % 5 = a.company_id""")
def _(t):
    companies = t.db_customer.select("customer", F.col("name").alias("company_name"), (F.col("customer") % 5).alias("company_id"))
    return (
        companies.join(t.application.select("company_id", F.col("name").alias("application")), "company_id")
        .select(F.concat(F.lit("C"), F.col("customer").cast("string")).alias("company_code"), "company_name", "application")
    )


@plan("b30_orders_by_ranges", """
SELECT o.wo, c.name, i.item, CAST(o.order_date AS VARCHAR) AS order_date
FROM db_order o JOIN db_orderitem i ON o.wo = i.wo JOIN db_customer c ON o.customer = c.customer
WHERE o.status >= 1 AND o.status <= 2 AND o.order_date BETWEEN DATE '1999-01-01' AND DATE '1999-06-30'""")
def _(t):
    return R.orders_by_ranges(t.db_order, t.db_orderitem, t.db_customer, (1, 2), (R.day("1999-01-01"), R.day("1999-06-30")))


@plan("b31_rows_with_scalar_lookup", """
SELECT 'C' || CAST(customer AS VARCHAR) AS company_code, name AS company_name,
  (SELECT company_id FROM application WHERE name = 'epic') AS application_id FROM db_customer""")
def _(t):
    epic = t.application.filter(F.col("name") == "epic").select("company_id").scalar()
    return t.db_customer.select(
        F.concat(F.lit("C"), F.col("customer").cast("string")).alias("company_code"), F.col("name").alias("company_name"),
        epic.alias("application_id"),
    )
