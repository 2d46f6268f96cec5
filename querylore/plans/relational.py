"""Predicates, joins, aggregates, windows, sorts and set operations, each over whole tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from querylore.functions.columns import as_double, as_text, average, count_if, exact_sum, mean_of, percent, percent_text, quotient, total
from querylore.operators import relational as L
from querylore.operators import reports as R
from querylore.plans.registry import plan

SINCE = "2000-01-01"
ORDER = "wo, customer, CAST(total AS DOUBLE) AS total"


def _orders(df):
    return df.select("wo", "customer", as_double("total"))


# --- predicates -----------------------------------------------------------------------------------------------------

@plan("p01_projection_alias", "SELECT wo AS order_number, customer AS buyer, CAST(total AS DOUBLE) AS amount FROM db_order")
def _(t):
    return t.db_order.select(F.col("wo").alias("order_number"), F.col("customer").alias("buyer"), as_double("total", "amount"))


@plan("p02_equality_and_range", f"SELECT {ORDER} FROM db_order WHERE status = 1 AND order_date >= DATE '1999-01-01' AND order_date < DATE '1999-07-01'")
def _(t):
    return _orders(t.db_order.filter((F.col("status") == 1) & (F.col("order_date") >= R.day("1999-01-01")) & (F.col("order_date") < R.day("1999-07-01"))))


@plan("p03_between", f"SELECT {ORDER} FROM db_order WHERE order_date BETWEEN DATE '1999-01-01' AND DATE '1999-12-31' AND total BETWEEN 1000 AND 200000")
def _(t):
    return _orders(t.db_order.filter(F.col("order_date").between(R.day("1999-01-01"), R.day("1999-12-31")) & F.col("total").between(1000, 200000)))


@plan("p03_between_timestamps", """
SELECT event_type, count(*) AS n FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY event_type""")
def _(t):
    # a day range on the timestamp itself, so that the bounds reach the file scan
    inside = (F.col("ts") >= F.lit("2024-01-05").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-21").cast("timestamp_ntz"))
    return L.count_by(t.events.filter(inside), "event_type")


@plan("p04_in_list", f"SELECT {ORDER} FROM db_order WHERE priority = '1-URGENT' OR priority = '2-HIGH'")
def _(t):
    return _orders(t.db_order.filter(F.col("priority").isin("1-URGENT", "2-HIGH")))


@plan("p05_or_mixed", f"SELECT {ORDER} FROM db_order WHERE total > 350000 OR order_date BETWEEN DATE '1998-03-01' AND DATE '1998-03-15'")
def _(t):
    return _orders(t.db_order.filter((F.col("total") > 350000) | F.col("order_date").between(R.day("1998-03-01"), R.day("1998-03-15"))))


@plan("p06_not_equal", f"SELECT {ORDER} FROM db_order WHERE status <> 1 AND priority != '5-LOW'")
def _(t):
    return _orders(t.db_order.filter((F.col("status") != 1) & (F.col("priority") != "5-LOW")))


@plan("p07_like", """
SELECT product, description, description LIKE '%ring%' AS has_ring FROM db_product
WHERE description LIKE 'large%' OR description LIKE '%ring%'""")
def _(t):
    name = F.col("description")
    return t.db_product.filter(name.startswith("large") | name.contains("ring")).select("product", "description", name.contains("ring").alias("has_ring"))


def optional_equals(df, column: str, value: str):
    """No filter at all when the parameter is empty."""
    return df if value == "" else df.filter(F.col(column) == value)


@plan("p08_optional_parameter", """
SELECT 'empty' AS parameter, count(*) AS n FROM db_order WHERE ('' = '' OR priority = '')
UNION ALL SELECT 'given', count(*) FROM db_order WHERE ('2-HIGH' = '' OR priority = '2-HIGH')""")
def _(t):
    one, two = (optional_equals(t.db_order, "priority", v).agg(F.count("*").alias("n")) for v in ("", "2-HIGH"))
    return one.select(F.lit("empty").alias("parameter"), "n").unionByName(two.select(F.lit("given").alias("parameter"), "n"))


@plan("p09_year_as_range", f"SELECT {ORDER} FROM db_order WHERE year(order_date) = 1999")
def _(t):
    return _orders(t.db_order.filter(R.year_range("order_date", 1999)))


@plan("p10_expression_filter", """
SELECT i.wo, i.item, i.product, CAST(i.qty AS DOUBLE) AS qty FROM db_orderitem i JOIN db_order o ON i.wo = o.wo
WHERE i.qty - CASE WHEN o.status = 0 THEN i.qty ELSE 0 END - CASE WHEN i.item = 7 THEN i.qty ELSE 0 END > 10""")
def _(t):
    lines = t.db_orderitem.join(t.db_order.select("wo", "status"), "wo")
    open_qty = F.col("qty") - F.when(F.col("status") == 0, F.col("qty")).otherwise(0) - F.when(F.col("item") == 7, F.col("qty")).otherwise(0)
    return lines.filter(open_qty > 10).select("wo", "item", "product", as_double("qty"))


@plan("p11_status_and_future", """
SELECT wo, status FROM db_order WHERE status >= 1 AND status BETWEEN 1 AND 3
  AND order_date + 30 >= (SELECT max(order_date) FROM db_order)""")
def _(t):
    today = R.newest(t.db_order, "order_date")
    return t.db_order.filter((F.col("status") >= 1) & F.col("status").between(1, 3) & (F.col("order_date") >= F.date_sub(today, 30))).select("wo", "status")


@plan("p12_tenant_isolation", """
SELECT m.company_id, m.source_kb, count(*) AS messages, count(DISTINCT m.session_id) AS sessions
FROM chat_message m JOIN chat_session s ON m.company_id = s.company_id AND m.session_id = s.id
WHERE m.company_id = 1 AND m.source_kb = 'kb_support' GROUP BY 1, 2""")
def _(t):
    own = (F.col("company_id") == 1)
    messages = t.chat_message.filter(own & (F.col("source_kb") == "kb_support"))
    sessions = t.chat_session.filter(own).select("company_id", F.col("id").alias("session_id"))
    return (
        messages.join(sessions, ["company_id", "session_id"], "left_semi").groupBy("company_id", "source_kb")
        .agg(F.count("*").alias("messages"), F.count_distinct("session_id").alias("sessions"))
    )


@plan("p13_exists", f"SELECT customer, name FROM db_customer c WHERE EXISTS (SELECT 1 FROM db_order o WHERE o.customer = c.customer AND o.order_date >= DATE '{SINCE}')")
def _(t):
    recent = t.db_order.filter(F.col("order_date") >= R.day(SINCE)).select("customer")
    return t.db_customer.join(recent, "customer", "left_semi").select("customer", "name")


@plan("p14_having", """
SELECT customer, count(*) AS n, CAST(max(total) AS DOUBLE) AS largest, CAST(sum(total) AS DOUBLE) AS revenue FROM db_order
GROUP BY customer HAVING count(*) > 5 AND max(total) > 200000 AND sum(total) > 500000""")
def _(t):
    return (
        t.db_order.groupBy("customer").agg(F.count("*").alias("n"), F.max("total").alias("m"), F.sum("total").alias("s"))
        .filter((F.col("n") > 5) & (F.col("m") > 200000) & (F.col("s") > 500000))
        .select("customer", "n", as_double("m", "largest"), as_double("s", "revenue"))
    )


@plan("p15_coalesce", """
SELECT p.product, coalesce(CAST(v.q AS DOUBLE), 0) AS qty, coalesce(v.w, 'nowhere') AS place FROM db_product p
LEFT JOIN (SELECT product, sum(qty) AS q, min('W' || CAST(warehouse AS VARCHAR)) AS w FROM db_stock WHERE status = 'Available' GROUP BY product) v
ON p.product = v.product""")
def _(t):
    place = F.concat(F.lit("W"), F.col("warehouse").cast("string"))
    have = t.db_stock.filter(F.col("status") == "Available").groupBy("product").agg(F.sum("qty").alias("q"), F.min(place).alias("w"))
    return t.db_product.join(have, "product", "left").select(
        "product", F.coalesce(F.col("q").cast("double"), F.lit(0.0)).alias("qty"), F.coalesce("w", F.lit("nowhere")).alias("place"))


@plan("p16_case_thresholds", """
SELECT CASE WHEN total >= 300000 THEN 'large' WHEN total >= 100000 THEN 'medium' ELSE 'small' END AS size, count(*) AS n FROM db_order GROUP BY 1""")
def _(t):
    size = F.when(F.col("total") >= 300000, "large").when(F.col("total") >= 100000, "medium").otherwise("small")
    return L.count_by(t.db_order.select(size.alias("size")), "size")


@plan("p17_if", "SELECT if(status = 1, 'Si', '') AS open, count(*) AS n FROM db_order GROUP BY 1")
def _(t):
    return L.count_by(t.db_order.select(F.when(F.col("status") == 1, "Si").otherwise("").alias("open")), "open")


# --- joins ----------------------------------------------------------------------------------------------------------

@plan("j01_inner", "SELECT o.wo, c.name FROM db_order o JOIN db_customer c ON o.customer = c.customer")
def _(t):
    return t.db_order.join(t.db_customer.select("customer", "name"), "customer").select("wo", "name")


@plan("j02_chain_with_composite_condition", """
SELECT s.description AS order_status, c.state, p.category, count(*) AS n, CAST(sum(i.subtotal) AS DOUBLE) AS revenue
FROM db_order o JOIN db_customer c ON o.customer = c.customer JOIN db_orderitem i ON o.wo = i.wo JOIN db_product p ON i.product = p.product
JOIN db_status s ON o.status = s.status AND s.type = 'ORDER' GROUP BY 1, 2, 3""")
def _(t):
    statuses = t.db_status.filter(F.col("type") == "ORDER").select("status", F.col("description").alias("order_status"))
    return (
        t.db_orderitem.select("wo", "product", "subtotal").join(t.db_order.select("wo", "customer", "status"), "wo")
        .join(t.db_customer.select("customer", "state"), "customer").join(t.db_product.select("product", "category"), "product")
        .join(statuses, "status").groupBy("order_status", "state", "category")
        .agg(F.count("*").alias("n"), total("subtotal", "revenue"))
    )


@plan("j03_long_chain", """
SELECT o.wo, i.item, min(c.name) AS customer_name, min(s.description) AS order_status, min(h.tracking) AS tracking,
  count(*) AS lines, CAST(sum(i.subtotal) AS DOUBLE) AS price,
  CAST(sum(CAST(CAST(p.standard_cost AS DOUBLE) * (CAST(i.qty AS DOUBLE) / (1 + i.product % 4)) AS DECIMAL(28,10))) AS DOUBLE) AS cost
FROM db_order o JOIN db_orderitem i ON o.wo = i.wo JOIN db_product p ON i.product = p.product
JOIN db_customer c ON o.customer = c.customer JOIN db_status s ON o.status = s.status AND s.type = 'ORDER'
JOIN db_shipping h ON o.wo = h.wo GROUP BY o.wo, i.item""")
def _(t):
    statuses = t.db_status.filter(F.col("type") == "ORDER").select("status", F.col("description").alias("order_status"))
    cost = F.col("standard_cost").cast("double") * (F.col("qty").cast("double") / (1 + F.col("product") % 4))
    lines = (
        t.db_orderitem.select("wo", "item", "product", "qty", "subtotal").join(t.db_product.select("product", "standard_cost"), "product")
        .groupBy("wo", "item").agg(F.count("*").alias("lines"), total("subtotal", "price"), exact_sum(cost).alias("cost"))
    )
    return (
        lines.join(t.db_order.select("wo", "customer", "status"), "wo").join(t.db_shipping.select("wo", "tracking"), "wo")
        .join(t.db_customer.select("customer", F.col("name").alias("customer_name")), "customer").join(statuses, "status")
        .select("wo", "item", "customer_name", "order_status", "tracking", "lines", "price", "cost")
    )


@plan("j04_left_with_default", """
SELECT o.wo, coalesce(s.first_name || ' ' || s.name, 'Unknown') AS salesperson_name, coalesce(h.tracking, 'Not Shipped') AS tracking
FROM db_order o LEFT JOIN db_salesperson s ON o.salesperson = s.salesperson LEFT JOIN db_shipping h ON o.wo = h.wo""")
def _(t):
    return (
        t.db_order.select("wo", "salesperson").join(t.db_salesperson, "salesperson", "left").join(t.db_shipping.select("wo", "tracking"), "wo", "left")
        .select("wo", F.coalesce(F.concat("first_name", F.lit(" "), "name"), F.lit("Unknown")).alias("salesperson_name"),
                F.coalesce("tracking", F.lit("Not Shipped")).alias("tracking"))
    )


@plan("j05_join_to_aggregate", f"""
SELECT c.name, s.n AS order_count, CAST(s.r AS DOUBLE) AS total_revenue FROM db_customer c
JOIN (SELECT customer, count(*) AS n, sum(total) AS r FROM db_order WHERE order_date >= DATE '{SINCE}' GROUP BY customer) s ON c.customer = s.customer""")
def _(t):
    spent = t.db_order.filter(F.col("order_date") >= R.day(SINCE)).groupBy("customer").agg(F.count("*").alias("order_count"), total("total", "total_revenue"))
    return t.db_customer.select("customer", "name").join(spent, "customer").select("name", "order_count", "total_revenue")


@plan("j06_semi", f"SELECT DISTINCT c.customer, c.name FROM db_customer c JOIN db_order o ON c.customer = o.customer WHERE o.order_date >= DATE '{SINCE}'")
def _(t):
    recent = t.db_order.filter(F.col("order_date") >= R.day(SINCE)).select("customer")
    return t.db_customer.join(recent, "customer", "left_semi").select("customer", "name")


@plan("j07_self_join_inequality", """
SELECT p1.product, p1.category, count(p2.product) AS related FROM db_product p1
LEFT JOIN db_product p2 ON p1.category = p2.category AND p1.product <> p2.product GROUP BY p1.product, p1.category""")
def _(t):
    # the number of partners under an inequality is the group size less one: no pair is ever made
    sizes = L.count_by(t.db_product, "category")
    return t.db_product.select("product", "category").join(sizes, "category").select("product", "category", (F.col("n") - 1).alias("related"))


@plan("j08_join_of_aggregates", """
SELECT a.m AS month, CAST(a.r AS DOUBLE) AS this_year, CAST(b.r AS DOUBLE) AS last_year
FROM (SELECT CAST(month(order_date) AS INT) AS m, sum(total) AS r FROM db_order WHERE year(order_date) = 2001 GROUP BY 1) a
LEFT JOIN (SELECT CAST(month(order_date) AS INT) AS m, sum(total) AS r FROM db_order WHERE year(order_date) = 2000 GROUP BY 1) b ON a.m = b.m""")
def _(t):
    def months(year, name):
        return t.db_order.filter(R.year_range("order_date", year)).groupBy(F.month("order_date").alias("month")).agg(total("total", name))
    return months(2001, "this_year").join(months(2000, "last_year"), "month", "left")


@plan("j09_filter_in_join", """
SELECT c.customer, count(o.wo) AS orders FROM db_customer c LEFT JOIN db_order o ON c.customer = o.customer AND o.status >= 1 AND o.total > 250000
GROUP BY c.customer""")
def _(t):
    large = L.count_by(t.db_order.filter((F.col("status") >= 1) & (F.col("total") > 250000)), "customer", name="orders")
    return t.db_customer.select("customer").join(large, "customer", "left").select("customer", F.coalesce("orders", F.lit(0)).alias("orders"))


@plan("j10_array_membership", """
SELECT c.tenant, c.table_name, c.column_name, x.index_name FROM cat_column c
JOIN (SELECT tenant, table_name, index_name, list(column_name) AS cols FROM cat_index GROUP BY ALL) x
ON c.tenant = x.tenant AND c.table_name = x.table_name WHERE list_contains(x.cols, c.column_name)""")
def _(t):
    indexes = t.cat_index.groupBy("tenant", "table_name", "index_name").agg(F.collect_list("column_name").alias("cols"))
    columns = t.cat_column.select("tenant", "table_name", "column_name")
    held = indexes.select("tenant", "table_name", "index_name", F.explode("cols").alias("column_name"))
    return columns.join(L.unshared(held), ["tenant", "table_name", "column_name"])


@plan("j11_known_tables_only", """
SELECT k.tenant, k.constraint_name, k.table_name, k.ref_table FROM cat_key k WHERE k.ref_table IS NOT NULL
AND EXISTS (SELECT 1 FROM cat_table a WHERE a.tenant = k.tenant AND a.table_name = k.table_name AND a.table_type = 'BASE TABLE')
AND EXISTS (SELECT 1 FROM cat_table b WHERE b.tenant = k.tenant AND b.table_name = k.ref_table AND b.table_type = 'BASE TABLE')""")
def _(t):
    known = t.cat_table.filter(F.col("table_type") == "BASE TABLE").select("tenant", "table_name")
    edges = t.cat_key.filter(F.col("ref_table").isNotNull()).select("tenant", "constraint_name", "table_name", "ref_table")
    return L.keep_known(L.keep_known(edges, known, "tenant", "table_name"), known.withColumnRenamed("table_name", "ref_table"), "tenant", "ref_table").select("tenant", "constraint_name", "table_name", "ref_table")


@plan("j12_anti", "SELECT p.product, p.description FROM db_product p WHERE NOT EXISTS (SELECT 1 FROM db_stock s WHERE s.product = p.product AND s.status = 'Available')")
def _(t):
    return t.db_product.join(t.db_stock.filter(F.col("status") == "Available").select("product"), "product", "left_anti").select("product", "description")


@plan("j13_dimension_lookup", """
SELECT q.question_id, a.name, a.database_kb, a.support_kb FROM question_log q
LEFT JOIN application a ON q.company_id = a.company_id AND a.is_active""")
def _(t):
    active = t.application.filter("is_active").select("company_id", "name", "database_kb", "support_kb")
    return t.question_log.join(active, "company_id", "left").select("question_id", "name", "database_kb", "support_kb")


@plan("j15_small_to_large", """
SELECT r.r_name, count(*) AS lines, CAST(sum(CAST(l.l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
FROM region r JOIN nation n ON r.r_regionkey = n.n_regionkey JOIN supplier s ON n.n_nationkey = s.s_nationkey
JOIN lineitem l ON s.s_suppkey = l.l_suppkey GROUP BY r.r_name""")
def _(t):
    # the large side is summed per supplier before it meets the dimensions
    lines = t.lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("lines"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("price"))
    return (
        t.region.join(t.nation, F.col("r_regionkey") == F.col("n_regionkey")).join(t.supplier, F.col("n_nationkey") == F.col("s_nationkey"))
        .join(lines, "s_suppkey").groupBy("r_name").agg(F.sum("lines").alias("lines"), total("price", "revenue"))
    )


# --- aggregates -----------------------------------------------------------------------------------------------------

@plan("a01_count_sum_average", """
SELECT CAST(year(order_date) AS INT) AS year, CAST(month(order_date) AS INT) AS month, count(*) AS n, CAST(sum(total) AS DOUBLE) AS revenue,
  CAST(sum(total) AS DOUBLE) / count(*) AS mean FROM db_order GROUP BY 1, 2""")
def _(t):
    return t.db_order.groupBy(F.year("order_date").alias("year"), F.month("order_date").alias("month")).agg(
        F.count("*").alias("n"), total("total", "revenue"), average("total", "mean"))


@plan("a02_several_distinct_counts", """
SELECT priority, count(DISTINCT customer) AS customers, count(DISTINCT salesperson) AS salespeople, count(DISTINCT order_date) AS days FROM db_order GROUP BY priority""")
def _(t):
    return t.db_order.groupBy("priority").agg(F.count_distinct("customer").alias("customers"), F.count_distinct("salesperson").alias("salespeople"), F.count_distinct("order_date").alias("days"))


@plan("a03_first_last_and_span", """
SELECT customer, CAST(min(order_date) AS VARCHAR) AS first, CAST(max(order_date) AS VARCHAR) AS last,
  CAST(date_diff('day', min(order_date), max(order_date)) AS INT) AS days FROM db_order GROUP BY customer""")
def _(t):
    span = t.db_order.groupBy("customer").agg(F.min("order_date").alias("a"), F.max("order_date").alias("b"))
    return span.select("customer", as_text("a", "first"), as_text("b", "last"), F.datediff("b", "a").alias("days"))


@plan("a04_sum_of_expression", """
SELECT i.product, CAST(sum(i.subtotal * i.qty) AS DOUBLE) AS value, CAST(sum(CAST(CAST(i.subtotal AS DOUBLE) / nullif(CAST(i.qty - i.qty % 2 AS DOUBLE), 0) AS DECIMAL(28,10))) AS DOUBLE) AS per_pair
FROM db_orderitem i GROUP BY i.product""")
def _(t):
    return t.db_orderitem.groupBy("product").agg(
        F.sum(F.col("subtotal") * F.col("qty")).cast("double").alias("value"),
        exact_sum(quotient(F.col("subtotal"), F.col("qty") - F.col("qty") % 2)).alias("per_pair"))


@plan("a05_ratio_average", "SELECT product, CAST(sum(CAST(CAST(subtotal AS DOUBLE) / nullif(CAST(qty AS DOUBLE), 0) AS DECIMAL(28,10))) AS DOUBLE) / nullif(count(*) FILTER (WHERE qty <> 0), 0) AS unit_price FROM db_orderitem GROUP BY product")
def _(t):
    return t.db_orderitem.groupBy("product").agg(mean_of(F.col("subtotal"), F.col("qty"), "unit_price"))


@plan("a06_loose_grouping", """
SELECT i.wo, min(p.description) AS description, min(c.name) AS customer_name, count(*) AS n FROM db_orderitem i
JOIN db_product p ON i.product = p.product JOIN db_order o ON i.wo = o.wo JOIN db_customer c ON o.customer = c.customer GROUP BY i.wo""")
def _(t):
    lines = t.db_orderitem.select("wo", "product").join(t.db_product.select("product", "description"), "product").groupBy("wo").agg(F.min("description").alias("description"), F.count("*").alias("n"))
    return (
        lines.join(t.db_order.select("wo", "customer"), "wo").join(t.db_customer.select("customer", F.col("name").alias("customer_name")), "customer")
        .select("wo", "description", "customer_name", "n")
    )


@plan("a07_group_without_aggregate", "SELECT o.wo, min(o.status) AS status, min(o.customer) AS customer FROM db_order o JOIN db_orderitem i ON o.wo = i.wo GROUP BY o.wo")
def _(t):
    return t.db_order.join(t.db_orderitem.select("wo"), "wo", "left_semi").groupBy("wo").agg(F.min("status").alias("status"), F.min("customer").alias("customer"))


@plan("a08_group_by_alias", "SELECT upper(category) AS grp, count(*) AS n FROM db_product GROUP BY grp")
def _(t):
    return L.count_by(t.db_product.select(F.upper("category").alias("grp")), "grp")


@plan("a09_ordered_string_aggregation", "SELECT tenant, table_name, index_name, string_agg(column_name, ',' ORDER BY seq) AS columns FROM cat_index GROUP BY 1, 2, 3")
def _(t):
    return t.cat_index.groupBy("tenant", "table_name", "index_name").agg(L.joined_list("column_name", "seq").alias("columns"))


@plan("a10_array_aggregation", "SELECT tenant, table_name, array_to_string(list_sort(list(column_name)), ',') AS columns FROM cat_column GROUP BY 1, 2")
def _(t):
    return t.cat_column.groupBy("tenant", "table_name").agg(F.array_join(F.array_sort(F.collect_list("column_name")), ",").alias("columns"))


@plan("a11_set_aggregation", "SELECT event_type, array_to_string(list_sort(list(DISTINCT user_id % 7)), ',') AS shards, count(DISTINCT user_id % 7) AS n FROM events GROUP BY event_type")
def _(t):
    shards = t.events.select("event_type", (F.col("user_id") % 7).alias("shard"))
    # the set is bounded by the number of shards
    return shards.groupBy("event_type").agg(F.array_join(F.array_sort(F.collect_set("shard")).cast("array<string>"), ",").alias("shards"), F.count_distinct("shard").alias("n"))


@plan("a12_counters", "SELECT role, turn, count(*) AS n FROM conversations GROUP BY role, turn")
def _(t):
    return L.count_by(t.conversations, "role", "turn")


@plan("a13_fan_out_as_written", """
SELECT o.customer, CAST(sum(o.total) AS DOUBLE) AS revenue, count(*) AS n FROM db_order o JOIN db_orderitem i ON o.wo = i.wo GROUP BY o.customer""")
def _(t):
    lines = L.count_by(t.db_orderitem, "wo", name="lines")
    return t.db_order.select("wo", "customer", "total").join(lines, "wo").groupBy("customer").agg(
        F.sum(F.col("total") * F.col("lines")).cast("double").alias("revenue"), F.sum("lines").alias("n"))


@plan("a13_fan_out_per_order", """
SELECT o.customer, CAST(sum(o.total) AS DOUBLE) AS revenue, count(*) AS n FROM db_order o
WHERE EXISTS (SELECT 1 FROM db_orderitem i WHERE i.wo = o.wo) GROUP BY o.customer""")
def _(t):
    return t.db_order.join(t.db_orderitem.select("wo"), "wo", "left_semi").groupBy("customer").agg(total("total", "revenue"), F.count("*").alias("n"))


@plan("a14_counts_by_status", """
SELECT kb_id, company_id, sum(CASE WHEN processing_status = 'pending' THEN 1 ELSE 0 END)::BIGINT AS pending,
  sum(CASE WHEN processing_status IN ('applied', 'reviewed') THEN 1 ELSE 0 END)::BIGINT AS processed FROM query_feedback GROUP BY 1, 2""")
def _(t):
    status = F.col("processing_status")
    return t.query_feedback.groupBy("kb_id", "company_id").agg(count_if(status == "pending", "pending"), count_if(status.isin("applied", "reviewed"), "processed"))


@plan("a15_percent_of_group", """
SELECT lang, source, n, CASE WHEN tot > 0 THEN round(n * 100.0::DOUBLE / tot, 1) ELSE 0 END AS pct, printf('%.1f%%', n::DOUBLE / tot * 100) AS pct_text
FROM (SELECT lang, source, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY lang) AS BIGINT) AS tot FROM documents GROUP BY lang, source)""")
def _(t):
    counts = L.count_by(t.documents, "lang", "source")
    tot = F.sum("n").over(Window.partitionBy("lang"))
    return counts.withColumn("tot", tot).select("lang", "source", "n", percent(F.col("n"), F.col("tot")).alias("pct"), percent_text(F.col("n"), F.col("tot")).alias("pct_text"))


# --- windows, sorts, sets -------------------------------------------------------------------------------------------

@plan("w01_share_of_total", """
SELECT product, CAST(sum(subtotal) AS DOUBLE) AS revenue, round(CAST(sum(subtotal) AS DOUBLE) / CAST(sum(sum(subtotal)) OVER () AS DOUBLE) * 100, 2) AS share
FROM db_orderitem GROUP BY product""")
def _(t):
    return L.with_share(t.db_orderitem.groupBy("product").agg(F.sum("subtotal").alias("revenue")), "revenue", "share").withColumn("revenue", F.col("revenue").cast("double"))


@plan("w02_latest_per_key", """
SELECT user_id, company_id, id FROM chat_session WHERE is_active
QUALIFY row_number() OVER (PARTITION BY user_id, company_id ORDER BY created_at DESC, id DESC) = 1""")
def _(t):
    latest = t.chat_session.filter("is_active").groupBy("user_id", "company_id").agg(F.max_by("id", F.struct("created_at", "id")).alias("id"))
    return latest


@plan("w03_last_n_per_group", """
SELECT user_id, event_id, p AS position FROM (SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INT) AS p FROM events)
WHERE p <= 50""")
def _(t):
    return L.last_per_group(t.events.select("user_id", "event_id", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 50).select("user_id", "event_id", "position")


@plan("w04_best_row_per_hash", """
SELECT h AS content_hash, doc_id FROM (SELECT md5(text) AS h, doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY n_chars % 7 DESC, doc_id) AS r FROM documents) WHERE r = 1""")
def _(t):
    # aggregated on the map side: a third of all rows may share one hash
    score = F.struct((F.col("n_chars") % 7).alias("score"), (-F.col("doc_id")).alias("first"))
    return t.documents.groupBy(F.md5("text").alias("content_hash")).agg(F.max_by("doc_id", score).alias("doc_id"))


@plan("t01_multi_key_order", """
SELECT CAST(row_number() OVER (ORDER BY state, n DESC, city) AS INT) AS line, state, city, n FROM (SELECT state, city, count(*) AS n FROM db_customer GROUP BY 1, 2)""")
def _(t):
    # grouped rows are few (states by cities), so the numbering window is bounded
    return L.count_by(t.db_customer, "state", "city").withColumn("line", F.row_number().over(Window.orderBy("state", F.desc("n"), "city")))


@plan("t02_top_n_by_aggregate", "SELECT customer, CAST(sum(total) AS DOUBLE) AS revenue FROM db_order GROUP BY customer ORDER BY sum(total) DESC, customer LIMIT 10")
def _(t):
    return t.db_order.groupBy("customer").agg(F.sum("total").alias("s")).orderBy(F.desc("s"), "customer").limit(10).select("customer", as_double("s", "revenue"))


@plan("t03_offset_page", "SELECT wo, CAST(total AS DOUBLE) AS amount FROM db_order ORDER BY total DESC, wo LIMIT 20 OFFSET 100")
def _(t):
    return t.db_order.orderBy(F.desc("total"), "wo").offset(100).limit(20).select("wo", as_double("total", "amount"))


@plan("t04_keyset_page", "SELECT event_id, user_id FROM events WHERE event_id < (SELECT max(event_id) FROM events) - 100 ORDER BY event_id DESC LIMIT 20")
def _(t):
    last_seen = t.events.agg(F.max("event_id")).scalar() - 100
    return t.events.filter(F.col("event_id") < last_seen).orderBy(F.desc("event_id")).limit(20).select("event_id", "user_id")


@plan("t05_stable_sort_then_cut", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25")
def _(t):
    return t.documents.select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(25)


@plan("t06_top_by_count", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 15")
def _(t):
    return L.count_by(t.events, "user_id").orderBy(F.desc("n"), "user_id").limit(15)


@plan("t07_sample_sorted_by_text", """
SELECT event_type, level, event_id, r AS position FROM (SELECT event_type, event_id, level,
  CAST(row_number() OVER (PARTITION BY event_type ORDER BY level, event_id) AS INT) AS r
  FROM (SELECT *, CASE WHEN value > 100 THEN 'High' WHEN value > 50 THEN 'Medium' ELSE 'Low' END AS level FROM events)) WHERE r <= 20""")
def _(t):
    level = F.when(F.col("value") > 100, "High").when(F.col("value") > 50, "Medium").otherwise("Low")
    graded = t.events.select("event_type", "event_id", level.alias("level"))
    return L.last_per_group(graded, ["event_type"], [F.col("level"), F.col("event_id")], 20)


@plan("u01_concatenation", """
SELECT origin, user_key, count(*) AS n FROM (SELECT 'event' AS origin, user_id AS user_key FROM events
UNION ALL SELECT 'message', user_id FROM chat_message) GROUP BY 1, 2""")
def _(t):
    events = t.events.select(F.lit("event").alias("origin"), F.col("user_id").alias("user_key"))
    messages = t.chat_message.select(F.lit("message").alias("origin"), F.col("user_id").alias("user_key"))
    return L.count_by(events.unionByName(messages), "origin", "user_key")


@plan("u02_ordered_distinct", """
SELECT doc_id, array_to_string(list_filter(w, lambda v, i: list_position(w, v) = i), ' ') AS words
FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents)""")
def _(t):
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)
    return t.documents.select("doc_id", F.array_join(L.ordered_distinct(words), " ").alias("words"))


@plan("u03_merge_lists", """
SELECT doc_id, array_to_string(list_filter(w, lambda v, i: list_position(w, v) = i), ' ') AS words
FROM (SELECT doc_id, list_concat(regexp_extract_all(text, '[A-Z][a-z]+'), regexp_extract_all(text, '[0-9]+')) AS w FROM documents)""")
def _(t):
    return t.documents.select("doc_id", F.array_join(F.array_union(
        F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), 0), F.regexp_extract_all("text", F.lit("[0-9]+"), 0)), " ").alias("words"))


@plan("u04_distinct", "SELECT DISTINCT customer, salesperson, priority FROM db_order")
def _(t):
    return t.db_order.select("customer", "salesperson", "priority").distinct()
