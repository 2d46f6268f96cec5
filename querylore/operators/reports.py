"""Business reports over order, item, customer, product and stock tables.

Money is decimal until the last step, so sums do not depend on the order of rows. "Today" is an argument, never the clock.
Functions of a date column are written as ranges, which reach the file scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querylore.functions.columns import as_double, as_text, average, exact_sum, mean_of, quotient, total


def newest(df: DataFrame, column: str) -> Column:
    """The newest value of a date column as a scalar subquery, the stand-in for the current date."""
    return df.agg(F.max(column)).scalar()


def year_range(column: str, year: int) -> Column:
    return (F.col(column) >= F.lit(f"{year}-01-01").cast("date")) & (F.col(column) < F.lit(f"{year + 1}-01-01").cast("date"))


def day(text: str) -> Column:
    return F.lit(text).cast("date")


# --- simple reports -------------------------------------------------------------------------------------------------

def active_customers(customers: DataFrame) -> DataFrame:
    return customers.filter(F.col("status") == "Active").select("customer", "name", "city").orderBy("name", "customer")


def orders_between(orders: DataFrame, start: str, end: str, status: int) -> DataFrame:
    return (
        orders.filter((F.col("order_date") >= day(start)) & (F.col("order_date") < day(end)) & (F.col("status") == status))
        .select("wo", "customer", as_text("order_date"), as_double("total"))
        .orderBy(F.desc("order_date"), "wo")
    )


def monthly_summary(orders: DataFrame, min_status: int = 1) -> DataFrame:
    return (
        orders.filter(F.col("status") >= min_status)
        .groupBy(F.year("order_date").alias("year"), F.month("order_date").alias("month"))
        .agg(F.count("*").alias("order_count"), total("total", "total_revenue"), average("total", "average_order_value"))
        .orderBy(F.desc("year"), F.desc("month"))
    )


def orders_with_customer(orders: DataFrame, customers: DataFrame, since: str) -> DataFrame:
    return (
        orders.filter(F.col("order_date") >= day(since))
        .join(customers.select("customer", F.col("name").alias("customer_name")), "customer")
        .select("wo", as_text("order_date"), "customer_name", as_double("total"))
        .orderBy(F.desc("order_date"), "wo")
    )


def complete_order_lines(orders, customers, items, products, statuses, since: str) -> DataFrame:
    """Five tables, one of them on a composite condition whose constant part filters the dimension first."""
    order_status = statuses.filter(F.col("type") == "ORDER").select("status", F.col("description").alias("order_status"))
    return (
        orders.filter(F.col("order_date") >= day(since))
        .join(customers.select("customer", F.col("name").alias("customer_name")), "customer")
        .join(order_status, "status")
        .join(items.select("wo", "item", "product", "qty", "subtotal"), "wo")
        .join(products.select("product", F.col("description").alias("product_description")), "product")
        .select(
            F.col("wo").alias("order_number"), "customer_name", "item", "product_description",
            as_double("qty", "quantity"), as_double("subtotal", "line_total"), as_double("total", "order_total"), "order_status",
        )
    )


def orders_with_shipping(orders, customers, shipping, since: str) -> DataFrame:
    return (
        orders.filter(F.col("order_date") >= day(since))
        .join(customers.select("customer", F.col("name").alias("customer_name")), "customer")
        .join(shipping, "wo", "left")
        .select(
            "wo", "customer_name", as_double("total"),
            F.coalesce("tracking", F.lit("Not Shipped")).alias("tracking"),
            F.coalesce(F.col("ship_date").cast("string"), F.lit("Pending")).alias("ship_date"),
        )
    )


def item_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("wo").agg(F.count("*").alias("item_count"), F.sum("qty").alias("total_qty"))


def orders_with_item_counts(orders, customers, items, since: str) -> DataFrame:
    return (
        orders.filter(F.col("order_date") >= day(since))
        .join(customers.select("customer", F.col("name").alias("customer_name")), "customer")
        .join(item_counts(items), "wo")
        .select("wo", "customer_name", as_double("total"), "item_count", as_double("total_qty"))
        .orderBy(F.desc("item_count"), "wo")
    )


def related_products(products: DataFrame, product: int) -> DataFrame:
    """Other products in the category of one product."""
    main = products.filter(F.col("product") == product).select(
        "category", F.col("product").alias("main_product"), F.col("description").alias("main_description")
    )
    # the product is the key, so this side is one row
    return (
        products.join(F.broadcast(main), "category")
        .filter(F.col("product") != F.col("main_product"))
        .select("main_product", "main_description", F.col("product").alias("related_product"),
                F.col("description").alias("related_description"))
    )


def customers_with_large_order(orders, customers, since: str, more_than: float) -> DataFrame:
    large = (
        orders.filter(F.col("order_date") >= day(since))
        .groupBy("customer").agg(F.max("total").alias("largest"))
        .filter(F.col("largest") > more_than)
    )
    return (
        customers.join(large, "customer")
        .select("customer", "name", as_double("largest", "max_order_value")).distinct()
        .orderBy(F.desc("max_order_value"), "customer")
    )


def available_stock(stock: DataFrame) -> DataFrame:
    return stock.filter(F.col("status") == "Available").groupBy("product").agg(F.sum("qty").alias("on_hand"))


def lines_with_stock_status(orders, items, products, stock, status: int = 1) -> DataFrame:
    have = F.coalesce("on_hand", F.lit(0))
    return (
        orders.filter(F.col("status") == status).select("wo")
        .join(items.select("wo", "item", "product", "qty"), "wo")
        .join(products.select("product", "description"), "product")
        .join(available_stock(stock), "product", "left")
        .select(
            "wo", "item", "description", as_double("qty", "ordered_qty"), have.cast("double").alias("available_qty"),
            F.when(have >= F.col("qty"), "In Stock").when(have > 0, "Partial Stock").otherwise("Out of Stock").alias("stock_status"),
        )
    )


# --- periods --------------------------------------------------------------------------------------------------------

PERIODS = {
    "day": lambda d: [F.col(d).cast("string").alias("day")],
    "week": lambda d: [F.date_trunc("week", d).cast("date").cast("string").alias("week_start")],
    "month": lambda d: [F.year(d).alias("year"), F.month(d).alias("month"), F.date_format(d, "MMMM").alias("month_name")],
    "quarter": lambda d: [F.year(d).alias("year"), F.quarter(d).alias("quarter")],
}


def sales_by_period(orders, items, period: str = "month", months: int | None = 12, fan_out: bool = True) -> DataFrame:
    """Sales per day, week (Monday start), month or quarter.

    ``fan_out`` keeps the behaviour of joining items before summing: an order counts once per item line. Items are
    summed per order first, so the multiplication is arithmetic and not a bigger join. Without it an order counts once.
    """
    confirmed = orders.filter(F.col("status") >= 1)
    if months is not None:
        confirmed = confirmed.filter(F.col("order_date") >= F.add_months(newest(orders, "order_date"), -months))
    lines = F.col("item_count") if fan_out else F.lit(1)
    return (
        confirmed.join(item_counts(items), "wo")
        .groupBy(*PERIODS[period]("order_date"))
        .agg(
            F.count("*").alias("order_count"),  # rows are one for each order here
            F.count_distinct("customer").alias("unique_customers"),
            F.sum(F.col("total") * lines).cast("double").alias("total_revenue"),
            (F.sum(F.col("total") * lines).cast("double") / F.sum(lines)).alias("average_order_value"),
            total("total_qty", "total_items_sold"),
        )
    )


# --- top performers -------------------------------------------------------------------------------------------------

def top_customers(orders, customers, months: int = 12, n: int = 10) -> DataFrame:
    today = newest(orders, "order_date")
    return (
        orders.filter((F.col("order_date") >= F.add_months(today, -months)) & (F.col("status") >= 1))
        .groupBy("customer")
        .agg(F.count("wo").alias("order_count"), F.sum("total").alias("revenue"), F.max("order_date").alias("last_order"))
        .filter(F.col("revenue") > 0)
        .join(customers.select("customer", "name", "city", "state"), "customer")
        .select(
            "customer", F.col("name").alias("customer_name"), "city", "state", "order_count",
            as_double("revenue", "total_revenue"),
            (F.col("revenue").cast("double") / F.col("order_count")).alias("average_order_value"),
            as_text("last_order", "last_order_date"), F.datediff(today, "last_order").alias("days_since_last_order"),
        )
        .orderBy(F.desc("total_revenue"), "customer")
        .limit(n)
    )


def top_by(orders, items, products, key: str, months: int = 12, n: int = 10) -> DataFrame:
    """Top products, salespeople or categories by line revenue."""
    recent = orders.filter(
        (F.col("order_date") >= F.add_months(newest(orders, "order_date"), -months)) & (F.col("status") >= 1)
    ).select("wo", "salesperson")
    lines = recent.join(items.select("wo", "product", "subtotal"), "wo")
    if key == "category":
        # the product is the finer key: sum per product before the join
        lines = (
            lines.groupBy("product").agg(F.sum("subtotal").alias("subtotal"), F.count("*").alias("lines"))
            .join(products.select("product", "category"), "product")
        )
        grouped = lines.groupBy("category").agg(F.sum("lines").alias("line_count"), F.sum("subtotal").alias("revenue"))
    else:
        grouped = lines.groupBy(key).agg(F.count("*").alias("line_count"), F.sum("subtotal").alias("revenue"))
    return (
        grouped.filter(F.col("revenue") > 0)
        .select(key, "line_count", as_double("revenue", "total_revenue"))
        .orderBy(F.desc("total_revenue"), key)
        .limit(n)
    )


# --- trends, stock, activity ----------------------------------------------------------------------------------------

def year_over_year(orders: DataFrame) -> DataFrame:
    """Months of the newest year beside the same months one year earlier; null change when there is nothing to compare."""
    confirmed = orders.filter(F.col("status") >= 1)
    by_month = confirmed.groupBy(F.year("order_date").alias("y"), F.month("order_date").alias("month")).agg(
        F.sum("total").alias("revenue"), F.count("*").alias("orders"), F.min(F.date_format("order_date", "MMMM")).alias("month_name")
    )
    this_year = F.year(newest(orders, "order_date"))
    now = by_month.filter(F.col("y") == this_year)
    before = by_month.filter(F.col("y") == this_year - 1).select(
        "month", F.col("revenue").alias("previous"), F.col("orders").alias("previous_orders")
    )
    current, previous = F.col("revenue").cast("double"), F.col("previous").cast("double")
    return (
        now.join(before, "month", "left")
        .select(
            "month", "month_name", current.alias("current_year_revenue"), previous.alias("previous_year_revenue"),
            F.round((current - previous) / F.nullif(previous, F.lit(0.0)) * 100, 2).alias("percent_change"),
            F.col("orders").alias("current_year_orders"), F.col("previous_orders").alias("previous_year_orders"),
        )
        .orderBy("month")
    )


def inventory_status(products, stock, items, orders) -> DataFrame:
    reserved = (
        orders.filter(F.col("status").isin(1, 2)).select("wo")
        .join(items.select("wo", "product", "qty"), "wo")
        .groupBy("product").agg(F.sum("qty").alias("reserved"))
    )
    on_hand, held = F.coalesce("on_hand", F.lit(0)), F.coalesce("reserved", F.lit(0))
    free = on_hand - held
    return (
        products.filter(F.col("status") == "Active")
        .join(available_stock(stock), "product", "left")
        .join(reserved, "product", "left")
        .select(
            "product", "description", "category",
            on_hand.cast("double").alias("on_hand_qty"), held.cast("double").alias("reserved_qty"),
            free.cast("double").alias("available_qty"), "reorder_point", "reorder_qty",
            F.when(free <= F.col("reorder_point"), "Reorder Needed")
            .when(free <= F.col("reorder_point") * 1.5, "Low Stock").otherwise("Adequate").alias("stock_status"),
        )
    )


def customer_activity(customers, orders, items) -> DataFrame:
    """Active customers with their orders, those without orders too.

    An order with n items counts n times, one without items once, as the plain left joins have it. Items are summed
    per order first; the distinct products come from (customer, product) pairs.
    """
    today = newest(orders, "order_date")
    confirmed = orders.filter(F.col("status") >= 1).select("wo", "customer", "total", "order_date")
    lines = F.coalesce("item_count", F.lit(1))
    spent = (
        confirmed.join(item_counts(items), "wo", "left")
        .groupBy("customer")
        .agg(F.sum(lines).alias("n"), F.sum(F.col("total") * lines).alias("revenue"),
             F.min("order_date").alias("first"), F.max("order_date").alias("last"))
    )
    bought = (
        confirmed.select("wo", "customer").join(items.select("wo", "product"), "wo")
        .select("customer", "product").distinct().groupBy("customer").agg(F.count("*").alias("products"))
    )
    return (
        customers.filter(F.col("status") == "Active")
        .join(spent, "customer", "left").join(bought, "customer", "left")
        .select(
            "customer", F.col("name").alias("customer_name"), F.col("type").alias("customer_type"),
            F.coalesce("n", F.lit(0)).alias("total_orders"), as_double("revenue", "total_revenue"),
            (F.col("revenue").cast("double") / F.col("n")).alias("average_order_value"),
            as_text("first", "first_order_date"), as_text("last", "last_order_date"),
            F.datediff("last", "first").alias("customer_lifespan_days"),
            F.when(F.col("last") >= F.date_sub(today, 30), "Active")
            .when(F.col("last") >= F.date_sub(today, 90), "Recent")
            .when(F.col("last") >= F.date_sub(today, 365), "Dormant").otherwise("Inactive").alias("activity_status"),
            F.coalesce("products", F.lit(0)).alias("unique_products_purchased"),
        )
    )


def product_performance(products, items, orders, months: int = 12) -> DataFrame:
    """Sales per active product with its share of all revenue. The grand total is one scalar, not an unpartitioned window."""
    recent = orders.filter(
        (F.col("order_date") >= F.add_months(newest(orders, "order_date"), -months)) & (F.col("status") >= 1)
    ).select("wo", "customer", "order_date")
    active = products.filter(F.col("status") == "Active").select("product", "description", "category")
    sold = (
        recent.join(items.select("wo", "product", "qty", "subtotal"), "wo")
        .join(active.select("product"), "product", "left_semi")
        .groupBy("product")
        .agg(
            F.count_distinct("wo").alias("orders_containing"), F.sum("qty").alias("quantity"), F.sum("subtotal").alias("revenue"),
            mean_of(F.col("subtotal"), F.col("qty"), "average_unit_price"),
            F.count_distinct("customer").alias("unique_customers"),
            F.min("order_date").alias("first"), F.max("order_date").alias("last"),
        )
        .filter(F.col("quantity") > 0)
    )
    everything = sold.agg(F.sum("revenue").cast("double")).scalar()
    return sold.join(active, "product").select(
        "product", "description", "category", "orders_containing", as_double("quantity", "total_quantity_sold"),
        as_double("revenue", "total_revenue"), "average_unit_price", "unique_customers",
        as_text("first", "first_sale_date"), as_text("last", "last_sale_date"),
        F.round(F.col("revenue").cast("double") / F.nullif(everything, F.lit(0.0)) * 100, 2).alias("revenue_percentage"),
    )


def export_format(orders: DataFrame) -> DataFrame:
    return orders.select("wo", F.date_format("order_date", "yyyy-MM-dd").alias("order_date"), F.format_number("total", 2).alias("formatted_total"))


# --- cost and shop floor --------------------------------------------------------------------------------------------

def _costed(orders, items, products, customers=None, statuses=None) -> DataFrame:
    """Cost of every line of a started order. Conditions on the order's customer and status cut orders before their lines are joined."""
    relief = 1 + F.col("product") % 4
    started = orders.filter(F.col("status") >= 1).select("wo", "status", "customer")
    if statuses is not None:
        started = started.join(statuses.filter(F.col("type") == "ORDER").select("status"), "status", "left_semi")
    if customers is not None:
        started = started.join(customers.select("customer"), "customer", "left_semi")
    return (
        started.join(items, "wo")
        .join(products.select("product", "description", "standard_cost"), "product")
        .withColumn("cost", F.col("standard_cost").cast("double") * (F.col("qty").cast("double") / relief))
    )


def order_cost(orders, items, products, customers, statuses, by_box: bool = True) -> DataFrame:
    """Unit and line cost. A box is the ship date of a line; non-grouped columns take their smallest value."""
    keys = ["ship_date", "wo", "item"] if by_box else ["wo", "item"]
    unit = quotient(F.col("cost"), F.col("qty"))
    grouped = (
        _costed(orders, items, products, customers, statuses)
        .groupBy(*keys)
        .agg(
            F.min("description").alias("product"), F.min("qty").cast("double").alias("qty"),
            F.min("subtotal").cast("double").alias("unit_price"), exact_sum(unit).alias("unit_cost"),
            F.min(F.col("subtotal") * F.col("qty")).cast("double").alias("line_price"),
            exact_sum(F.col("cost")).alias("line_cost"),
        )
    )
    return grouped.withColumn("box", F.col("ship_date").cast("string")).drop("ship_date") if by_box else grouped


def batch_cost(orders, items, products) -> DataFrame:
    """Cost per batch: the salesperson stands for the item batch."""
    return (
        _costed(orders, items, products)
        .groupBy("wo")
        .agg(F.count("*").alias("lines"), exact_sum(F.col("cost")).alias("order_cost"), total("subtotal", "order_price"))
    )


def prompt_code(answers: Column, key: str) -> Column:
    """Value of a key in a coded answer text such as ``W=3;L=12``."""
    return F.element_at(F.str_to_map(answers, F.lit(";"), F.lit("=")), F.lit(key))


def box_scan_list(orders, items, products, customers, start: str, end: str, customer: str = "", tool_free=(1, 2, 3)) -> DataFrame:
    """Lines packed in a time window, with coded sizes; an empty customer means all."""
    packed = items.filter((F.col("ship_date") >= day(start)) & (F.col("ship_date") <= day(end)))
    chosen = orders.filter(F.col("status") >= 1)
    if customer:
        chosen = chosen.filter(F.col("customer") == F.lit(customer).cast("bigint"))
    answers = F.concat(F.lit("W="), F.col("capacity_group").cast("string"), F.lit(";L="), F.col("reorder_qty").cast("string"))
    return (
        packed.join(chosen.select("wo", "customer"), "wo")
        .join(products.select("product", "description", "capacity_group", "reorder_qty"), "product")
        .join(customers.select("customer", "name"), "customer")
        .select(
            F.concat(F.lit(start), F.lit(" - "), F.lit(end)).alias("search"), as_text("ship_date"), "name",
            F.concat(F.col("wo").cast("string"), F.lit("-"), F.col("item").cast("string")).alias("scan"), "wo", "item",
            as_double("qty"),
            prompt_code(answers, "W").try_cast("decimal(10,2)").cast("double").alias("width"),
            prompt_code(answers, "L").try_cast("decimal(10,2)").cast("double").alias("length"),
            F.when(F.col("product").isin(*tool_free), "Si").otherwise("").alias("no_tools"), "stock", "description",
        )
    )


def open_lines(orders, items, products, statuses=(0, 1, 2), more_than: float = 0, like: str = "%ring%", batch: str = "") -> DataFrame:
    """Lines with quantity still open: ordered less shipped less cancelled. A line ships when its order is finished."""
    shipped = F.when(F.col("status") == 0, F.col("qty")).otherwise(F.lit(0))
    cancelled = F.when(F.col("item") == 7, F.col("qty")).otherwise(F.lit(0))
    chosen = orders.filter(F.col("status").isin(*statuses))
    if batch:
        chosen = chosen.filter(F.col("salesperson") == F.lit(batch).cast("bigint"))
    return (
        chosen.select("wo", "status", "salesperson", "order_date").join(items, "wo")
        .filter(F.col("qty") - shipped - cancelled > more_than)
        .join(products.filter(F.col("description").like(like) & F.col("capacity_group").between(1, 40))
              .select("product", "description", "category"), "product")
        .select(F.col("salesperson").alias("batch"), as_text("order_date"), "status", "wo", "item", as_double("qty"),
                "stock", "product", "description", "category")
    )


# --- invoices (finished orders) -------------------------------------------------------------------------------------

def sales_by_salesperson(orders, items, products, salespeople, start: str, end: str, min_total: float) -> DataFrame:
    invoices = orders.filter(F.col("order_date").between(day(start), day(end)) & F.col("salesperson").between(0, 9) & (F.col("status") != 1))
    groups = products.select("product", "capacity_group", "description").filter(F.col("capacity_group").between(1, 40))
    return (
        invoices.select("wo", "salesperson", "total").join(items.select("wo", "product", "qty", "subtotal"), "wo")
        .filter((F.col("total") > min_total) | F.col("product").between(1, 100))
        .groupBy("salesperson", "product").agg(F.sum(F.col("subtotal") * F.col("qty")).alias("sales"))
        .join(groups, "product")
        .join(salespeople, "salesperson", "left")
        .select("salesperson", F.concat("first_name", F.lit(" "), "name").alias("name"), "capacity_group", "product",
                F.col("description").alias("product_description"), as_double("sales", "sales_total"))
    )


def sales_by_site(orders, items, products, start: str, end: str) -> DataFrame:
    """Site is salesperson modulo three."""
    invoices = orders.filter(F.col("order_date").between(day(start), day(end)) & (F.col("status") != 1) & (F.col("total") > 0))
    return (
        invoices.select("wo", (F.col("salesperson") % 3).alias("site")).join(items.select("wo", "product", "qty", "subtotal"), "wo")
        .groupBy("site", "product")
        .agg(F.count_distinct("wo").alias("invoice_count"), F.sum(F.col("subtotal") * F.col("qty")).alias("sales"))
        .join(products.select("product", "capacity_group", "category", "description"), "product")
        .select("site", "capacity_group", F.col("category").alias("group_description"), "product",
                F.col("description").alias("product_description"), "invoice_count", as_double("sales", "sales_total"))
    )


def invoices_of_period(orders, items, products, start: str, end: str) -> DataFrame:
    """One row per invoice that has a known product; a semi join instead of grouping the fanned-out lines."""
    sold = items.select("wo", "product").join(products.select("product"), "product", "left_semi")
    return (
        orders.filter(F.col("order_date").between(day(start), day(end)) & (F.col("status") == 0))
        .join(sold.select("wo"), "wo", "left_semi")
        .select(F.col("wo").alias("invoice"), "status", as_text("order_date"), F.date_format("order_date", "yyyyMM").alias("gl_period"),
                "customer", as_double("total"), "salesperson")
    )


def stock_on_hand(products, stock) -> DataFrame:
    have = stock.groupBy("product").agg(F.sum("qty").alias("qty"))
    return products.join(have, "product", "left").select("product", "description", as_double("qty", "on_hand_qty"))


def order_tracking(orders, items, customers, since: str) -> DataFrame:
    """Open orders with dependent lines. The next line of an order depends on it; orders are required in 30 days."""
    today = newest(orders, "order_date")
    required = F.date_add("order_date", 30)
    lines = items.select("wo", "item").distinct()
    depends = lines.select("wo", (F.col("item") - 1).alias("item"), F.col("item").alias("dependent"))
    return (
        orders.filter(F.col("status").between(1, 3) & (F.col("order_date") >= day(since)) & (required >= today))
        .select("wo", "customer", "order_date", required.alias("required"))
        .join(lines, "wo")
        .join(depends, ["wo", "item"], "left")
        .join(customers.select("customer", F.col("name").alias("customer_name")), "customer")
        .select(F.col("wo").alias("order_number"), "customer_name", F.col("item").alias("item_number"),
                F.coalesce(F.col("dependent").cast("string"), F.lit("No Dependencies")).alias("dependent_item"),
                as_text("order_date"), as_text("required", "required_date"))
    )


def orders_by_ranges(orders, items, customers, status=(None, None), dates=(None, None)) -> DataFrame:
    """Order lines by status range and date range; a missing limit is no filter."""
    chosen = orders
    for column, (low, high) in (("status", status), ("order_date", dates)):
        if low is not None:
            chosen = chosen.filter(F.col(column) >= low)
        if high is not None:
            chosen = chosen.filter(F.col(column) <= high)
    return (
        chosen.select("wo", "customer", "order_date").join(items.select("wo", "item"), "wo")
        .join(customers.select("customer", "name"), "customer")
        .select("wo", "name", "item", as_text("order_date"))
    )
