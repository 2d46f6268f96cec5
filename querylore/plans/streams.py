"""Streaming operators over tables that arrive in several files."""

from pyspark.sql import functions as F

from querylore.operators import querylog as Q
from querylore.operators import states as A
from querylore.operators.reports import newest
from querylore.plans.feedback import TRAINING
from querylore.plans.query_log import EXTRACTED, UNIQUE
from querylore.plans.registry import plan
from querylore.plans.sessions import STAMP, stamp
from querylore.plans.reports import YEAR_AGO
from querylore.session import scratch_dir, spread
from querylore.sources.stores import KeyedTable
from querylore.streaming import jobs as Z


def _arriving(t, df, name: str, scan: bool = True):
    """The table as a stream of several batches. Its files are as many as its scan has splits, or cores, so every batch is parallel."""
    folder = scratch_dir(t.spark, f"arriving-{name}")
    (spread(df) if scan else df).write.parquet(folder)
    return Z.arriving(t.spark, folder, df.schema, files_per_batch=t.spark.sparkContext.defaultParallelism // 2 + 1)


def _run(t, start, stream, name: str, **options) -> str:
    out = scratch_dir(t.spark, name)
    start(stream, out, scratch_dir(t.spark, f"{name}-checkpoint"), **options).awaitTermination()
    return out


@plan("z01_incremental_training", f"WITH {TRAINING} SELECT * FROM tr")
def _(t):
    out = _run(t, Z.incremental_training, _arriving(t, t.query_feedback, "feedback"), "training")
    rows = t.spark.read.parquet(f"{out}/training").drop("batch")
    return rows.withColumn("confidence_weight", F.col("confidence_weight").cast("double"))


@plan("z02_first_requests", "SELECT DISTINCT event_type || '::' || user_id AS request_key FROM events")
def _(t):
    # how many requests stay depends on how they are split into batches; that every key stays does not
    requests = t.events.select(F.concat_ws("::", "event_type", F.col("user_id").cast("string")).alias("request_key"), F.col("ts").cast("timestamp").alias("ts"))
    out = _run(t, Z.first_requests, _arriving(t, requests, "requests"), "first-requests")
    return t.spark.read.parquet(out).select("request_key").distinct()


@plan("z02_reuse_within_ttl", """WITH RECURSIVE rq AS (SELECT DISTINCT event_type AS request_key, epoch_us(ts) // 1000000 AS second FROM events),
chain AS (SELECT request_key, min(second) AS second FROM rq GROUP BY 1
  UNION ALL SELECT c.request_key, min(r.second) FROM chain c JOIN rq r ON r.request_key = c.request_key AND r.second >= c.second + 3600 GROUP BY c.request_key)
SELECT r.request_key, r.second, CASE WHEN c.second IS NULL THEN 0 ELSE 1 END::BIGINT AS computed FROM rq r LEFT JOIN chain c ON r.request_key = c.request_key AND r.second = c.second""")
def _(t):
    # files come in no order of time: rows are late by the whole log at most
    requests = t.events.select(F.col("event_type").alias("request_key"), F.col("ts").cast("timestamp").alias("ts"))
    out = _run(t, Z.reused_requests, _arriving(t, requests, "reused"), "reused", delay="3650 days")
    return Z.latest_state(t.spark, out, ["request_key", "second"])


@plan("z03_running_analytics", f"""SELECT company_id, md5(content) AS question_hash, count(*) AS use_count, {STAMP.format("min(created_at)")} AS first_used, {STAMP.format("max(created_at)")} AS last_used
FROM chat_message WHERE message_type = 'user' GROUP BY 1, 2""")
def _(t):
    messages = t.chat_message.select("company_id", "message_type", "content", "created_at")
    out = _run(t, Z.running_analytics, _arriving(t, messages, "messages"), "analytics")
    return Z.latest_state(t.spark, out, ["company_id", "question_hash"]).withColumns({"first_used": stamp("first_used"), "last_used": stamp("last_used")})


@plan("z03_hourly_analytics", f"SELECT company_id, {STAMP.format("date_trunc('hour', created_at)")} AS hour_start, count(*) AS messages FROM chat_message GROUP BY 1, 2")
def _(t):
    # files come in no order of time, so nothing may count as late here
    messages = t.chat_message.select("company_id", F.col("created_at").cast("timestamp").alias("created_at"))
    out = _run(t, Z.hourly_analytics, _arriving(t, messages, "hourly-messages"), "hourly", delay="60 days")
    return Z.latest_state(t.spark, out, ["company_id", "hour_start"]).withColumn("hour_start", stamp("hour_start"))


def _catalog(t):
    """All files of the log, merged batch after batch."""
    path = scratch_dir(t.spark, "catalog")
    Z.growing_catalog(_arriving(t, t.query_log.select("query_id", "fname", "content"), "query-files"), path).awaitTermination()
    return KeyedTable(t.spark, path).read()


@plan("q06_growing_catalog", f"WITH {UNIQUE} SELECT hash, query_id, sql, array_to_string(databases, ',') AS databases, files, main_table FROM uq")
def _(t):
    return A.catalog_queries(_catalog(t)).select("hash", "query_id", "sql", F.array_join("databases", ",").alias("databases"), "files", "main_table")


@plan("q07_growing_counts", f"""WITH {EXTRACTED} SELECT count(*) AS total_files, count(*) AS processed_files, count(hash) AS files_with_queries,
  count(DISTINCT hash) AS unique_queries, count(hash) - count(DISTINCT hash) AS duplicates_removed FROM ex""")
def _(t):
    return A.catalog_counts(_catalog(t))


@plan("q08_growing_usage", f"""WITH {UNIQUE} SELECT 'table' AS kind, main_table AS name, count(*) AS n FROM uq WHERE main_table IS NOT NULL GROUP BY 2
UNION ALL SELECT 'database', d, count(*) FROM (SELECT unnest(databases) AS d FROM uq) GROUP BY 2""")
def _(t):
    unique = A.catalog_queries(_catalog(t))
    tables = Q.queries_per_table(unique).select(F.lit("table").alias("kind"), F.col("main_table").alias("name"), "n")
    return tables.unionByName(Q.queries_per_database(unique).select(F.lit("database").alias("kind"), F.col("database").alias("name"), "n"))


_PERIOD_ROWS = " UNION ALL ".join(f"""SELECT '{p}' AS period, CAST(CAST(date_trunc('{p}', order_date) AS DATE) AS VARCHAR) AS start, count(*) AS order_count,
  count(DISTINCT customer) AS unique_customers, CAST(sum(total) AS DOUBLE) AS total_revenue, CAST(sum(total) AS DOUBLE) / count(*) AS average_order_value,
  CAST(sum(total * lines) AS DOUBLE) AS total_line_revenue, CAST(sum(total * lines) AS DOUBLE) / sum(lines) AS average_line_value,
  CAST(sum(q) AS DOUBLE) AS total_items_sold FROM o GROUP BY 2""" for p in A.PERIODS)


@plan("b11_growing_sales", f"""WITH o AS (SELECT o.order_date, o.customer, o.total, i.lines, i.q FROM db_order o
  JOIN (SELECT wo, count(*) AS lines, sum(qty) AS q FROM db_orderitem GROUP BY wo) i ON o.wo = i.wo WHERE o.status >= 1 AND o.order_date >= {YEAR_AGO}) {_PERIOD_ROWS}""")
def _(t):
    path = scratch_dir(t.spark, "sales")
    Z.growing_sales(_arriving(t, A.counted_orders(t.db_order, t.db_orderitem), "orders", scan=False), path).awaitTermination()
    return A.sales_of_periods(KeyedTable(t.spark, path).read(), F.add_months(newest(t.db_order, "order_date"), -12))
