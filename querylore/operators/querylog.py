"""Query logs: extraction from markdown files, deduplication, analysis, usage statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylore.functions import sqltext as S
from querylore.functions.columns import percent, strip
from querylore.operators.relational import count_by, last_per_group

# Which tables make a query belong to which business area.
AREA_TABLES = {
    "customer_management": ["db_customer"],
    "financial": ["db_invoice", "db_invoiceitem", "db_ap", "db_gl"],
    "inventory_management": ["db_stock", "db_stockbalance", "db_warehouse"],
    "order_management": ["db_order", "db_orderitem", "db_orderitemprod", "db_orderiteminv", "db_shipping"],
    "production": ["db_mfg", "db_mfgitem"],
    "sales_reporting": ["db_salesperson", "db_ordersalesperson"],
    "vendor_management": ["db_vendor", "db_po", "db_poitem"],
}


# --- extraction and deduplication -----------------------------------------------------------------------------------

def extract_sql(files: DataFrame) -> DataFrame:
    """One row per file: database from the file name, SQL from the content, its hash and first table."""
    found = files.select("query_id", "fname", S.database_of_file(F.col("fname")).alias("database"), S.embedded_query(F.col("content")).alias("sql"))
    return found.withColumn("hash", S.query_hash(F.col("sql"))).withColumn("main_table", S.main_table(F.col("sql")))


def dedup_queries(extracted: DataFrame) -> DataFrame:
    """First text per hash with the databases that hold it.

    Partial aggregation keeps one entry per hash and map task, so a text that fills a third of the log shuffles like any
    other. Files without SQL form a group that is dropped at the end: a filter on the hash would be pushed below the
    extraction and compute it twice.
    """
    return (
        extracted.groupBy("hash")
        .agg(F.min("query_id").alias("query_id"), F.min_by("sql", "query_id").alias("sql"),
             F.array_sort(F.collect_set("database")).alias("databases"), F.count("*").alias("files"))
        .filter(F.col("sql").isNotNull())
        .withColumn("main_table", S.main_table(F.col("sql")))
        .withColumn("tables", S.from_and_join_tables(F.col("sql")))
    )


def corpus_counts(extracted: DataFrame) -> DataFrame:
    """All counts in one pass. Files are counted per hash first, which makes the distinct count exact and cheap."""
    per_hash = extracted.groupBy("hash").agg(F.count("*").alias("files"))
    has_sql = F.col("hash").isNotNull()
    return per_hash.agg(
        F.sum("files").alias("total_files"),
        F.coalesce(F.sum(F.when(has_sql, F.col("files"))), F.lit(0)).alias("files_with_queries"),
        F.count(F.when(has_sql, 1)).alias("unique_queries"),
    ).select("total_files", F.col("total_files").alias("processed_files"), "files_with_queries", "unique_queries",
             (F.col("files_with_queries") - F.col("unique_queries")).alias("duplicates_removed"))


def queries_per_table(unique: DataFrame) -> DataFrame:
    return count_by(unique.filter(F.col("main_table").isNotNull()), "main_table")


def queries_per_database(unique: DataFrame) -> DataFrame:
    return count_by(unique.select(F.explode("databases").alias("database")), "database")


def shared_queries(unique: DataFrame, n: int = 5) -> DataFrame:
    """Sample of the queries found in more than one database, first seen first."""
    return (
        unique.filter(F.size("databases") > 1).orderBy("query_id").limit(n)
        .select(F.left("hash", F.lit(8)).alias("hash"), F.array_join("databases", ", ").alias("databases"))
    )


# --- analysis -------------------------------------------------------------------------------------------------------

def analyze_queries(queries: DataFrame, name: str = "query_id", text: str = "sql") -> DataFrame:
    """Type, tables, joins, columns, conditions and complexity of each query. An empty text keeps its row, with an error."""
    sql = strip(F.coalesce(F.col(text), F.lit("")))
    base = queries.withColumn("query_text", sql).withColumn("clean", S.without_comments(F.col("query_text")))
    clean = F.col("clean")
    features = (
        base.withColumn("query_type", S.statement_type(clean))
        .withColumn("tables", S.all_tables(clean))
        .withColumn("joins", S.joins(clean))
        .withColumn("columns", S.qualified_columns(clean))
        .withColumn("conditions", S.conditions(clean))
        .withColumn("condition_columns", S.condition_columns(clean))
    )
    score = S.complexity_score(F.col("query_type"), F.col("tables"), F.col("joins"), F.col("conditions"), F.col("query_text"))
    return (
        features.withColumn("score", score).withColumn("complexity", S.complexity_level(F.col("score")))
        .withColumn("error", F.when(F.col("query_text") == "", "empty query"))
        .withColumn("main_table", S.main_table(clean))
        .select(name, "query_text", "query_type", "tables", "joins", "columns", "conditions", "condition_columns",
                "score", "complexity", "error", "main_table")
    )


def business_areas(analyzed: DataFrame) -> DataFrame:
    """Adds ``categories``: business areas by table, reporting for aggregates, simple lookup, else general."""
    text = F.upper("query_text")
    aggregates = text.rlike(r"\b(SUM|COUNT|AVG|MIN|MAX)\s*\(")
    reporting = aggregates & text.contains("GROUP BY")
    simple = (F.col("query_type") == "SELECT") & (F.size("tables") == 1) & (F.size("joins") == 0) & ~aggregates
    by_table = [F.when(F.arrays_overlap("tables", F.array(*map(F.lit, names))), F.lit(area)) for area, names in AREA_TABLES.items()]
    found = F.array_compact(F.array(*by_table, F.when(reporting, "reporting"), F.when(simple, "simple_lookup")))
    listed = F.when(F.size(found) > 0, F.array_sort(found)).otherwise(F.array(F.lit("general")))
    return analyzed.withColumn("categories", listed)


# --- usage ----------------------------------------------------------------------------------------------------------

def table_usage(analyzed: DataFrame) -> DataFrame:
    """Queries per table with their percentage of all queries, which is a scalar."""
    everything = analyzed.agg(F.count("*")).scalar()
    used = count_by(analyzed.select(F.explode("tables").alias("table_name")), "table_name", name="usage")
    return used.withColumn("pct", percent(F.col("usage"), everything))


def join_partners(unique: DataFrame, shown: int = 5) -> DataFrame:
    """Distinct joined tables per main table. Pairs are made distinct before the list, which then holds table names only."""
    pairs = unique.filter(F.size("tables") > 1).select("main_table", F.explode("tables").alias("partner"))
    distinct = pairs.filter(F.col("partner") != F.col("main_table")).distinct()
    partners = distinct.groupBy("main_table").agg(F.array_sort(F.collect_list("partner")).alias("partners"))
    total = F.size("partners")
    more = F.when(total > shown, F.concat(F.lit(" (+"), (total - shown).cast("string"), F.lit(" more)"))).otherwise("")
    return partners.select("main_table", F.concat(F.array_join(F.slice("partners", 1, shown), ", "), more).alias("joined_with"), total.cast("bigint").alias("join_count"))


def table_sets(unique: DataFrame, n: int = 15) -> DataFrame:
    """Most frequent exact sets of two or more tables."""
    sets = unique.filter(F.size("tables") >= 2).select(F.array_join(F.array_sort("tables"), ", ").alias("table_set"))
    return count_by(sets, "table_set").orderBy(F.desc("n"), "table_set").limit(n)


def area_counts(with_areas: DataFrame) -> DataFrame:
    everything = with_areas.agg(F.count("*")).scalar()
    counts = count_by(with_areas.select(F.explode("categories").alias("category")), "category")
    return counts.withColumn("pct", percent(F.col("n"), everything))


def complexity_bins(analyzed: DataFrame) -> DataFrame:
    level = F.floor("score")
    name = F.when(level <= 3, "Simple (1-3)").when(level <= 10, "Medium (4-10)").when(level <= 20, "Complex (11-20)").otherwise("Very Complex (21+)")
    everything = analyzed.agg(F.count("*")).scalar()
    return count_by(analyzed.select(name.alias("level")), "level").withColumn("pct", percent(F.col("n"), everything))


def representative_sample(with_areas: DataFrame, n: int = 75) -> DataFrame:
    """The most complex queries of every category in turn, each query once.

    No more than ``n`` per category can be chosen, so each category is cut to ``n`` before anything is put together.
    """
    exploded = with_areas.select("query_id", "main_table", F.size("tables").alias("table_count"), "score", "categories", F.explode("categories").alias("category"))
    ranked = last_per_group(exploded, ["category"], [F.desc("score"), F.col("query_id")], n, rank="turn")
    once = last_per_group(ranked, ["query_id"], [F.col("turn"), F.col("category")], 1)
    return (
        once.orderBy("turn", "category").limit(n)
        .select("query_id", "main_table", "table_count", "score", F.array_join("categories", ", ").alias("categories"), "turn")
    )
