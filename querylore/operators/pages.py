"""Documentation pages about a query corpus: front page, one page per category, one page per table.

Input is one row per distinct query: query_id, query_text, tables, joins, condition_columns, category, complexity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querylore.functions.columns import percent, percent_text, slug
from querylore.operators.relational import count_by, last_per_group

# Levels in the order pages show them.
LEVELS = ["Low", "Medium", "High", "Very High"]


def page_input(with_areas: DataFrame) -> DataFrame:
    """One category per query, the first of its areas; joins in ``A_JOIN_B`` form."""
    pairs = F.transform("joins", lambda j: F.concat(F.coalesce("main_table", F.lit("")), F.lit("_JOIN_"), j["table"]))
    return with_areas.select(
        "query_id", "query_text", "tables", "condition_columns", pairs.alias("join_pairs"),
        F.coalesce(F.get("categories", F.lit(0)), F.lit("Uncategorized")).alias("category"),
        F.coalesce("complexity", F.lit("Medium")).alias("complexity"))


def join_partner(pair: Column, table: Column) -> Column:
    """The other side of ``A_JOIN_B``; null when the table is on neither side."""
    sides = F.split(pair, "_JOIN_")
    return F.when(sides[0] == table, sides[1]).when(sides[1] == table, sides[0])


# --- front page -----------------------------------------------------------------------------------------------------

def front_categories(queries: DataFrame) -> DataFrame:
    counts = count_by(queries, "category")
    return counts.withColumn("path", F.concat(F.lit("query_patterns/"), slug(F.col("category")), F.lit(".md"))).orderBy(F.desc("n"), "category")


def front_tables(queries: DataFrame, n: int = 20) -> DataFrame:
    used = count_by(queries.select(F.explode("tables").alias("table_name")), "table_name")
    path = F.concat(F.lit("tables_usage/"), slug(F.col("table_name")), F.lit(".md"))
    return used.orderBy(F.desc("n"), "table_name").limit(n).withColumn("path", path)


# --- category pages -------------------------------------------------------------------------------------------------

def category_levels(queries: DataFrame) -> DataFrame:
    """Every category with all four levels, also those nobody has."""
    totals = count_by(queries, "category", name="total")
    grid = totals.select("category", "total", F.posexplode(F.array(*map(F.lit, LEVELS))).alias("level_no", "complexity"))
    counts = count_by(queries, "category", "complexity")
    n = F.coalesce("n", F.lit(0))
    return grid.join(counts, ["category", "complexity"], "left").select(
        "category", "level_no", "complexity", n.alias("n"), percent(n, F.col("total")).alias("pct"), percent_text(n, F.col("total")).alias("pct_text"))


def _tables_of(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", "category", "complexity", "query_text", F.explode("tables").alias("table_name"))


def category_tables(queries: DataFrame, n: int = 15) -> DataFrame:
    totals = count_by(queries, "category", name="total")
    counts = count_by(_tables_of(queries), "category", "table_name")
    top = last_per_group(counts, ["category"], [F.desc("n"), F.col("table_name")], n)
    share = F.col("n"), F.col("total")
    return top.join(totals, "category").select("category", "position", "table_name", "n", percent(*share).alias("pct"), percent_text(*share).alias("pct_text"))


def category_samples(queries: DataFrame, n: int = 20) -> DataFrame:
    """Sorted by the name of the level, so High comes before Low."""
    top = last_per_group(queries, ["category"], [F.col("complexity"), F.col("query_id")], n)
    return top.select("category", "position", "query_id", "complexity", F.array_join("tables", ", ").alias("tables"), "query_text")


# Headings and table heads of the pages.
CATEGORY_HEAD = "'.\n\n## Complexity Distribution\n\n| Complexity | Count | Percentage |\n|-----------|-------|------------|\n"
CATEGORY_TABLES = "\n## Tables Used in this Category\n\n| Table Name | Query Count | Percentage |\n|------------|------------|------------|\n"
CATEGORY_SAMPLES = "\n## Sample Queries\n\n"
NO_DESCRIPTION = "No description available"
INDEX_HEAD = "# SQL Query Documentation\n\nThis documentation catalogs and analyzes common SQL query patterns from a repository of "
INDEX_CATEGORIES = " queries.\n\n## Query Categories\n\n"
INDEX_TABLES = "\n## Most Used Tables\n\n| Table Name | Query Count |\n|------------|------------|\n"
USAGE_CATEGORIES = " queries.\n\n## Usage by Category\n\n| Category | Query Count | Percentage |\n|----------|------------|------------|\n"
USAGE_JOINS = "\n## Common Join Patterns\n\n| Joined With | Query Count | Percentage |\n|------------|------------|------------|\n"
USAGE_FILTERS = "\n## Common WHERE Conditions\n\n| Column | Query Count | Percentage |\n|--------|------------|------------|\n"
USAGE_SAMPLES = "\n## Sample Queries Using This Table\n\n"


def _text(*parts) -> Column:
    """Columns and fixed texts in a row; null when a column is."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |\n"))


def _linked(name: Column, folder: str) -> Column:
    return _text("[", name, f"]({folder}", slug(name), ".md)")


def _lines(df: DataFrame, keys: list[str], order: list[Column], line: Column, name: str) -> DataFrame:
    """The lines of each page in order. What is gathered here is cut to a fixed length or counted per name before."""
    row = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], line.alias("line"))
    return df.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["line"]), "").alias(name))


def category_pages(queries: DataFrame) -> DataFrame:
    """Rows (path, content). Lists are cut to their fixed lengths before they are gathered."""
    n, pct = F.col("n").cast("string"), F.col("pct_text")
    sample = _text("### Query ", F.col("query_id").cast("string"), "\n\n**Complexity**: ", F.col("complexity"), "  \n**Tables**: ", F.col("tables"),
                   f"  \n**Description**: {NO_DESCRIPTION}  \n\n```sql\n", F.col("query_text"), "\n```\n\n")
    parts = [
        _lines(category_levels(queries), ["category"], [F.col("level_no")], _row(F.col("complexity"), n, pct), "levels"),
        _lines(category_tables(queries), ["category"], [F.col("position")], _row(_linked(F.col("table_name"), "../tables_usage/"), n, pct), "tables"),
        _lines(category_samples(queries), ["category"], [F.col("position")], sample, "samples"),
    ]
    out = count_by(queries, "category", name="total")
    for part in parts:
        out = out.join(part, "category", "left")
    empty = F.lit("")
    content = _text(
        "# ", F.col("category"), " Queries\n\nThis document contains ", F.col("total").cast("string"), " queries categorized as '", F.col("category"), CATEGORY_HEAD, F.col("levels"),
        F.coalesce(_text(CATEGORY_TABLES, F.col("tables")), empty), CATEGORY_SAMPLES, F.coalesce("samples", empty))
    return out.select(_text("query_patterns/", slug(F.col("category")), ".md").alias("path"), content.alias("content"))


def index_page(queries: DataFrame) -> DataFrame:
    """One row (path, content): all categories and the most used tables."""
    n = F.col("n").cast("string")
    categories = _lines(front_categories(queries), [], [-F.col("n"), F.col("category")], _text("- [", F.col("category"), "](", F.col("path"), ") (", n, " queries)\n"), "categories")
    tables = _lines(front_tables(queries), [], [-F.col("n"), F.col("table_name")], _row(_text("[", F.col("table_name"), "](", F.col("path"), ")"), n), "tables")
    total = queries.agg(F.count("*").cast("string").alias("total"))
    content = _text(INDEX_HEAD, F.col("total"), INDEX_CATEGORIES, categories.scalar(), INDEX_TABLES, tables.scalar())
    return total.select(F.lit("index.md").alias("path"), content.alias("content"))


# --- table pages ----------------------------------------------------------------------------------------------------

def used_tables(queries: DataFrame, at_least: int = 2) -> DataFrame:
    """Tables with significant use."""
    return count_by(_tables_of(queries), "table_name", name="total").filter(F.col("total") >= at_least)


def table_overview(queries: DataFrame, catalog_tables: DataFrame) -> DataFrame:
    """Use count and, where a catalog knows the table, its description. One description per name, whatever the tenant."""
    known = catalog_tables.groupBy("table_name").agg(F.min("description").alias("description"))
    return used_tables(queries).join(known, "table_name", "left")


def table_categories(queries: DataFrame) -> DataFrame:
    counts = count_by(_tables_of(queries), "table_name", "category")
    return counts.join(used_tables(queries), "table_name").select("table_name", "category", "n", percent(F.col("n"), F.col("total")).alias("pct"))


def table_partners(queries: DataFrame) -> DataFrame:
    """Partners are counted per (table, partner) pair; no list of queries is gathered for a busy table."""
    pairs = queries.select(F.explode("join_pairs").alias("pair"), "tables")
    sides = pairs.select("pair", F.explode("tables").alias("table_name"))
    partners = sides.withColumn("partner", join_partner(F.col("pair"), F.col("table_name"))).filter("partner IS NOT NULL")
    counts = count_by(partners, "table_name", "partner")
    return counts.join(used_tables(queries), "table_name").select("table_name", "partner", "n", percent(F.col("n"), F.col("total")).alias("pct"))


def table_filters(queries: DataFrame, n: int = 10) -> DataFrame:
    found = queries.select(F.inline("condition_columns").alias("table_name", "column"))
    counts = count_by(found.filter("table_name IS NOT NULL"), "table_name", "column")
    used = counts.join(used_tables(queries), "table_name")
    top = last_per_group(used, ["table_name"], [F.desc("n"), F.col("column")], n)
    return top.select("table_name", "position", "column", "n", percent(F.col("n"), F.col("total")).alias("pct"))


def table_samples(queries: DataFrame, n: int = 10) -> DataFrame:
    used = _tables_of(queries).join(used_tables(queries), "table_name", "left_semi")
    return last_per_group(used, ["table_name"], [F.col("complexity"), F.col("query_id")], n).select("table_name", "position", "query_id", "complexity", "category", "query_text")


def table_usage_pages(queries: DataFrame, catalog_tables: DataFrame) -> DataFrame:
    """Rows (path, content), one per table with significant use."""
    used, n, key = used_tables(queries), F.col("n").cast("string"), ["table_name"]
    share = percent_text(F.col("n"), F.col("total"))
    by_use = [-F.col("n")]
    categories = table_categories(queries).join(used, "table_name")
    partners = table_partners(queries).join(used, "table_name")
    filters = table_filters(queries).join(used, "table_name")
    sample = _text("### ", F.col("category"), " Query (Complexity: ", F.col("complexity"), ")\n\n```sql\n", F.col("query_text"), "\n```\n\n")
    parts = [
        _lines(categories, key, [*by_use, F.col("category")], _row(_linked(F.col("category"), "../query_patterns/"), n, share), "categories"),
        _lines(partners, key, [*by_use, F.col("partner")], _row(_linked(F.col("partner"), "./"), n, share), "partners"),
        _lines(filters, key, [F.col("position")], _row(F.col("column"), n, share), "filters"),
        _lines(table_samples(queries), key, [F.col("position")], sample, "samples"),
    ]
    out = table_overview(queries, catalog_tables)
    for part in parts:
        out = out.join(part, "table_name", "left")
    name, empty = F.col("table_name"), F.lit("")
    schema = _text(F.col("description"), "\n\nSee [full schema documentation](../../schema/tables/", name, ".md) for this table.\n\n")
    content = _text(
        "# ", name, " Usage Documentation\n\n", F.coalesce(schema, empty), "This document describes how the `", name, "` table is used across ", F.col("total").cast("string"),
        USAGE_CATEGORIES, F.coalesce("categories", empty), F.coalesce(_text(USAGE_JOINS, F.col("partners")), empty), F.coalesce(_text(USAGE_FILTERS, F.col("filters")), empty),
        USAGE_SAMPLES, F.coalesce("samples", empty))
    return out.select(_text("tables_usage/", slug(name), ".md").alias("path"), content.alias("content"))
