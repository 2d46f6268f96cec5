"""Database catalogs: tables, columns, keys and indexes to nested schema documents, relationships and markdown.

Inputs carry a ``tenant`` column, so many catalogs are handled in one pass. The lists gathered here are the columns,
keys, indexes and references of one table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querylore.functions.columns import escape_pipe
from querylore.operators.relational import joined_list, keep_known, unshared

TABLE = ["tenant", "table_name"]


def full_type(data_type: Column, char_len: Column, precision: Column, scale: Column) -> Column:
    """``varchar(25)``, ``decimal(15,2)``, ``bigint(64)`` or the bare name; zero counts as absent."""
    def present(c):
        return c.isNotNull() & (c != 0)

    def wrap(*parts):
        return F.concat(data_type, F.lit("("), F.concat_ws(",", *[p.cast("string") for p in parts]), F.lit(")"))

    return (
        F.when(present(char_len), wrap(char_len))
        .when(present(precision) & present(scale), wrap(precision, scale))
        .when(present(precision), wrap(precision))
        .otherwise(data_type)
    )


def _described(comment: str, fallback: Column) -> Column:
    return F.coalesce(F.nullif(F.col(comment), F.lit("")), fallback)


def base_tables(tables: DataFrame) -> DataFrame:
    fallback = F.concat(F.lit("Table "), "table_name")
    return tables.filter(F.col("table_type") == "BASE TABLE").select(*TABLE, _described("table_comment", fallback).alias("description"))


def columns(tables: DataFrame, cols: DataFrame) -> DataFrame:
    """Columns of known tables with their full type; the key and index flags come with ``flagged_columns``."""
    fallback = F.concat(F.lit("Column "), "column_name", F.lit(" in "), "table_name")
    return keep_known(cols, base_tables(tables), *TABLE).select(
        *TABLE, "ordinal", "column_name",
        full_type(F.col("data_type"), F.col("char_len"), F.col("num_precision"), F.col("num_scale")).alias("data_type"),
        (F.col("is_nullable") == "YES").alias("is_nullable"), F.col("column_default").alias("default"),
        _described("column_comment", fallback).alias("description"),
    )


def primary_key_columns(tables: DataFrame, keys: DataFrame) -> DataFrame:
    primary = keys.filter(F.col("constraint_name") == "PRIMARY").select(*TABLE, "column_name", "ordinal")
    return keep_known(primary, base_tables(tables), *TABLE)


def primary_keys(tables: DataFrame, keys: DataFrame, cols: DataFrame | None = None) -> DataFrame:
    """Key columns per table in key order, or in table order when the columns are given."""
    primary = primary_key_columns(tables, keys)
    if cols is not None:
        primary = primary.drop("ordinal").join(unshared(cols.select(*TABLE, "column_name", "ordinal")), [*TABLE, "column_name"])
    return primary.groupBy(*TABLE).agg(joined_list("column_name", "ordinal").alias("primary_key"))


def foreign_keys(tables: DataFrame, keys: DataFrame) -> DataFrame:
    """One row per key column pair, paired by position, when both tables are known."""
    known = base_tables(tables).select(*TABLE)
    edges = keys.filter(F.col("ref_table").isNotNull()).select(*TABLE, "column_name", "constraint_name", "ordinal", "ref_table", "ref_column")
    targets = known.withColumnRenamed("table_name", "ref_table")
    return keep_known(keep_known(edges, known, *TABLE), targets, "tenant", "ref_table")


def column_references(edges: DataFrame) -> DataFrame:
    """The reference a column shows: of several edges the last by constraint name."""
    last = F.max_by(F.struct("ref_table", "ref_column", "constraint_name"), F.struct("constraint_name", "ordinal"))
    return edges.groupBy(*TABLE, "column_name").agg(last.alias("last_edge")).select(*TABLE, "column_name", "last_edge.*")


def referenced_by(edges: DataFrame) -> DataFrame:
    """The same edges seen from the target."""
    return edges.select("tenant", F.col("ref_table").alias("table_name"), F.col("table_name").alias("from_table"),
                        F.col("column_name").alias("from_column"), F.col("constraint_name").alias("via"))


def indexes(tables: DataFrame, idx: DataFrame) -> DataFrame:
    known = keep_known(idx, base_tables(tables), *TABLE)
    return known.groupBy(*TABLE, "index_name").agg(
        joined_list("column_name", "seq").alias("columns"), (F.min("non_unique") == 0).alias("is_unique"),
    ).withColumn("is_primary", F.col("index_name") == "PRIMARY")


def flagged_columns(tables: DataFrame, cols: DataFrame, keys: DataFrame, idx: DataFrame) -> DataFrame:
    """Columns with their primary key, foreign key and index marks. The three kinds of mark meet in one grouping."""
    def mark(df, **flags):
        names = {"pk": F.lit(None).cast("boolean"), "fk": F.lit(None).cast("boolean"), "ix": F.lit(None).cast("boolean")} | flags
        return df.select(*TABLE, "column_name", *[c.alias(n) for n, c in names.items()])

    marks = (
        mark(primary_key_columns(tables, keys), pk=F.lit(True))
        .unionByName(mark(foreign_keys(tables, keys), fk=F.lit(True)))
        .unionByName(mark(idx, ix=F.lit(True)))
        .groupBy(*TABLE, "column_name").agg(F.max("pk").alias("pk"), F.max("fk").alias("fk"), F.max("ix").alias("ix"))
    )
    no = F.lit(False)
    return columns(tables, cols).join(unshared(marks), [*TABLE, "column_name"], "left").select(
        *TABLE, "ordinal", "column_name", "data_type", "is_nullable", "default", "description",
        F.coalesce("pk", no).alias("is_primary_key"), F.coalesce("fk", no).alias("is_foreign_key"), F.coalesce("ix", no).alias("has_index"),
    )


def schema_documents(tables: DataFrame, cols: DataFrame, keys: DataFrame, idx: DataFrame) -> DataFrame:
    """One nested row per table. Missing lists are empty, never null.

    Columns, keys, references and indexes of a table meet in one grouping, each kind in a column of its own; the marks of a column are then read
    off the lists of its table. Rows of what is no base table have no description and go.
    """
    edges = foreign_keys(tables, keys)
    name = F.col("column_name")
    described = F.coalesce(F.nullif(F.col("column_comment"), F.lit("")), F.concat(F.lit("Column "), name, F.lit(" in "), "table_name"))
    kinds = {
        "description": base_tables(tables).select(*TABLE, F.col("description").alias("v")),
        "column": cols.select(*TABLE, F.struct(
            "ordinal", "column_name", full_type(F.col("data_type"), F.col("char_len"), F.col("num_precision"), F.col("num_scale")).alias("data_type"),
            (F.col("is_nullable") == "YES").alias("is_nullable"), F.col("column_default").alias("default"), described.alias("description")).alias("v")),
        "key": keys.filter(F.col("constraint_name") == "PRIMARY").select(*TABLE, F.struct("ordinal", "column_name").alias("v")),
        "foreign": edges.select(*TABLE, F.struct("constraint_name", "ordinal", "column_name", "ref_table", "ref_column").alias("v")),
        "index": idx.select(*TABLE, F.struct("index_name", "seq", "column_name", "non_unique").alias("v")),
        "reference": referenced_by(edges).select(*TABLE, F.struct("from_table", "via", "from_column").alias("v")),
    }
    types = {kind: df.schema["v"].dataType for kind, df in kinds.items()}
    tagged = [df.select(*TABLE, *[F.col("v").alias(k) if k == kind else F.lit(None).cast(types[k]).alias(k) for k in kinds]) for kind, df in kinds.items()]
    rows = reduce(DataFrame.unionByName, tagged).groupBy(*TABLE).agg(
        F.max("description").alias("description"), *[F.array_sort(F.collect_list(k)).alias(k) for k in kinds if k != "description"])
    rows = rows.filter(F.col("description").isNotNull())

    def holds(kind: str, c: Column) -> Column:
        return F.exists(kind, lambda e: e["column_name"] == c["column_name"])

    flagged = F.transform("column", lambda c: F.struct(
        c["ordinal"].alias("ordinal"), c["column_name"].alias("column_name"), c["data_type"].alias("data_type"), c["is_nullable"].alias("is_nullable"),
        c["default"].alias("default"), c["description"].alias("description"), holds("key", c).alias("is_primary_key"),
        holds("foreign", c).alias("is_foreign_key"), holds("index", c).alias("has_index")))

    def one_index(index_name: Column) -> Column:
        own = F.filter("index", lambda i: i["index_name"] == index_name)
        return F.struct(
            index_name.alias("index_name"), F.array_join(F.transform(own, lambda i: i["column_name"]), ",").alias("columns"),
            (F.array_min(F.transform(own, lambda i: i["non_unique"])) == 0).alias("is_unique"), (index_name == "PRIMARY").alias("is_primary"))

    return rows.select(
        *TABLE, "description", flagged.alias("columns"), F.transform("key", lambda k: k["column_name"]).alias("primary_key"), F.col("foreign").alias("foreign_keys"),
        F.transform(F.array_distinct(F.transform("index", lambda i: i["index_name"])), one_index).alias("indexes"), F.col("reference").alias("referenced_by"))


def relationship_edges(tables: DataFrame, keys: DataFrame) -> DataFrame:
    return foreign_keys(tables, keys).select(
        "tenant", F.col("table_name").alias("source_table"), F.col("column_name").alias("source_column"),
        F.col("ref_table").alias("target_table"), F.col("ref_column").alias("target_column"))


def ordered_edges(edges: DataFrame, first: str = "source") -> DataFrame:
    """The edges of each tenant with their place among them: by source and then target, or the other way round."""
    second = {"source": "target", "target": "source"}[first]
    order = Window.partitionBy("tenant").orderBy(f"{first}_table", f"{second}_table", f"{first}_column", f"{second}_column")
    return edges.withColumn("position", F.row_number().over(order))


def tables_summary(documents: DataFrame) -> DataFrame:
    return documents.select(
        *TABLE, escape_pipe(F.col("description")).alias("description"), F.size("columns").alias("column_count"),
        F.coalesce(F.nullif(F.array_join("primary_key", ", "), F.lit("")), F.lit("None")).alias("primary_key"),
        F.size("foreign_keys").alias("foreign_key_count"))


def suggested_joins(tables: DataFrame, keys: DataFrame) -> DataFrame:
    """Joins worth showing for a table: to each referenced table, and from each referencing table on the first key column."""
    edges = foreign_keys(tables, keys)
    forward = edges.select(*TABLE, F.col("ref_table").alias("other_table"), F.lit("references").alias("direction"),
                           F.col("column_name").alias("own_column"), F.col("ref_column").alias("other_column"))
    first_key = primary_key_columns(tables, keys).groupBy(*TABLE).agg(F.min_by("column_name", "ordinal").alias("own_column"))
    backward = referenced_by(edges).join(unshared(first_key), TABLE).select(
        *TABLE, F.col("from_table").alias("other_table"), F.lit("referenced by").alias("direction"), "own_column", F.col("from_column").alias("other_column"))
    return forward.unionByName(backward).withColumn(
        "join_sql", _join_example(F.col("table_name"), F.col("other_table"), F.col("own_column"), F.col("other_column")))


def _join_example(table: Column, other: Column, own: Column, theirs: Column) -> Column:
    return F.concat(F.lit("SELECT t1.*, t2.*\nFROM "), table, F.lit(" t1\nJOIN "), other, F.lit(" t2 ON t1."), own, F.lit(" = t2."), theirs)


# Headings, table heads and marks of the pages.
TABLE_MARKS = ("[TABLE: ", "[/TABLE: ")
EXAMPLE_MARKS = ("\n\n[QUERY_EXAMPLE]\n```sql\n", "\n```\n[/QUERY_EXAMPLE]\n")
STATISTICS = ("## Quick Statistics\n\n- **Columns**: ", "\n- **Primary Key**: ", "\n- **Foreign Keys**: ", "\n- **Referenced By**: ", " tables\n- **Indexes**: ")
COLUMN_HEAD = "## Columns\n\n| Column Name | Data Type | Nullable | Default | Description | PK | FK | Indexed |\n|-------------|-----------|----------|---------|-------------|----|----|---------|\n"
KEY_HEAD = "\n## Primary Key\n\n| Column |\n|--------|\n"
FOREIGN_HEAD = "\n## Foreign Keys\n\n| Column | Referenced Table | Referenced Column |\n|--------|------------------|-------------------|\n"
REFERENCE_HEAD = "\n## Referenced By\n\n| Table | Column | Foreign Key |\n|-------|--------|-------------|\n"
INDEX_HEAD = "\n## Indexes\n\n| Name | Columns | Unique | Primary |\n|------|---------|--------|--------|\n"
JOIN_HEAD = "\n## Common Join Patterns\n\n"
SUMMARY_HEAD = "# Tables Summary\n\n| Table Name | Description | # Columns | Primary Key | Foreign Keys |\n|------------|-------------|-----------|-------------|--------------|\n"
RELATIONS_HEAD = "# Database Relationships Summary\n\n"
BY_SOURCE_HEAD = "## Relationships by Source Table\n\n| Source Table | Source Column | Target Table | Target Column |\n|--------------|--------------|-------------|---------------|\n"
BY_TARGET_HEAD = "\n## Relationships by Target Table\n\n| Target Table | Target Column | Source Table | Source Column |\n|--------------|--------------|-------------|---------------|\n"
INDEX_PAGE = (
    "# Database Schema Documentation\n\nThis documentation describes the database schema extracted on ",
    "\n\n## Contents\n\n- [Tables Summary](tables/tables_summary.md)\n- [Relationships Summary](relationships/relationships_summary.md)\n\n## Tables\n\n",
)


# --- markdown -------------------------------------------------------------------------------------------------------

def _lines(array: Column, line) -> Column:
    """Every element as a line of its own, each ended by a newline."""
    return F.array_join(F.transform(array, lambda e: F.concat(line(e), F.lit("\n"))), "")


def _section(array: Column, head: str, line) -> Column:
    """A headed table, left out when the list is empty."""
    return F.when(F.size(array) > 0, F.concat(F.lit(head), _lines(array, line))).otherwise("")


def _tick(flag: Column) -> Column:
    return F.when(flag, "✓").otherwise("")


def _cells(*cells: Column) -> Column:
    parts = []
    for cell in cells:
        parts += [F.lit("| "), cell, F.lit(" ")]
    return F.concat(*parts, F.lit("|"))


def _example(title: Column, sql: Column) -> Column:
    return F.concat(F.lit("### Join with "), title, F.lit(EXAMPLE_MARKS[0]), sql, F.lit(EXAMPLE_MARKS[1]))


def table_documents(documents: DataFrame) -> DataFrame:
    """One markdown text per table between its markers. Text is put together on the executors, row by row."""
    name, key = F.col("table_name"), F.col("primary_key")
    fks, refs = F.col("foreign_keys"), F.col("referenced_by")

    def link(table):
        return F.concat(F.lit("["), table, F.lit("](./"), table, F.lit(".md)"))

    by_name = F.array_sort("columns", lambda a, b: F.when(a["column_name"] < b["column_name"], -1).when(a["column_name"] > b["column_name"], 1).otherwise(0))
    statistics = F.concat(
        F.lit(STATISTICS[0]), F.size("columns").cast("string"),
        F.lit(STATISTICS[1]), F.when(F.size(key) > 0, F.array_join(key, ", ")).otherwise("None"),
        F.lit(STATISTICS[2]), F.size(fks).cast("string"),
        F.lit(STATISTICS[3]), F.size(refs).cast("string"),
        F.lit(STATISTICS[4]), F.size("indexes").cast("string"), F.lit("\n\n"))
    column_table = F.concat(
        F.lit(COLUMN_HEAD),
        _lines(by_name, lambda c: _cells(
            c["column_name"], escape_pipe(c["data_type"]), F.when(c["is_nullable"], "YES").otherwise("NO"),
            F.coalesce(escape_pipe(c["default"]), F.lit("NULL")), escape_pipe(c["description"]),
            _tick(c["is_primary_key"]), _tick(c["is_foreign_key"]), _tick(c["has_index"]))))
    joins = F.concat(
        F.lit(JOIN_HEAD),
        _lines(fks, lambda f: _example(f["ref_table"], _join_example(name, f["ref_table"], f["column_name"], f["ref_column"]))),
        F.when(F.size(key) > 0, _lines(refs, lambda r: _example(
            F.concat(r["from_table"], F.lit(" (referencing)")), _join_example(name, r["from_table"], key[0], r["from_column"])))).otherwise(""))
    content = F.concat(
        F.lit(TABLE_MARKS[0]), name, F.lit("]\n# Table: "), name, F.lit("\n\n"), F.col("description"), F.lit("\n\n"),
        statistics, column_table,
        _section(key, KEY_HEAD, lambda c: _cells(c)),
        _section(fks, FOREIGN_HEAD,
                 lambda f: _cells(f["column_name"], link(f["ref_table"]), f["ref_column"])),
        _section(refs, REFERENCE_HEAD,
                 lambda r: _cells(link(r["from_table"]), r["from_column"], r["via"])),
        _section(F.col("indexes"), INDEX_HEAD,
                 lambda i: _cells(i["index_name"], F.replace(i["columns"], F.lit(","), F.lit(", ")), _tick(i["is_unique"]), _tick(i["is_primary"]))),
        joins, F.lit(TABLE_MARKS[1]), name, F.lit("]\n"))
    return documents.select(*TABLE, content.alias("content"))


def _page(order: list[str], line: Column) -> Column:
    """The lines of a group in order, one text."""
    pairs = F.array_sort(F.collect_list(F.struct(*order, line.alias("line"))))
    return F.array_join(F.transform(pairs, lambda p: p["line"]), "")


def _table_link(table: str, folder: str) -> Column:
    return F.concat(F.lit("["), table, F.lit(f"]({folder}/"), table, F.lit(".md)"))


def tables_summary_pages(documents: DataFrame) -> DataFrame:
    """(path, content): a page for each tenant that lists its tables. A page is one text, so a tenant's tables meet in one group."""
    rows = tables_summary(documents)
    line = F.concat(_cells(
        _table_link("table_name", "./tables"), F.col("description"), F.col("column_count").cast("string"), F.col("primary_key"), F.col("foreign_key_count").cast("string")), F.lit("\n"))
    return rows.groupBy("tenant").agg(_page(["table_name"], line).alias("lines")).select(
        F.concat(F.lit("tables/"), "tenant", F.lit("/tables_summary.md")).alias("path"), F.concat(F.lit(SUMMARY_HEAD), "lines").alias("content"))


def relationships_summary_pages(edges: DataFrame, tables: DataFrame) -> DataFrame:
    """(path, content): a page for each tenant with its references in both orders, by source and by target. Both lists come from one grouping."""
    def lines(first: str, second: str) -> Column:
        cells = [_table_link(f"{first}_table", "../tables"), F.col(f"{first}_column"), _table_link(f"{second}_table", "../tables"), F.col(f"{second}_column")]
        return _page([f"{first}_table", f"{second}_table", f"{first}_column", f"{second}_column"], F.concat(_cells(*cells), F.lit("\n")))

    both = edges.groupBy("tenant").agg(lines("source", "target").alias("by_source"), lines("target", "source").alias("by_target"))
    no = F.lit("")
    return tables.select("tenant").distinct().join(unshared(both), "tenant", "left").select(
        F.concat(F.lit("relationships/"), "tenant", F.lit("/relationships_summary.md")).alias("path"),
        F.concat(F.lit(RELATIONS_HEAD + BY_SOURCE_HEAD), F.coalesce("by_source", no), F.lit(BY_TARGET_HEAD), F.coalesce("by_target", no)).alias("content"))


def schema_index_pages(tables: DataFrame, extracted_on: str) -> DataFrame:
    """(path, content): the front page of each tenant's schema. ``extracted_on`` is the day the catalog was read."""
    line = F.concat(F.lit("- "), _table_link("table_name", "tables"), F.lit("\n"))
    return tables.groupBy("tenant").agg(_page(["table_name"], line).alias("lines")).select(
        F.concat(F.lit("schema/"), "tenant", F.lit("/index.md")).alias("path"),
        F.concat(F.lit(INDEX_PAGE[0] + extracted_on + INDEX_PAGE[1]), "lines").alias("content"))
