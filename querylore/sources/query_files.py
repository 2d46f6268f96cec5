"""Readers for queries and documents kept in files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querylore.functions.columns import strip
from querylore.sources.folders import read_files


def read_query_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A JSON list of ``{name, query}``, or one object per line. Items without both keys are skipped."""
    items = spark.read.schema("name STRING, query STRING").json(path, multiLine=not lines)
    return items.filter("name IS NOT NULL AND query IS NOT NULL")


def read_query_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with the columns ``name`` and ``query``; anything else is an error before any row is read."""
    table = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    missing = {"name", "query"} - set(table.columns)
    if missing:
        raise ValueError(f"{path} lacks the columns {', '.join(sorted(missing))}")
    return table.select("name", "query")


def _text() -> Column:
    return F.decode("content", "UTF-8")


def read_query_text(spark: SparkSession, path: str) -> DataFrame:
    """Every file is one query, named by the file."""
    return read_files(spark, path).select(_last("name").alias("name"), _text().alias("query"))


def _last(name: str) -> Column:
    return F.substring_index(name, "/", -1)


def read_query_lines(spark: SparkSession, path: str) -> DataFrame:
    """One query per line; blank lines are dropped."""
    return spark.read.text(path, lineSep="\n").select(strip(F.col("value")).alias("query")).filter("query <> ''")


def read_markdown_folder(spark: SparkSession, path: str, ending: str = ".md") -> DataFrame:
    """Files of a folder with name and whole content, those whose name has the ending."""
    files = read_files(spark, path).filter(F.col("name").endswith(ending))
    return files.select(_last("name").alias("fname"), _text().alias("content"))


def under_prefixes(path: Column, prefixes: list[str]) -> Column:
    """Whether a path lies under one of the prefixes."""
    return reduce(lambda a, b: a | b, [path.startswith(p) for p in prefixes])
