"""Features of SQL texts as column expressions. A text is read by patterns, not parsed: nested statements count as one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from querylore.functions.columns import strip

# Patterns.
EMBEDDED = r"(?s)## Embedding-Ready Query\s*```sql\s*(.*?)\s*```"
FILE_DATABASE = r"^(epic\w+)_query_"
FROM_TABLE = r"(?i)FROM\s+(\w+)"
JOIN_TABLE = r"(?i)JOIN\s+(\w+)"
ANY_TABLE = r"(?i)\b(?:FROM|JOIN|INTO|UPDATE)\s+(\w+)"
JOIN = r"(?i)\b((?:(?:LEFT|RIGHT|FULL|INNER|CROSS)\s+(?:OUTER\s+)?)?JOIN\s+\w+)"
CONDITION = r"(?i)\b(?:WHERE|AND|OR|ON)\s+((?:\w+\.)?\w+\s*(?:>=|<=|<>|!=|=|>|<|\bIN\b|\bLIKE\b|\bBETWEEN\b|\bIS\b))"
OPERATOR = r"(?i)(>=|<=|<>|!=|=|>|<|IN|LIKE|BETWEEN|IS)$"
ALIAS = r"(?i)\b(?:FROM|JOIN)\s+(\w+\s+(?:AS\s+)?\w+)"
VERBS = ["SELECT", "INSERT", "UPDATE", "DELETE", "REPLACE", "MERGE", "CREATE", "ALTER", "DROP"]


def embedded_query(content: Column) -> Column:
    """SQL block under its heading, trimmed; null when there is none or it is empty."""
    return F.nullif(F.regexp_extract(content, EMBEDDED, 1), F.lit(""))


def database_of_file(name: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(name, FILE_DATABASE, 1), F.lit("")), F.lit("unknown"))


def query_hash(sql: Column) -> Column:
    """Hash of the trimmed, lower-cased, space-collapsed text; null for an empty text."""
    text = strip(F.regexp_replace(F.lower(sql), r"\s+", " "))
    return F.when(text != "", F.md5(text))


def main_table(sql: Column) -> Column:
    return F.nullif(F.regexp_extract(sql, FROM_TABLE, 1), F.lit(""))


def _all(sql: Column, pattern: str) -> Column:
    return F.regexp_extract_all(sql, F.lit(pattern), 1)


def from_and_join_tables(sql: Column) -> Column:
    """The first FROM table, then every JOIN table, each once. Later FROMs are not seen."""
    first = F.array_compact(F.array(main_table(sql)))
    return F.array_distinct(F.concat(first, _all(sql, JOIN_TABLE)))


def table_mentions(sql: Column) -> Column:
    """Every FROM and JOIN table with repeats."""
    return _all(sql, r"(?i)(?:FROM|JOIN)\s+(\w+)")


def without_comments(sql: Column) -> Column:
    """Comments and the insides of quoted texts taken out, so that words in them are not read as SQL."""
    no_block = F.regexp_replace(sql, r"(?s)/\*.*?\*/", " ")
    return F.regexp_replace(F.regexp_replace(no_block, r"--[^\n]*", " "), r"'[^']*'", "''")


def statement_type(clean: Column) -> Column:
    """First keyword; a WITH statement shows the verb behind its last closing bracket."""
    first = F.upper(F.regexp_extract(clean, r"^\s*(\w+)", 1))
    behind_with = F.upper(F.regexp_extract(clean, r"(?is)^\s*WITH\b.*\)\s*(SELECT|INSERT|UPDATE|DELETE)\b", 1))
    verb = F.when(first == "WITH", behind_with).otherwise(first)
    return F.when(verb.isin(VERBS), verb).otherwise("UNKNOWN")


def all_tables(clean: Column) -> Column:
    return F.array_distinct(_all(clean, ANY_TABLE))


def joins(clean: Column) -> Column:
    """Distinct (type, kind, table) entries."""
    def entry(text):
        kind = F.upper(F.regexp_extract(text, r"(?i)^(LEFT|RIGHT|FULL|INNER|CROSS)", 1))
        return F.struct(F.lit("JOIN").alias("type"), kind.alias("kind"), F.regexp_extract(text, r"(\w+)$", 1).alias("table"))
    return F.array_distinct(F.transform(_all(clean, JOIN), entry))


def qualified_columns(clean: Column) -> Column:
    return F.array_distinct(_all(clean, r"\w+\.(\w+)"))


def conditions(clean: Column) -> Column:
    """Distinct (column, operator) entries; ``?`` when no operator is seen."""
    def entry(text):
        operator = F.upper(F.regexp_extract(text, OPERATOR, 1))
        return F.struct(F.regexp_extract(text, r"^(?:\w+\.)?(\w+)", 1).alias("column"),
                        F.when(operator == "", "?").otherwise(operator).alias("operator"))
    return F.array_distinct(F.transform(_all(clean, CONDITION), entry))


def condition_columns(clean: Column) -> Column:
    """Distinct (table, column) pairs of the conditions; an alias is resolved, a bare name belongs to the first table."""
    aliases = F.transform(_all(clean, ALIAS), lambda a: F.struct(
        F.regexp_extract(a, r"^(\w+)", 1).alias("table"), F.regexp_extract(a, r"(\w+)$", 1).alias("alias")))

    def entry(text):
        qualifier = F.regexp_extract(text, r"^(\w+)\.", 1)
        table = F.coalesce(F.get(F.filter(aliases, lambda a: a["alias"] == qualifier), F.lit(0))["table"], F.nullif(qualifier, F.lit("")), main_table(clean))
        return F.struct(table.alias("table"), F.regexp_extract(text, r"^(?:\w+\.)?(\w+)", 1).alias("column"))
    return F.array_distinct(F.transform(_all(clean, CONDITION), entry))


def complexity_score(kind: Column, tables: Column, join_list: Column, condition_list: Column, sql: Column) -> Column:
    length = F.char_length(sql)
    return (
        F.when(kind == "SELECT", 1.0).when(kind.isin("INSERT", "UPDATE", "DELETE"), 2.0).otherwise(0.0)
        + F.size(tables) * 0.5 + F.size(join_list) * 1.5 + F.size(condition_list) * 0.5
        + F.when(length > 1000, 2.0).when(length > 500, 1.0).otherwise(0.0)
    )


def complexity_level(score: Column) -> Column:
    return F.when(score > 8, "High").when(score > 4, "Medium").otherwise("Low")
