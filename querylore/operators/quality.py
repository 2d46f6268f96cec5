"""Quality of answers: share of SQL, truncation, whether the expected source was found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querylore.functions.columns import strip

# Words that mark a line as SQL: long list, short list, and the list that only looks at the whole answer.
SQL_WORDS = ["select", "from", "where", "join", "create", "table", "insert", "update", "delete"]
SQL_WORDS_SHORT = ["select", "from", "where", "join", "create", "table"]
SQL_WORDS_PROBE = ["select", "from", "where", "join", "create table"]
SQL_FOCUSED = 0.3


def _has_word(line: Column, words: list[str]) -> Column:
    found = F.lower(line).contains(words[0])
    for word in words[1:]:
        found = found | F.lower(line).contains(word)
    return found


def sql_share(answers: DataFrame, words: list[str] = SQL_WORDS, text: str = "text") -> DataFrame:
    """Lines holding an SQL word as a share of all lines, and whether the answer is mostly SQL."""
    lines = F.split(strip(F.col(text)), "\n")
    share = F.size(F.filter(lines, lambda line: _has_word(line, words))) / F.size(lines)
    return answers.withColumns({"has_sql": _has_word(F.col(text), words), "sql_share": share, "sql_focused": share > SQL_FOCUSED})


def contains_sql(answers: DataFrame, text: str = "text") -> DataFrame:
    return answers.withColumn("has_sql", _has_word(F.col(text), SQL_WORDS_PROBE))


def truncation_flags(answers: DataFrame, text: str = "text") -> DataFrame:
    return answers.withColumns({"ends_with_dots": F.col(text).endswith("..."), "short": F.char_length(text) < 100})


def secondary_flags(answers: DataFrame, text: str = "answer") -> DataFrame:
    """Whether the parts of a merged answer are there and were cut."""
    body = F.col(text)
    section = body.contains("**Related Information:**")
    return answers.withColumns({"has_section": section, "section_truncated": section & body.contains("...") & body.contains("From")})


def hit_report(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Hit rate and mean reciprocal rank per group.

    ``found`` has query_id, rank, relevant; ``expected`` has query_id and group. Questions without a hit count as zero.
    """
    first = found.filter("relevant").groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    joined = expected.join(first, "query_id", "left")
    return joined.groupBy("group").agg(
        F.count("*").alias("questions"), F.count("first_rank").alias("hits"),
        F.round(F.count("first_rank") / F.count("*"), 6).alias("hit_rate"),
        F.round(F.sum(F.coalesce(F.lit(1.0) / F.col("first_rank"), F.lit(0.0))) / F.count("*"), 6).alias("mean_reciprocal_rank"))
