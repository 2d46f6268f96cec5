"""Small column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_text(name: str, alias: str | None = None) -> Column:
    return F.col(name).cast("string").alias(alias or name)


def as_double(name: str, alias: str | None = None) -> Column:
    return F.col(name).cast("double").alias(alias or name)


def total(name: str, alias: str) -> Column:
    """Exact decimal sum, shown as a double."""
    return F.sum(name).cast("double").alias(alias)


def average(name: str, alias: str) -> Column:
    """Mean from the exact decimal sum."""
    return (F.sum(name).cast("double") / F.count(name)).alias(alias)


def quotient(numerator: Column, divisor: Column) -> Column:
    """Double quotient, null for a divisor of zero."""
    return numerator.cast("double") / F.nullif(divisor.cast("double"), F.lit(0.0))


def exact_sum(value: Column) -> Column:
    """Sum of doubles through ten decimal places, so that it does not depend on the order of rows."""
    return F.sum(value.cast("decimal(28,10)")).cast("double")


def mean_of(numerator: Column, divisor: Column, alias: str) -> Column:
    """Mean of a quotient; rows with divisor zero are left out."""
    value = quotient(numerator, divisor)
    return (exact_sum(value) / F.nullif(F.count(value), F.lit(0))).alias(alias)


def count_if(condition: Column, alias: str) -> Column:
    return F.count(F.when(condition, F.lit(1))).alias(alias)


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a timestamp without zone, whatever the zone of the session."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("SECOND", start, F.date_trunc("second", ts).cast("timestamp_ntz"))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """Share of a total in percent, zero when there is nothing to divide by."""
    return F.when(whole > 0, F.round(part * 100.0 / whole, digits)).otherwise(F.lit(0.0))


def percent_text(part: Column, whole: Column) -> Column:
    """Share as a text with one decimal, an exact half going to the even digit."""
    share = F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))
    return F.concat(F.format_number(share, 1), F.lit("%"))


def strip(column: Column) -> Column:
    """Trim all white space, newlines too; the built-in trim removes blanks only."""
    return F.regexp_replace(column, r"^\s+|\s+$", "")


def slug(column: Column) -> Column:
    return F.replace(F.lower(column), F.lit(" "), F.lit("_"))


def escape_pipe(column: Column) -> Column:
    return F.replace(column, F.lit("|"), F.lit("\\|"))


def keyword_score(text: Column, keywords: list[str]) -> Column:
    """Number of distinct keywords contained in the text as substrings, ignoring case."""
    lowered = F.lower(text)
    found = [F.when(lowered.contains(k), 1).otherwise(0) for k in dict.fromkeys(keywords)]
    score = found[0]
    for one in found[1:]:
        score = score + one
    return score
