"""Splitting of documents into chunks. A token is a run of characters between white space; whole texts are split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Parent, child and overlap sizes in tokens.
DEFAULT_SIZES = (4000, 800, 150)
MIGRATED_SIZES = (512, 300, 50)
FIXED_SIZES = (300, 20)


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _starts(length: Column, step: int) -> Column:
    """0, step, 2 * step, ... below the length; empty for an empty list."""
    return F.when(length > 0, F.sequence(F.lit(0), length - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))


def _windows(words: Column, size: int, overlap: int) -> Column:
    """Overlapping windows; none that would hold only what the one before it already holds."""
    length = F.size(words)
    starts = F.filter(_starts(length, size - overlap), lambda s: (s == 0) | (s + overlap < length))
    return F.transform(starts, lambda s: F.slice(words, s + 1, F.lit(size)))


def _check(size: int, overlap: int) -> None:
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the chunk")


def _numbered(df: DataFrame, keys: list[str], lists: Column, number: str, item: str) -> DataFrame:
    """Elements of a computed list with their numbers.

    The outer form is used because for the plain one Spark adds a filter on the list's size and computes the list twice.
    """
    return df.select(*keys, F.posexplode_outer(lists).alias(number, item)).filter(F.col(item).isNotNull())


def hierarchical_chunks(docs: DataFrame, parent: int = 4000, child: int = 800, overlap: int = 150, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Children inside consecutive parents. A list of parents is exploded, so a row carries one parent and never the whole text."""
    _check(child, overlap)
    words = docs.select(key, tokens(F.col(text)).alias("words"))
    cuts = F.transform(_starts(F.size("words"), parent), lambda s: F.slice("words", s + 1, F.lit(parent)))
    parents = _numbered(words, [key], cuts, "parent_no", "parent_words")
    children = _numbered(parents, [key, "parent_no"], _windows(F.col("parent_words"), child, overlap), "child_no", "chunk_words")
    return children.select(key, "parent_no", "child_no", F.size("chunk_words").alias("token_count"), F.array_join("chunk_words", " ").alias("chunk"))


def fixed_chunks(docs: DataFrame, size: int = 300, overlap: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    _check(size, overlap)
    words = docs.select(key, tokens(F.col(text)).alias("words"))
    chunks = _numbered(words, [key], _windows(F.col("words"), size, overlap), "chunk_no", "chunk_words")
    return chunks.select(key, "chunk_no", F.size("chunk_words").alias("token_count"), F.array_join("chunk_words", " ").alias("chunk"))


def marked_blocks(docs: DataFrame, marker: str, key: list[str], text: str = "content") -> DataFrame:
    """Texts between ``[MARKER]`` and ``[/MARKER]``, in order."""
    found = F.regexp_extract_all(F.col(text), F.lit(rf"(?s)\[{marker}(?:: \w+)?\](.*?)\[/{marker}(?:: \w+)?\]"), 1)
    return _numbered(docs, key, found, "block_no", "block")


def load_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents scanned, those that give at least one chunk, and those that give none."""
    has_chunk = F.coalesce(F.col(text), F.lit("")).rlike(r"\S")
    return docs.agg(
        F.count("*").alias("scanned"), F.count(F.when(has_chunk, 1)).alias("indexed"), F.count(F.when(~has_chunk, 1)).alias("failed"))
