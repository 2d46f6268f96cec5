"""The corpus pipeline: documents pass through these stages in this order, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querylore.llm import bpe, decontaminate, language_id, ngram_join, substring_dedup
from querylore.llm.common import free_name, stored, text_batches
from querylore.llm.queries import vocabulary


def _clear_of(docs: DataFrame, names: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """The frame with its own columns of these names out of an operator's way, and how to name them back."""
    moved = {c: free_name(docs, f"kept_{c}") for c in docs.columns if c in names}
    return docs.withColumnsRenamed(moved), {new: old for old, new in moved.items()}


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised stay: those without letters (null and blank texts too), or with a score below the calibrated bound, go.

    Rows without a doc_id or lang are judged by their text like others, repeated rows alike, very long texts whole. Nothing is learned from an
    empty table, which stays empty. Other columns stay, whatever their names.
    """
    text_batches(spark)
    own, back = _clear_of(docs, ["held_out", "lang_pred", "score", "accepted"])
    kept = language_id.identify(own).filter("accepted").drop("held_out", "lang_pred", "score", "accepted")
    return kept.withColumnsRenamed(back).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest doc_id.

    Rows without a doc_id stay, and of rows that repeat the kept doc_id all do; null and blank texts are near nothing and stay. An empty table stays
    empty; all columns stay.
    """
    text_batches(spark)
    return ngram_join.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that repeat 50 words or more of an earlier document go; a document that loses none keeps its text as it is.

    Rows without a doc_id, and null, blank or short texts, lose nothing; rows that share a doc_id are not earlier than each other. n_chars, where there
    is one, follows the text. An empty table stays empty; all columns stay.
    """
    text_batches(spark)
    own, back = _clear_of(docs, ["kept_text", "n_words", "n_removed"])
    cut = substring_dedup.remove_repeated_windows(own).withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return cut.drop("kept_text", "n_words", "n_removed").withColumnsRenamed(back).select(*docs.columns)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain an item of the benchmark go.

    Null and blank texts contain nothing; rows without a doc_id stay only if none of them contains an item; repeated rows go or stay together. With no
    items, or an empty table, nothing goes. All columns stay.
    """
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, decoded) of each document.

    A null, empty or blank text has no ids and decodes to an empty text. Rows without a doc_id and repeated rows keep a row each. A lang or source column that
    the documents lack is null. An empty table gives an empty table; other columns are left out.
    """
    text_batches(spark)
    named = docs.select("doc_id", *[c if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("lang", "source")], "text")
    coded = bpe.round_trip(named, vocabulary("word_bpe_49k.json"))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("language_id", known_language),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("benchmark_decontamination", without_benchmarks),
    ("bpe_encoding", encoded),
]

# a learned model and sub-word ids have no SQL form; tests/llm compares the whole pipeline with a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
