"""Benchmark items inside documents, by size-partitioned MinHash containment search. DataFrame functions only.

An item of n shingles is contained when at least ceil(threshold * n) of them are in the document. So a document that contains it
holds at least one of any n - ceil(threshold * n) + 1 of its shingles; the item's signature is that many least hashes (a bottom-k
MinHash). Items are partitioned by size, and a document is searched only for partitions whose least item still fits: it must have
threshold * (lower size bound) shingles. Unlike a fixed number of hash bands this misses nothing, however long the document is.
Candidates are then verified by exact shingle containment. An item with fewer words than a shingle is searched as the run of all its words.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querylore.llm.common import free_name, stored, word_array

SHINGLE = 5
THRESHOLD = 0.8
CLASS_RATIO = 1.5
SHARED_ROWS = 2_000_000  # rows of a few longs that may be broadcast; beyond, Spark joins by shuffle


def _runs(words: Column, size: int) -> Column:
    """The hashes of all runs of ``size`` words; none for fewer words."""
    runs = F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.xxhash64(*[words[i + j] for j in range(size)]))
    return F.when(F.size(words) >= size, runs).otherwise(F.array().cast("array<bigint>"))


def _words(df: DataFrame) -> DataFrame:
    """Replaces text by ``words``, a column of its own, so that the text is split once and not for every run."""
    return df.withColumn("words", word_array(F.lower("text"))).drop("text")


def _with_shingles(df: DataFrame, size: int) -> DataFrame:
    """Replaces text by ``s``, the hashes of all runs of ``size`` words."""
    return _words(df).withColumn("s", _runs(F.col("words"), size)).drop("words")


def _short_items(texts: DataFrame, items: DataFrame, size: int) -> list[DataFrame]:
    """The result rows of items with fewer than ``size`` words, a frame for each number of words that occurs."""
    few = stored(_words(items).withColumn("n", F.size("words")).filter((F.col("n") > 0) & (F.col("n") < size)), "short-items")
    found = []
    for n in sorted(r["n"] for r in few.select("n").distinct().collect()):  # fewer than ``size`` numbers
        wanted = stored(few.filter(F.col("n") == n).select("item_id", F.element_at(_runs(F.col("words"), n), 1).alias("h")).distinct(), "short-runs")
        runs = _with_shingles(texts, n).select("doc_id", F.explode_outer("s").alias("h"))
        one = F.lit(1).cast("long")
        found.append(runs.join(_shared(wanted), "h").select("doc_id", "item_id").distinct().select("*", one.alias("item_shingles"), one.alias("shared_shingles"), F.lit(1.0).alias("containment")))
    return found


def _shared(df: DataFrame) -> DataFrame:
    """A broadcast hint for a stored table whose counted rows are within the bound."""
    return F.broadcast(df) if df.count() <= SHARED_ROWS else df


def contained_items(docs: DataFrame, items: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, item_shingles, shared_shingles, containment) for each contained item of each document.

    docs (doc_id, text, ...), items (item_id, text, ...). Words are lower-cased and parted at white space. Shingles count once. An item
    with fewer than ``size`` words is one shingle, the run of all its words, and is found in every document that has this run. Null
    or blank texts contain nothing and are contained in nothing. Rows without an id are searched for and through, and come out under a null id;
    rows that repeat an id count as one. Other columns are ignored. Empty tables give an empty table.
    """
    wanted = _with_shingles(items.select(F.col("item_id").cast("long").alias("item_id"), "text"), size).withColumn("s", F.array_distinct("s"))
    wanted = wanted.withColumn("n", F.size("s")).withColumn("need", F.ceil(F.col("n") * F.lit(threshold) - 1e-9).cast("int"))
    wanted = wanted.withColumn("size_class", F.floor(F.log(F.col("n") + 0.5) / math.log(CLASS_RATIO)).cast("int"))
    wanted = wanted.withColumn("least_doc", F.ceil(F.lit(threshold) * F.greatest(F.lit(1.0), F.ceil(F.pow(F.lit(CLASS_RATIO), F.col("size_class")) - 0.5)) - 1e-9).cast("int"))
    # conditions on a computed list would be moved below it and compute it again for every word: so they come after this table,
    # and documents' lists are exploded in the outer form, which adds no condition
    wanted = stored(wanted, "items").filter("n > 0")
    signature = stored(wanted.select("item_id", "least_doc", F.explode(F.slice(F.array_sort("s"), F.lit(1), F.col("n") - F.col("need") + 1)).alias("h")).distinct(), "signatures")

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    short = _short_items(texts, items.select(F.col("item_id").cast("long").alias("item_id"), "text"), size)
    rows = _with_shingles(texts, size).select("doc_id", F.size("s").alias("m"), F.explode_outer("s").alias("h"))
    hits = rows.join(_shared(signature), "h").filter("m >= least_doc").select("doc_id", "item_id").distinct()
    candidates = stored(hits, "candidates")

    only = _shared(stored(candidates.select(F.col("doc_id").alias("_doc")).distinct(), "candidate-ids"))
    again = texts.join(only, F.col("doc_id").eqNullSafe(F.col("_doc")), "left_semi")
    again = _with_shingles(again, size).select("doc_id", F.explode_outer("s").alias("h"))
    parts = candidates.join(wanted.select(F.col("item_id").alias("_item"), "n", "need", "s"), F.col("item_id").eqNullSafe(F.col("_item"))).select("doc_id", "item_id", "n", "need", F.explode("s").alias("h"))
    own = parts.select(F.col("doc_id").alias("_doc"), F.col("h").alias("_h"), "item_id", "n", "need")
    found = again.join(own, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("h") == F.col("_h"))).select("doc_id", "item_id", "n", "need", "h").distinct()
    counted = found.groupBy("doc_id", "item_id", "n", "need").agg(F.count("*").alias("k")).filter("k >= need")
    long_ = counted.select("doc_id", "item_id", F.col("n").cast("long").alias("item_shingles"), F.col("k").alias("shared_shingles"), (F.col("k") / F.col("n")).alias("containment"))
    return reduce(DataFrame.unionByName, short, long_)


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that contain no item, all columns kept. Rows without a doc_id stay only if no such row contains an item."""
    leak = free_name(docs, "leak")
    leaks = contained_items(docs.select("doc_id", "text"), items).select(F.col("doc_id").alias(leak)).distinct()
    return docs.join(leaks, F.col("doc_id").eqNullSafe(F.col(leak)), "left_anti")
