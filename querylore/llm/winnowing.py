"""Document fingerprints by winnowing. DataFrame functions only.

A text is cut into tokens of at most ``TOKEN`` characters at white space. Letters of scripts without spaces are tokens of their own, and so is
each character of any other run of more than ``LONG_RUN``: there a cut counted from the start of the run would move with what comes before. Every ``K``
consecutive tokens are hashed; in every ``W`` consecutive hashes the least is selected, the rightmost of equals. Any two texts that share
``K + W - 1`` tokens in a row share a selected hash, and no match shorter than K tokens counts. Hash and position are packed into
one number whose order is hash first, then position downwards, so one minimum does both. A position has 24 bits: in a text of more than 16 million
tokens (some 100 MB) positions start again from 0, and of equal hashes that far apart the rightmost need not be taken.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querylore.llm.common import SPAN_BITS, following, stored

TOKEN, K, W = 6, 4, 8
LONG_RUN = 64
SPACELESS = "".join(rf"\p{{Is{script}}}" for script in "Han Hiragana Katakana Bopomofo Yi Thai Lao Khmer Myanmar Tibetan Javanese Balinese Tai_Le New_Tai_Lue Tai_Tham Tai_Viet".split())
SPACELESS_RANGE = r"\x{2EA}\x{2EB}\x{E00}-\x{10FFFF}"  # all such letters are in it
POSITION_BITS = 24
SHARED_EDGES = 1_000_000  # rows of two longs that may be broadcast


def _tokens(text: Column) -> Column:
    cut, single = F.lit(rf"(\S{{1,{TOKEN}}})"), F.lit(r"(\S)")
    runs = F.regexp_extract_all(text, F.lit(rf"([{SPACELESS}]|[^\s{SPACELESS}]+)"), F.lit(1))
    tokens = F.flatten(F.transform(runs, lambda r: F.regexp_extract_all(r, F.when(F.char_length(r) > LONG_RUN, single).otherwise(cut), F.lit(1))))
    # most texts have neither such letters nor such runs, and need one pattern only
    return F.when(text.rlike(rf"[{SPACELESS_RANGE}]|(?:^|\s)\S{{{LONG_RUN + 1}}}"), tokens).otherwise(F.regexp_extract_all(text, cut, F.lit(1)))


def _grams(tokens: Column) -> Column:
    """Packed hashes of all K-grams; fewer than K tokens are one gram; no tokens, none."""
    last = (1 << POSITION_BITS) - 1

    def packed(h: Column, at: Column) -> Column:
        return F.shiftleft(F.shiftrightunsigned(h, POSITION_BITS + 1), POSITION_BITS) + (F.lit(last) - F.pmod(at, F.lit(last + 1)))

    grams = F.transform(F.sequence(F.lit(0), F.size(tokens) - K), lambda i: packed(F.xxhash64(*[tokens[i + j] for j in range(K)]), i))
    whole = F.array(packed(F.xxhash64(F.array_join(tokens, " ")), F.lit(0)))
    return F.when(F.size(tokens) >= K, grams).when(F.size(tokens) > 0, whole).otherwise(F.array().cast("array<bigint>"))


def _selected(grams: Column) -> Column:
    windows = F.transform(F.sequence(F.lit(1), F.size(grams) - (W - 1)), lambda i: F.array_min(F.slice(grams, i, W)))
    few = F.array(F.array_min(grams))
    return F.when(F.size(grams) > W, F.array_distinct(windows)).when(F.size(grams) > 0, few).otherwise(F.array().cast("array<bigint>"))


def select_grams(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the selected, packed grams of a text column (null: empty text), in text order."""
    step = df.withColumn("_tokens", _tokens(F.coalesce(text, F.lit("")))).withColumn("_grams", _grams(F.col("_tokens")))
    return step.withColumn(out, _selected(F.col("_grams"))).drop("_tokens", "_grams")


def hashes(selected: Column) -> Column:
    """The distinct hashes of selected grams."""
    return F.array_distinct(F.transform(selected, lambda v: F.shiftright(v, POSITION_BITS)))


def fingerprint(selected: Column) -> Column:
    """position:hash of each selected gram, in text order, as one string; empty for a text without tokens."""
    last = (1 << POSITION_BITS) - 1
    return F.array_join(F.transform(selected, lambda v: F.concat(F.hex(F.lit(last) - v.bitwiseAND(F.lit(last))), F.lit(":"), F.lower(F.hex(F.shiftright(v, POSITION_BITS))))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two hash sets, 0 to 1. Two empty sets are alike."""
    both, one = F.size(F.array_intersect(a, b)), F.size(a) + F.size(b)
    return F.when(one == 0, F.lit(1.0)).otherwise(both / (one - both)).cast("double")


def with_next(docs: DataFrame, text: str, carried: list[str], prepared: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Adds next_<column> for the row with the next larger doc_id; the last is followed by the first.

    Rows are dealt by spans of 256 ids and read in order inside a span; the first row of the next span that has any visits the span
    before it. Of rows with one doc_id the order is that of the text. Rows without a doc_id have no next row (null). ``prepared`` adds what
    costs much to the dealt rows, so that it is computed once for each row and visitor and never shuffled.
    """
    columns = docs.columns
    ids = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"))
    nexts = following(ids)
    least = ids.agg(F.min("id")).first()[0]
    nexts = nexts.select("id", F.coalesce("next_id", F.lit(least).cast("long")).alias("next_id"))
    span, wrap = F.shiftright("id", SPAN_BITS), F.col("next_id") <= F.col("id")
    edges = nexts.filter((span != F.shiftright("next_id", SPAN_BITS)) | wrap).select(span.alias("_span"), wrap.alias("_wrap"), F.col("next_id").alias("doc_id"))
    edges = stored(edges, "edges")
    edges = F.broadcast(edges) if edges.count() <= SHARED_EDGES else edges
    own = docs.withColumn("_span", F.coalesce(F.shiftright(F.col("doc_id").cast("long"), SPAN_BITS), -1 - F.pmod(F.xxhash64(text), F.lit(1 << 20)))).withColumn("_guest", F.lit(0))
    guests = docs.join(edges, "doc_id").withColumn("_guest", F.when(F.col("_wrap"), 2).otherwise(1)).select(*columns, "_span", "_guest")
    order = Window.partitionBy("_span").orderBy("_guest", "doc_id", text)
    rows = prepared(own.unionByName(guests).repartition("_span"))
    for c in carried:
        rows = rows.withColumn(f"next_{c}", F.when(F.col("doc_id").isNotNull(), F.lead(c).over(order)))
    return rows.filter("_guest = 0").drop("_span", "_guest")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next) for each row of ``docs`` (doc_id, text, ...).

    The edited text has the last floor(n_chars / 4) characters replaced by the first as many (or all) of the next document. A null
    text counts as empty; an empty or blank text has an empty fingerprint. Rows without a doc_id have no next document: what they
    lose is replaced by nothing and near_next compares with an empty fingerprint. Rows that repeat a doc_id follow each other in
    the order of their texts. Equal texts have equal fingerprints. Other columns are ignored. An empty table gives an empty table.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(texts, "text", ["text", "picked"], lambda dealt: select_grams(dealt, "text", "picked"))
    n, edited_n = F.char_length("text"), F.floor(F.char_length("text") / 4).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - edited_n), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), edited_n)))
    rows = select_grams(rows, "edited", "edited_picked")
    nothing = F.array().cast("array<bigint>")
    rows = rows.withColumn("_own", hashes(F.col("picked"))).withColumn("_edited", hashes(F.col("edited_picked"))).withColumn("_next", hashes(F.coalesce("next_picked", nothing)))
    return rows.select(
        "doc_id", "n_chars", "edited", fingerprint(F.col("picked")).alias("fingerprint"), fingerprint(F.col("edited_picked")).alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("_edited")).alias("near_edited"), likeness(F.col("_own"), F.col("_next")).alias("near_next"),
    )
