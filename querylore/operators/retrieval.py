"""Exact retrieval over chunks for many questions at once.

Questions carry their vectors (``embedding``) and, for keyword search, their terms. The question side is the small one:
it is shared with all tasks when its measured size is below a bound, and dealt into a grid of question blocks and chunk
blocks beyond it. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querylore.functions import blocks, sqltext
from querylore.functions.columns import epoch_seconds
from querylore.functions.text import non_blank_lines
from querylore.operators.relational import last_per_group, unshared
from querylore.session import scratch_dir

SHARED_BYTES = 64 << 20
QUESTION_BLOCK = 2_000
CHUNK_BLOCK = 20_000
# vectors are compared so fast that larger blocks pay: each is sent as often as the other side has blocks
VECTOR_QUESTIONS = 50_000
VECTOR_CHUNKS = 100_000

# Texts asked about a table and about a statement, and the parts of a context text.
RELATIONSHIP_TEXTS = [
    "relationships of {} table", "{} foreign keys", "tables that reference {}", "{} primary key", "{} table schema relationships",
]
STATEMENT_TABLE_TEXTS = ["{} schema columns indexes", "{} table structure", "{} primary key and indexes"]
STATEMENT_TEXT = "SQL query optimization for: {}..."
SEPARATOR = "\n\n---\n\n"
CORRECTIONS_HEADING = "\n\n--- USER CORRECTIONS ---\n\n"
NOTHING_FOUND = (
    "I couldn't find relevant information in the database knowledge base for your query: '{}'. "
    "Please try rephrasing your question or check if the topic is covered in the documentation."
)


# --- the two ways to bring questions and chunks together -------------------------------------------------------------

def _bytes(df: DataFrame) -> Column:
    """Estimated bytes of a row: eight per list element, a text's own bytes, sixteen per other value."""
    total = F.lit(0)
    for field in df.schema:
        kind, value = field.dataType.typeName(), F.col(field.name)
        total = total + (F.coalesce(F.size(value), F.lit(0)) * 8 if kind == "array" else F.coalesce(F.octet_length(value), F.lit(0)) + 16 if kind == "string" else F.lit(16))
    return total


def _once(df: DataFrame, purpose: str) -> DataFrame:
    """A table of the question side, written to the shared folder, so that measuring, sharing and joining it does not compute it again."""
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def blockwise(questions: DataFrame, chunks: DataFrame, keys: list[str], kernel: Callable, schema: str, shared_bytes: int = SHARED_BYTES,
              question_block: int | None = None, chunk_block: int | None = None) -> DataFrame:
    """Run a kernel (questions, chunk batches) -> batches over all questions and all chunks."""
    measured = questions.agg(F.count("*").alias("n"), F.coalesce(F.sum(_bytes(questions)), F.lit(0)).alias("bytes")).first()
    if measured["n"] == 0:
        return chunks.sparkSession.createDataFrame([], schema)
    if measured["bytes"] <= shared_bytes:
        shared = chunks.sparkSession.sparkContext.broadcast(questions.toArrow())
        return chunks.mapInArrow(lambda batches: kernel(shared.value, batches), schema)

    question_blocks = -(-measured["n"] // (question_block or QUESTION_BLOCK))
    chunk_blocks = max(1, -(-chunks.count() // (chunk_block or CHUNK_BLOCK)))

    def block(df, columns, n):
        return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")

    def every(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    asked = questions.withColumn("_q", block(questions, keys, question_blocks)).withColumn("_c", every(chunk_blocks))
    have = chunks.withColumn("_c", block(chunks, ["chunk_id"], chunk_blocks)).withColumn("_q", every(question_blocks))

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return empty
        right = right.combine_chunks()
        found = list(kernel(left, iter(right.to_batches())))
        return pa.Table.from_batches(found) if found else empty

    empty = chunks.sparkSession.createDataFrame([], schema).toArrow()
    return asked.groupBy("_q", "_c").cogroup(have.groupBy("_q", "_c")).applyInArrow(both, schema)


def _schema(questions: DataFrame, keys: list[str], carry: str | None) -> str:
    types = dict(questions.dtypes)
    return ", ".join([*(f"{k} {types[k]}" for k in keys), "chunk_id bigint", "score double", *([f"{carry} string"] if carry else [])])


# --- searches -------------------------------------------------------------------------------------------------------

def with_hash(chunks: DataFrame) -> DataFrame:
    """Chunks with the hash of their content, so that texts need not travel with the scores."""
    return chunks.withColumn("content_hash", F.md5("content"))


def top_k(questions: DataFrame, chunks: DataFrame, k: int = 5, keys: tuple[str, ...] = ("query_id",), by: str | None = None,
          carry: str | None = None, shared_bytes: int = SHARED_BYTES) -> DataFrame:
    """The k chunks of highest dot product per question; ties go to the smaller id. With ``by``, only chunks of the
    question's own group take part. Returns keys, chunk_id, score, rank.

    Equal vectors have equal scores, so each distinct vector of the questions is compared once with each distinct vector of the chunks. Of chunks with
    one vector the k smallest ids can be among the best, and the best chunks are among those of the k best vectors.
    """
    keys, only = list(keys), [by] if by else []
    asked = questions.filter("embedding IS NOT NULL").select(*dict.fromkeys([*keys, *only]), "embedding")
    have = chunks.filter("embedding IS NOT NULL").select("chunk_id", "embedding", *only, *([carry] if carry else []))
    kernel = partial(blocks.vector_top_k, k=k, by=by)
    return _each_distinct(asked, have, ["embedding", *only], kernel, k, keys, carry, shared_bytes, VECTOR_QUESTIONS, VECTOR_CHUNKS)


def _each_distinct(asked: DataFrame, have: DataFrame, same: list[str], kernel: Callable, k: int, keys: list[str], carry: str | None, shared_bytes: int,
                   question_block: int | None = None, chunk_block: int | None = None) -> DataFrame:
    """The k best chunks per question where the score depends on the columns ``same`` alone: one question and one chunk of each value are compared, the k
    smallest ids of the chunks of a value stand for them, and every question gets what its value found."""
    kinds = _once(asked.select(*same).distinct().withColumn("asked_no", F.monotonically_increasing_id()), "question-kinds")
    first = last_per_group(have, same, [F.col("chunk_id")], k)
    listed = F.array_sort(F.collect_list(F.struct("chunk_id", *([carry] if carry else [])))).alias("copies")
    grouped = first.groupBy(*same).agg(listed).withColumn("copy_no", F.monotonically_increasing_id().cast("string"))
    copies = _once(grouped.withColumn("chunk_id", F.col("copies")[0]["chunk_id"]), "chunk-kinds")

    kernel = partial(kernel, keys=["asked_no"], carry="copy_no")
    found = blockwise(kinds, copies.drop("copies"), ["asked_no"], kernel, _schema(kinds, ["asked_no"], "copy_no"), shared_bytes, question_block, chunk_block)
    near = last_per_group(found, ["asked_no"], [F.desc("score"), F.col("chunk_id")], k).select("asked_no", "copy_no", "score")
    spelt = near.join(unshared(copies.select("copy_no", "copies")), "copy_no").select("asked_no", "score", F.inline("copies"))
    best = last_per_group(spelt, ["asked_no"], [F.desc("score"), F.col("chunk_id")], k).drop("position")
    lists = best.groupBy("asked_no").agg(F.collect_list(F.struct("chunk_id", "score", *([carry] if carry else []))).alias("found"))
    answers = kinds.join(unshared(lists), "asked_no").select(*[F.col(c).alias(f"_{c}") for c in same], "found")
    pairs = asked.join(unshared(answers), reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in same]))
    # dealt by question alone: whatever follows per question, variant or content needs no further shuffle
    each = pairs.select(*keys, F.inline("found")).repartition(keys[0])
    return last_per_group(each, keys, [F.desc("score"), F.col("chunk_id")], k, rank="rank")


def terms(text: Column) -> Column:
    """Distinct lower-case words of a text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), 0))


def term_numbers(text: Column) -> Column:
    """The distinct words as 64-bit numbers: compact to move and fast to look up."""
    return F.transform(terms(text), lambda w: F.xxhash64(w))


def keyword_top_k(questions: DataFrame, chunks: DataFrame, k: int, keys: tuple[str, ...] = ("query_id",), text: str = "query_text",
                  carry: str | None = None, shared_bytes: int = SHARED_BYTES) -> DataFrame:
    """The k chunks holding the largest share of a question's distinct words.

    Only words of some question count, so chunks that hold the same of these have equal scores and are compared as one; so are questions of the same
    words. The words of all questions are shared with the tasks up to ``shared_bytes``; beyond that chunks are told apart by all their words.
    """
    keys = list(keys)
    asked = _once(questions.select(*keys, F.array_sort(term_numbers(F.col(text))).alias("terms")), "question-terms")
    have = chunks.select("chunk_id", term_numbers(F.col("content")).alias("terms"), *([carry] if carry else []))
    words = _once(asked.select(F.explode("terms").alias("word")).distinct(), "question-words")
    if words.count() * 8 <= shared_bytes:
        shared = chunks.sparkSession.sparkContext.broadcast(words.toArrow())
        have = have.mapInArrow(lambda batches: blocks.asked_terms(shared.value, batches), have.schema)
    else:
        have = have.withColumn("terms", F.array_sort("terms"))
    return _each_distinct(asked, have, ["terms"], partial(blocks.keyword_top_k, k=k), k, keys, carry, shared_bytes)


def hybrid_top_k(questions: DataFrame, chunks: DataFrame, k: int = 5, w_vector: float = 0.7, w_keyword: float = 0.3,
                 shared_bytes: int = SHARED_BYTES) -> DataFrame:
    """Weighted vector and keyword score, each scaled to 0..1 over all chunks per question.

    The first pass finds the ranges, the second the best chunks; neither builds question-chunk pairs.
    """
    keys = ["query_id"]
    asked = questions.filter("embedding IS NOT NULL").select("query_id", "embedding", term_numbers(F.col("query_text")).alias("terms"))
    have = chunks.filter("embedding IS NOT NULL").select("chunk_id", "embedding", term_numbers(F.col("content")).alias("terms"))
    names = ["vector_low", "vector_high", "keyword_low", "keyword_high"]
    range_schema = f"query_id {dict(asked.dtypes)['query_id']}, " + ", ".join(f"{n} double" for n in names)
    seen = blockwise(asked, have, keys, partial(blocks.score_ranges, keys=keys), range_schema, shared_bytes)
    ranges = _once(seen.groupBy("query_id").agg(*[(F.min if n.endswith("low") else F.max)(n).alias(n) for n in names]), "score-ranges")
    kernel = partial(blocks.hybrid_top_k, keys=keys, k=k, w_vector=w_vector, w_keyword=w_keyword, carry=None)
    best = blockwise(asked.join(ranges, "query_id"), have, keys, kernel, _schema(asked, keys, None), shared_bytes)
    return last_per_group(best, keys, [F.desc("score"), F.col("chunk_id")], k, rank="rank")


def place(rank: Column, variant_no: Column | None = None, strategy_no: Column | None = None) -> Column:
    """One number in the order of strategy, variant, rank: each takes bits of its own, so no two places are equal."""
    at = rank.cast("bigint")
    for number, bits in ((variant_no, 32), (strategy_no, 52)):
        at = at if number is None else F.shiftleft(number.cast("bigint"), bits) + at
    return at


# --- merging --------------------------------------------------------------------------------------------------------

def dedup_contexts(found: DataFrame, group: list[str], keep: list[str]) -> DataFrame:
    """One row per content: the one of highest score, of equal scores the first seen; it keeps the place where the
    content was seen first. ``found`` has content_hash, score and position. Partial aggregation keeps one row per
    content and task, so copies of one text do not pile up."""
    best = F.max_by(F.struct("score", *keep), F.struct(F.col("score"), -F.col("position")))
    return (
        found.groupBy(*group, "content_hash")
        .agg(best.alias("best_row"), F.min("position").alias("first_position"))
        .select(*group, "content_hash", "best_row.*", "first_position")
    )


def best_contexts(found: DataFrame, group: list[str], keep: list[str], n: int) -> DataFrame:
    """Deduplicate, sort by score with first seen first, cut to n."""
    return last_per_group(dedup_contexts(found, group, keep), group, [F.desc("score"), F.col("first_position")], n, rank="rank")


def search_variants(variants: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Every variant of every strategy in one pass over the chunks."""
    return top_k(variants, with_hash(chunks), k, ("query_id", "strategy", "strategy_no", "variant_no"), carry="content_hash")


def expansion(found: DataFrame, k: int) -> DataFrame:
    """Merge the variants of the expansion strategy; ``from_variant`` tells which one brought a context."""
    own = found.withColumn("position", place(F.col("rank"), F.col("variant_no"))).withColumn("from_variant", F.col("variant_no"))
    return best_contexts(own, ["query_id"], ["chunk_id", "from_variant"], k)


def _has_hyde() -> Column:
    return F.max(F.col("strategy") == "hyde").over(Window.partitionBy("query_id"))


def with_hyde_fallback(found: DataFrame) -> DataFrame:
    """Results of the hypothetical-document strategy; a question without such a document uses its own vector.
    ``found`` holds the standard and the hypothetical-document results."""
    return found.withColumn("has_hyde", _has_hyde()).filter((F.col("strategy") == "hyde") | ~F.col("has_hyde")).drop("has_hyde")


def all_contexts(found: DataFrame, per: int) -> DataFrame:
    """What the three strategies bring, each content once per strategy, with its place in the joint list.

    ``found`` is read once, and stays dealt by question through all steps: copies are merged per strategy, the
    expansion is cut to its share, and standard results stand in where the hypothetical document is missing.
    """
    placed = found.withColumn("position", place(F.col("rank"), F.col("variant_no")))
    group = ["query_id", "strategy", "strategy_no"]
    best = F.max_by(F.struct("score", "chunk_id"), F.struct(F.col("score"), -F.col("position")))
    merged = placed.groupBy(*group, "content_hash").agg(best.alias("best_row"), F.min("position").alias("position"), F.count("*").alias("copies"))
    merged = merged.select(*group, "content_hash", "best_row.*", "position", "copies")
    is_expansion = F.col("strategy") == "expansion"
    standing = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("score"), "position"))
    cut = merged.withColumn("place", standing).filter(~is_expansion | (F.col("place") <= per)).withColumns({
        "position": F.when(is_expansion, F.col("place")).otherwise(F.col("position")),
        "copies": F.when(is_expansion, F.lit(1)).otherwise(F.col("copies"))})

    def entry(name, number):
        return F.struct(name.alias("strategy"), number.alias("strategy_no"))
    own, stand_in = entry(F.col("strategy"), F.col("strategy_no")), entry(F.lit("hyde"), F.lit(2))
    entries = F.when((F.col("strategy") == "standard") & ~F.col("has_hyde"), F.array(own, stand_in)).otherwise(F.array(own))
    listed = cut.withColumn("has_hyde", _has_hyde()).select("query_id", "content_hash", "score", "chunk_id", "position", "copies", F.inline(entries))
    return listed.withColumn("position", place(F.col("position"), strategy_no=F.col("strategy_no")))


def per_strategy(n: int) -> int:
    return max(2, n // 3)


def multi_strategy(variants: DataFrame, chunks: DataFrame, n: int = 8) -> DataFrame:
    """Standard, expansion and hypothetical-document search merged by best score."""
    per = per_strategy(n)
    return best_contexts(all_contexts(search_variants(variants, chunks, per), per), ["query_id"], ["chunk_id", "strategy"], n)


def funnel(variants: DataFrame, chunks: DataFrame, n: int = 8) -> DataFrame:
    """Contexts found, unique and selected per question, and found per strategy."""
    per = per_strategy(n)
    joint = all_contexts(search_variants(variants, chunks, per), per)
    strategies = ("standard", "expansion", "hyde")
    per_content = joint.groupBy("query_id", "content_hash").agg(
        F.sum("copies").alias("found"), *[F.sum(F.when(F.col("strategy") == s, F.col("copies")).otherwise(0)).alias(s) for s in strategies])
    return per_content.groupBy("query_id").agg(
        *[F.sum(c).alias(c) for c in (*strategies, "found")], F.count("*").alias("unique_contexts"),
        F.least(F.count("*"), F.lit(n)).alias("selected"))


# --- texts ----------------------------------------------------------------------------------------------------------

def content_sample(content: Column, length: int = 500) -> Column:
    """Start of a text with dots, also when nothing was cut; empty stays empty."""
    return F.when(F.coalesce(content, F.lit("")) == "", "").otherwise(F.concat(F.left(content, F.lit(length)), F.lit("...")))


def variant_list(model_text: Column, original: Column) -> Column:
    """Lines of a model answer with the original question at the end when it is not among them."""
    lines = non_blank_lines(model_text)
    return F.when(F.array_contains(lines, original), lines).otherwise(F.array_append(lines, original))


def context_text(questions: DataFrame, selected: DataFrame, chunks: DataFrame, corrections: DataFrame | None = None, n: int = 10) -> DataFrame:
    """The text handed to a model: the first contexts, then corrections; a fixed message when nothing was found.

    Only selected chunks (n per question) are gathered.
    """
    wanted = selected.filter(F.col("rank") <= n).select("query_id", "rank", "chunk_id")
    texts = wanted.join(chunks.select("chunk_id", F.regexp_replace("content", r"^\s+|\s+$", "").alias("content")), "chunk_id").filter("content <> ''")
    joined = texts.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda c: c["content"]), SEPARATOR).alias("contexts"))
    out = questions.join(joined, "query_id", "left")
    if corrections is not None:
        out = out.join(corrections, "query_id", "left")
    else:
        out = out.withColumn("corrections", F.lit(None).cast("string"))
    message = F.replace(F.lit(NOTHING_FOUND), F.lit("{}"), F.col("query_text"))
    added = F.coalesce(F.concat(F.lit(CORRECTIONS_HEADING), F.nullif("corrections", F.lit(""))), F.lit(""))
    return out.select("query_id", F.coalesce(F.concat("contexts", added), message).alias("context_text"))


def request_key(text: Column, k: int, **arguments: Column) -> Column:
    """Hash of the question, k and the further arguments in order of their names."""
    named = [F.concat(F.lit(f"{name}:"), value) for name, value in sorted(arguments.items())]
    return F.md5(F.concat_ws("::", text, F.lit(str(k)), *named))


def reused_requests(requests: DataFrame, key: str = "request_key", ts: str = "ts", ttl: int = 3600) -> DataFrame:
    """Which requests are computed and which reuse an answer computed less than ``ttl`` seconds ago. Reuse does not
    extend the life of an answer.

    Time counts in whole seconds, and requests of one key and second are merged first. The chain of computed requests of a busy key is
    cut into spans of time (a day, or ``ttl`` if that is longer). For every second at which a span may be entered, a task finds when its
    chain leaves the span; a fold over the few spans of a key tells where each is really entered; then all spans are
    marked at once. So the work of one key is spread over its spans.
    """
    import numpy as np

    span = max(86_400, ttl)
    seconds = requests.groupBy(key, epoch_seconds(F.col(ts)).alias("second")).agg(F.count("*").alias("requests"))
    parted = seconds.withColumn("span", F.floor(F.col("second") / span).cast("bigint"))
    kind = dict(seconds.dtypes)[key]

    def exits(table: pa.Table) -> pa.Table:
        """The first seconds of a span, up to the first one at which any answer from before has ended, with where their chains leave."""
        table = table.sort_by("second")
        second, number = table.column("second").to_numpy(), table.column("span")[0].as_py()
        after = np.searchsorted(second, second + ttl, side="left")
        leaves = np.zeros(len(second), np.int64)
        for i in range(len(second) - 1, -1, -1):
            leaves[i] = second[i] + ttl if after[i] == len(second) else leaves[after[i]]
        head = min(len(second), int(np.searchsorted(second, number * span + ttl, side="left")) + 1)
        own = {key: table.column(key)[:1], "span": table.column("span")[:1], "seconds": pa.array([second[:head].tolist()], pa.list_(pa.int64()))}
        return pa.table(own | {"leaves": pa.array([leaves[:head].tolist()], pa.list_(pa.int64()))})

    def enter(table: pa.Table) -> pa.Table:
        """When each span of one key may compute again for the first time."""
        table = table.sort_by("span")
        free, entries = None, []
        for row_seconds, row_leaves in zip(table.column("seconds"), table.column("leaves")):
            first, leaves = row_seconds.values.to_numpy(), row_leaves.values.to_numpy()
            free = int(first[0]) if free is None else free
            entries.append(free)
            at = int(np.searchsorted(first, free, side="left"))
            free = int(leaves[at]) if at < len(first) else free
        return pa.table({key: table.column(key), "span": table.column("span"), "free": pa.array(entries, pa.int64())})

    def mark(table: pa.Table) -> pa.Table:
        table = table.sort_by("second")
        second, computed = table.column("second").to_numpy(), np.zeros(table.num_rows, np.int64)
        at = int(np.searchsorted(second, table.column("free")[0].as_py(), side="left"))
        while at < len(second):
            computed[at] = 1
            at = int(np.searchsorted(second, second[at] + ttl, side="left"))
        return table.select([key, "second", "requests"]).append_column("computed", pa.array(computed))

    ways = parted.groupBy(key, "span").applyInArrow(exits, f"{key} {kind}, span bigint, seconds array<bigint>, leaves array<bigint>")
    entries = ways.groupBy(key).applyInArrow(enter, f"{key} {kind}, span bigint, free bigint")
    marked = parted.join(entries, [key, "span"]).groupBy(key, "span").applyInArrow(mark, f"{key} {kind}, second bigint, requests bigint, computed bigint")
    return marked.withColumn("reused", F.col("requests") - F.col("computed"))


def with_errors(questions: DataFrame, found: DataFrame) -> DataFrame:
    """Every question, those without any context with an error."""
    counts = found.groupBy("query_id").agg(F.count("*").alias("contexts"))
    n = F.coalesce("contexts", F.lit(0))
    return questions.select("query_id").join(counts, "query_id", "left").select("query_id", n.alias("contexts"), F.when(n == 0, "no contexts found").alias("error"))


# --- searches about tables and statements ----------------------------------------------------------------------------

COMMON_NAMES = 16  # a word in more names of a tenant than this is a common one
RARE_WORDS = 4_096  # a tenant's documents are asked for its rare words alone, when these are no more than this


def relationship_search(documents: DataFrame, names: DataFrame, n: int = 10) -> DataFrame:
    """Documents that answer five fixed questions about every table of a tenant, by share of question words. ``names`` has the tables to ask about.

    A question's words are its fixed words and the words of the table's name, which may be several (``sales-log``) and of any case. Only words that few
    names of the tenant have are joined, so a document meets a bounded number of names for each of its words. What a document holds of the
    common words (``db`` in every name) is the same for all names with the same common words: these are scored as one, and only against
    the first documents of each class that holds the same common and fixed words. The best of a name are among those that hold a rare word of it, which are scored in
    full, and the best by common and fixed words alone.

    What is moved: a document's words once, as a text, to the names of its tenant; from there only words that are in some name; and a row for each name and
    document that may be among its best, to the name, where all that follows is done.
    """
    per = n // len(RELATIONSHIP_TEXTS) + 1
    fixed = [F.array(*map(F.lit, sorted(set(t.replace("{}", " ").split())))) for t in RELATIONSHIP_TEXTS]
    asked = names.select("tenant", F.col("table_name").alias("asked")).withColumn("name_words", terms(F.col("asked")))
    each = asked.select("tenant", F.explode_outer("name_words").alias("word"))
    counted = each.groupBy("tenant", "word").agg(F.count("*").alias("n")).withColumn("often", F.col("n") > COMMON_NAMES)
    # rare words come first, so their place tells whether they are too many to be listed
    placed = counted.withColumn("place", F.row_number().over(Window.partitionBy("tenant").orderBy("often", "word")))
    listed = placed.groupBy("tenant").agg(
        F.sort_array(F.collect_set(F.when(F.col("often"), F.col("word")))).alias("tenant_common"),
        F.collect_set(F.when(~F.col("often") & (F.col("place") <= RARE_WORDS + 1), F.col("word"))).alias("tenant_rare"))
    known = listed.withColumn("tenant_rare", F.when(F.size("tenant_rare") <= RARE_WORDS, F.col("tenant_rare")))
    no_words = F.array().cast("array<string>")

    def common(words: str) -> Column:
        return F.array_sort(F.array_intersect(words, F.coalesce("tenant_common", no_words)))

    def not_fixed(words: Column, i: int) -> Column:
        return F.size(F.array_except(words, fixed[i]))

    own = asked.join(unshared(known.drop("tenant_rare")), "tenant", "left").select("tenant", "asked", "name_words", common("name_words").alias("asked_common"))
    words = documents.select("tenant", F.col("table_name").alias("doc"), F.unhex(F.md5("content")).alias("content_hash"), terms(F.col("content")).alias("words"))
    held = F.array(*[F.size(F.array_intersect("words", f)) for f in fixed])
    # a word has no space
    texts = words.select("tenant", "doc", "content_hash", held.alias("held"), F.array_join("words", " ").alias("words"))
    spelt = texts.join(unshared(known), "tenant", "left").withColumn("words", F.array_remove(F.split("words", " "), ""))
    scored = spelt.withColumn("common", common("words")).withColumn("words", F.coalesce(F.array_intersect("words", "tenant_rare"), "words"))

    # what a document holds of each question without the rare words
    base = F.array(*[F.get("held", F.lit(i)) + not_fixed(F.array_intersect("common", "asked_common"), i) for i in range(len(fixed))]).alias("base")
    classes = last_per_group(scored.select("tenant", "doc", "content_hash", "common", "held"), ["tenant", "common", "held"], [F.col("doc")], per, rank="place").drop("place", "position")
    signatures = own.select("tenant", "asked_common").distinct()
    met = classes.join(unshared(signatures), "tenant").select("tenant", "asked_common", "doc", "content_hash", base)
    by_question = met.select("*", F.posexplode("base").alias("question_no", "hits"))
    leading = last_per_group(by_question, ["tenant", "asked_common", "question_no"], [F.desc("hits"), F.col("doc")], per)
    lists = leading.groupBy("tenant", "asked_common").agg(F.collect_set(F.struct("doc", "content_hash", "base")).alias("leading"))
    general = own.join(unshared(lists), ["tenant", "asked_common"]).select("tenant", "asked", F.inline("leading"), F.lit(None).cast("string").alias("word"))

    rare = own.select("tenant", "asked", "asked_common", F.explode_outer(F.array_except("name_words", "asked_common")).alias("word")).filter("word IS NOT NULL")
    # the outer form: the plain one adds a filter that would compute the words of every document again
    by_word = scored.select("tenant", "doc", "content_hash", "common", "held", F.explode_outer("words").alias("word"))
    special = by_word.join(unshared(rare), ["tenant", "word"]).select("tenant", "asked", "doc", "content_hash", base, "word")

    # dealt by name: whatever follows needs no further shuffle
    candidates = general.unionByName(special).repartition("tenant", "asked")
    extra = [F.sum(F.when(F.col("word").isNull() | F.array_contains(f, F.col("word")), 0).otherwise(1)) for f in fixed]
    pairs = candidates.groupBy("tenant", "asked", "doc", "content_hash", "base").agg(F.array(*extra).alias("extra"))
    hits = F.zip_with("base", "extra", lambda b, e: b + e)
    sizes = F.transform(F.array(*fixed), lambda f: F.size(F.array_union(f, terms(F.col("asked")))))
    question = ["tenant", "asked", "question_no"]
    answers = pairs.select("tenant", "asked", "doc", "content_hash", F.posexplode(F.zip_with(hits, sizes, lambda h, size: h / size)).alias("question_no", "score"))
    found = last_per_group(answers, question, [F.desc("score"), F.col("doc")], per, rank="rank").withColumn("position", place(F.col("rank"), F.col("question_no")))
    return best_contexts(found, ["tenant", "asked"], ["doc", "question_no"], n).withColumn("content_hash", F.lower(F.hex("content_hash")))


def statement_questions(statements: DataFrame, sql: str = "sql") -> DataFrame:
    """Questions about a statement: three per FROM or JOIN table, repeats kept, and one about its first 100 characters."""
    tables = sqltext.table_mentions(F.col(sql))
    texts = F.flatten(F.transform(tables, lambda t: F.array(*[F.replace(F.lit(x), F.lit("{}"), t) for x in STATEMENT_TABLE_TEXTS])))
    rows = F.transform(texts, lambda x: F.struct(x.alias("query_text"), F.lit(3).alias("k")))
    last = F.struct(F.replace(F.lit(STATEMENT_TEXT), F.lit("{}"), F.left(sql, F.lit(100))).alias("query_text"), F.lit(5).alias("k"))
    return statements.select("query_id", F.posexplode(F.array_append(rows, last)).alias("question_no", "q")).select("query_id", "question_no", "q.*")


def statement_search(statements: DataFrame, chunks: DataFrame, n: int = 10) -> DataFrame:
    """Context for SQL statements. Each distinct question text is searched once, whatever the number of statements."""
    asked = _once(statement_questions(statements), "statement-questions")
    best = keyword_top_k(asked.select("query_text").distinct(), chunks, 5, ("query_text",), carry="content_hash")
    found = asked.join(best, "query_text").filter(F.col("rank") <= F.col("k")).withColumn("position", place(F.col("rank"), F.col("question_no")))
    return best_contexts(found, ["query_id"], ["chunk_id", "question_no"], n)
