"""Exact retrieval against brute force, with ties and copies, on both ways of sharing questions."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from querylore.operators import cells as L
from querylore.operators import retrieval as R

DIM = 4


def vectors(n, seed, distinct=None):
    rng = random.Random(seed)
    pool = [[float(F32(rng.uniform(-1, 1))) for _ in range(DIM)] for _ in range(distinct or n)]
    return [pool[i % len(pool)] for i in range(n)]


def F32(x):
    import struct
    return struct.unpack("f", struct.pack("f", x))[0]


def dot(a, b):
    total = 0.0
    for x, y in zip(a, b):
        total += x * y
    return total


def frames(spark, questions, chunks, contents=None):
    q = spark.createDataFrame([(i, v, f"g{i % 2}") for i, v in enumerate(questions)], "query_id bigint, embedding array<float>, kind string")
    c = spark.createDataFrame([(i, v, f"g{i % 2}", (contents or {}).get(i, f"text {i}")) for i, v in enumerate(chunks)],
                              "chunk_id bigint, embedding array<float>, kind string, content string").repartition(3)
    return q, c


def brute(questions, chunks, k, by=False):
    out = set()
    for qi, q in enumerate(questions):
        scored = sorted((-dot(c, q), ci) for ci, c in enumerate(chunks) if not by or ci % 2 == qi % 2)
        out |= {(qi, ci, rank + 1, -s) for rank, (s, ci) in enumerate(scored[:k])}
    return out


def rows(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


@pytest.mark.parametrize("shared", [R.SHARED_BYTES, 0])
@pytest.mark.parametrize("distinct", [None, 3])
def test_top_k(spark, monkeypatch, shared, distinct):
    # three distinct vectors among ninety: a third of all chunks ties for every place
    monkeypatch.setattr(R, "QUESTION_BLOCK", 3)
    monkeypatch.setattr(R, "CHUNK_BLOCK", 20)
    questions, chunks = vectors(8, 1), vectors(90, 2, distinct)
    q, c = frames(spark, questions, chunks)
    assert rows(R.top_k(q, c, 5, shared_bytes=shared), "query_id", "chunk_id", "rank", "score") == brute(questions, chunks, 5)
    by = R.top_k(q, c, 4, ("query_id",), by="kind", shared_bytes=shared)
    assert rows(by, "query_id", "chunk_id", "rank", "score") == brute(questions, chunks, 4, by=True)


def test_top_k_edges(spark):
    questions, chunks = vectors(2, 3), vectors(3, 4)
    q, c = frames(spark, questions, chunks)
    assert rows(R.top_k(q, c, 10), "query_id", "chunk_id", "rank", "score") == brute(questions, chunks, 10)
    assert R.top_k(q.filter("false"), c, 3).count() == 0
    missing = c.withColumn("embedding", F.when(F.col("chunk_id") != 0, F.col("embedding")))
    assert rows(R.top_k(q, missing, 3), "chunk_id") == {(1,), (2,)}


WORDS = "table order key schema the of join index".split()


def texts(n, seed):
    rng = random.Random(seed)
    return [" ".join(rng.choices(WORDS, k=rng.randint(1, 6))).title() + "!" for _ in range(n)]


def share(question, text):
    asked, have = set(question.lower().strip("!").split()), set(text.lower().strip("!").split())
    return len(asked & have) / len(asked)


@pytest.mark.parametrize("shared", [R.SHARED_BYTES, 0])
def test_keyword_and_hybrid(spark, monkeypatch, shared):
    monkeypatch.setattr(R, "QUESTION_BLOCK", 2)
    monkeypatch.setattr(R, "CHUNK_BLOCK", 15)
    questions, chunks, asked, contents = vectors(5, 5), vectors(40, 6), texts(5, 7), dict(enumerate(texts(40, 8)))
    q, c = frames(spark, questions, chunks, contents)
    q = q.join(spark.createDataFrame(list(enumerate(asked)), "query_id bigint, query_text string"), "query_id")
    want = set()
    for qi, text in enumerate(asked):
        scored = sorted((-share(text, contents[ci]), ci) for ci in contents)[:3]
        want |= {(qi, ci, r + 1, -s) for r, (s, ci) in enumerate(scored)}
    assert rows(R.keyword_top_k(q, c, 3, shared_bytes=shared), "query_id", "chunk_id", "rank", "score") == want

    want = {}
    for qi, text in enumerate(asked):
        v, k = [dot(x, questions[qi]) for x in chunks], [share(text, contents[ci]) for ci in contents]

        def scaled(x, values):
            low, high = min(values), max(values)
            return (x - low) / (high - low) if high > low else 0.0
        scored = sorted((-(0.7 * scaled(v[i], v) + 0.3 * scaled(k[i], k)), i) for i in contents)[:4]
        want |= {(qi, i): (r + 1, -s) for r, (s, i) in enumerate(scored)}
    got = {(r["query_id"], r["chunk_id"]): (r["rank"], r["score"]) for r in R.hybrid_top_k(q, c, 4, shared_bytes=shared).collect()}
    assert set(got) == set(want)
    assert all(got[x][0] == want[x][0] and math.isclose(got[x][1], want[x][1], abs_tol=1e-12) for x in want)


def test_content_dedup_keeps_best_row_at_first_place(spark):
    found = spark.createDataFrame(
        [(1, "h", 10, 0.5, 1), (1, "h", 11, 0.9, 4), (1, "h", 12, 0.9, 3), (1, "i", 13, 0.9, 2), (2, "h", 14, 0.1, 1)],
        "query_id int, content_hash string, chunk_id int, score double, position int")
    kept = rows(R.dedup_contexts(found, ["query_id"], ["chunk_id"]), "query_id", "content_hash", "chunk_id", "score", "first_position")
    assert kept == {(1, "h", 12, 0.9, 1), (1, "i", 13, 0.9, 2), (2, "h", 14, 0.1, 1)}
    assert rows(R.best_contexts(found, ["query_id"], ["chunk_id"], 1), "query_id", "chunk_id") == {(1, 12), (2, 14)}


@pytest.mark.parametrize("n_chunks, n", [(50, 8), (400, 450)])
def test_multi_strategy_against_loops(spark, n_chunks, n):
    questions, chunks, per = vectors(60, 9), vectors(n_chunks, 10), R.per_strategy(n)
    contents = {i: f"text {i % (n_chunks * 2 // 5)}" for i in range(n_chunks)}
    _, c = frames(spark, questions, chunks, contents)
    names = [("standard", 0, 0), ("expansion", 1, 0), ("expansion", 1, 1), ("hyde", 2, 0)]
    variants = [(q, *n, questions[(q * 4 + i) % 60]) for q in range(10) for i, n in enumerate(names) if not (q == 3 and n[0] == "hyde")]
    v = spark.createDataFrame(variants, "query_id bigint, strategy string, strategy_no int, variant_no int, embedding array<float>")

    def search(vector, k):
        return [(ci, -s) for s, ci in sorted((-dot(x, vector), ci) for ci, x in enumerate(chunks))[:k]]

    def merged(found, n):
        slots = {}
        for ci, s in found:
            if contents[ci] not in slots or s > slots[contents[ci]][1]:
                slots[contents[ci]] = (ci, s)
        return sorted(slots.values(), key=lambda x: x[1], reverse=True)[:n]

    want = set()
    for q in range(10):
        own = {(n, i): x for qq, n, _, i, x in variants if qq == q}
        joint = search(own["standard", 0], per) + merged(search(own["expansion", 0], per) + search(own["expansion", 1], per), per)
        joint += search(own.get(("hyde", 0), own["standard", 0]), per)
        want |= {(q, ci, rank + 1, s) for rank, (ci, s) in enumerate(merged(joint, n))}
    assert rows(R.multi_strategy(v, c, n), "query_id", "chunk_id", "rank", "score") == want
    if n != 8:
        return
    # two of each strategy for eight contexts
    assert R.per_strategy(8) == 2 and R.per_strategy(3) == 2 and R.per_strategy(12) == 4
    funnel = {r["query_id"]: r for r in R.funnel(v, c, 8).collect()}
    assert all(r["found"] == 6 and r["selected"] == r["unique_contexts"] <= 6 for r in funnel.values())


def test_reuse_follows_computed_answers(spark):
    rng = random.Random(11)
    requests = [("hot", rng.randint(0, 40_000)) for _ in range(3_000)] + [("edge", x) for x in (0, 3599, 3600, 7199, 7200)] + [("one", 5)]
    requests += [("days", rng.randint(0, 900_000)) for _ in range(900)] + [("days", 5_000_000), ("days", 5_000_001)]
    df = spark.createDataFrame(requests, "request_key string, s bigint").withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz"))
    got = {}
    for r in R.reused_requests(df).collect():
        got.setdefault(r["request_key"], []).append((r["second"], r["computed"]))
    for key in got:
        last, want = None, []
        for s in sorted({s for k, s in requests if k == key}):
            fresh = last is None or s - last >= 3600
            last = s if fresh else last
            want.append((s, int(fresh)))
        assert sorted(got[key]) == want
    total = R.reused_requests(df).agg(F.sum("requests"), F.sum("reused") + F.sum("computed")).first()
    assert total[0] == total[1] == len(requests)


@pytest.mark.parametrize("common", [16, 1])
def test_relationship_search_with_telling_names(spark, monkeypatch, common):
    # table names that are question words themselves, and names nobody else mentions; words that many names share
    monkeypatch.setattr(R, "COMMON_NAMES", common)
    tenants = {"d": [f"db-{x}" for x in ("order", "customer", "order-line", "keys", "z")] + ["tables-db", "DB"], "a": ["table", "keys", "orders", "zebra"], "b": ["reference"], "c": ["DB_Order", "sales-log", "db.order", "Sales", "foreign-keys"]}
    rng = random.Random(12)
    docs = [(t, n, f"{n} " + " ".join(rng.choices(["primary", "key", "foreign", "keys", "tables", "schema", "relationships", "orders", "of", "x"], k=6)))
            for t, ns in tenants.items() for n in ns]
    d = spark.createDataFrame(docs, "tenant string, table_name string, content string")
    want = set()
    for tenant, asked in [(t, n) for t, ns in tenants.items() for n in ns]:
        own = [(n, c) for t, n, c in docs if t == tenant]
        slots = {}
        for no, pattern in enumerate(R.RELATIONSHIP_TEXTS):
            words = set(re.findall(r"\w+", pattern.replace("{}", asked).lower()))
            top = sorted((-len(words & set(re.findall(r"\w+", c.lower()))) / len(words), n, c) for n, c in own)[:3]
            for s, n, c in top:
                if c not in slots or -s > slots[c][1]:
                    slots[c] = (n, -s)
        best = sorted(slots.values(), key=lambda x: x[1], reverse=True)[:10]
        want |= {(tenant, asked, n, rank + 1, round(s, 9)) for rank, (n, s) in enumerate(best)}
    got = R.relationship_search(d, d.select("tenant", "table_name"))
    assert {(r["tenant"], r["asked"], r["doc"], r["rank"], round(r["score"], 9)) for r in got.collect()} == want


def test_texts(spark):
    one = spark.createDataFrame([("a\n b \n\nq", "q"), ("x", "q"), ("", "q")], "m string, o string")
    assert [r[0] for r in one.select(R.variant_list(F.col("m"), F.col("o"))).collect()] == [["a", "b", "q"], ["x", "q"], ["q"]]
    sample = spark.createDataFrame([("ab",), ("",), (None,), ("x" * 600,)], "c string").select(R.content_sample(F.col("c"))).collect()
    assert [r[0] for r in sample] == ["ab...", "", "", "x" * 500 + "..."]
    questions = spark.createDataFrame([(1, "why"), (2, "how")], "query_id int, query_text string")
    selected = spark.createDataFrame([(1, 2, 7), (1, 1, 8), (1, 3, 9)], "query_id int, rank int, chunk_id int")
    chunks = spark.createDataFrame([(7, " b "), (8, "a"), (9, " ")], "chunk_id int, content string")
    got = dict(tuple(r) for r in R.context_text(questions, selected, chunks, spark.createDataFrame([(1, "fix")], "query_id int, corrections string")).collect())
    assert got == {1: "a\n\n---\n\nb\n\n--- USER CORRECTIONS ---\n\nfix", 2: R.NOTHING_FOUND.format("how")}
    asked = spark.createDataFrame([(1, "SELECT x FROM a JOIN b JOIN a")], "query_id int, sql string")
    texts = [r["query_text"] for r in R.statement_questions(asked).orderBy("question_no").collect()]
    assert texts[0] == "a schema columns indexes" and texts[6:9] == texts[0:3] and len(texts) == 10 and texts[-1].startswith("SQL query optimization for: SELECT x")


@pytest.mark.parametrize("shared", [R.SHARED_BYTES, 0])
@pytest.mark.parametrize("distinct, cells", [(None, 9), (3, 9), (None, 1)])
def test_search_by_cells_equals_brute_force(spark, monkeypatch, tmp_path, shared, distinct, cells):
    # scattered vectors, where next to nothing can be skipped, and three vectors that fill all places with ties
    monkeypatch.setattr(R, "QUESTION_BLOCK", 3)
    monkeypatch.setattr(R, "CHUNK_BLOCK", 20)
    questions, chunks = vectors(8, 1), vectors(90, 2, distinct)
    q, c = frames(spark, questions, chunks)
    c = c.unionByName(spark.createDataFrame([(1000, None, "g0", "no vector")], c.schema))
    table = L.CellTable(spark, L.write_cells(c, str(tmp_path / "cells"), cells))
    assert rows(L.cell_top_k(q, table, 5, shared_bytes=shared), "query_id", "chunk_id", "rank", "score") == brute(questions, chunks, 5)
    got = L.cell_top_k(q, table, 5, ("query_id", "kind"), by="kind", carry="content", shared_bytes=shared)
    assert rows(got, "query_id", "chunk_id", "rank", "score") == brute(questions, chunks, 5, by=True)
    assert all(r["content"] == f"text {r['chunk_id']}" for r in got.collect())
    few = L.cell_top_k(q, table, 200, shared_bytes=shared)
    assert few.count() == 8 * 90


def test_search_by_cells_skips_most_pairs_of_grouped_vectors(spark, tmp_path):
    rng = random.Random(5)
    centres = [[rng.uniform(-1, 1) * 4 for _ in range(DIM)] for _ in range(30)]
    near = lambda x: [F32(v + rng.uniform(-0.05, 0.05)) for v in x]
    chunks, questions = [near(centres[i % 30]) for i in range(3000)], [near(centres[i % 30]) for i in range(40)]
    q, c = frames(spark, questions, chunks)
    table = L.CellTable(spark, L.write_cells(c, str(tmp_path / "cells")))
    assert rows(L.cell_top_k(q, table, 5), "query_id", "chunk_id", "rank", "score") == brute(questions, chunks, 5)
    compared = L.compared_pairs(q, table, 5).collect()
    assert len(compared) == 40 and 0 < sum(r["compared"] for r in compared) < 40 * 3000 / 2
    empty = L.CellTable(spark, L.write_cells(c.limit(0), str(tmp_path / "none")))
    assert L.cell_top_k(q, empty, 5).collect() == []


def test_keyword_lists_equal_a_full_count_and_stay_small():
    import tracemalloc

    import pyarrow as pa

    from querylore.functions import blocks

    rng = random.Random(9)
    word = lambda: int(20_000 * rng.random() ** 3)  # noqa: E731  some words are in most questions
    questions = [sorted({word() for _ in range(rng.randint(0, 9))}) for _ in range(5_000)]
    chunks = [sorted({word() for _ in range(rng.randint(0, 60))}) for _ in range(700)]
    asked = pa.table({"query_id": pa.array(range(5_000)), "terms": pa.array(questions, pa.list_(pa.int64()))})
    batch = pa.RecordBatch.from_arrays([pa.array([(i * 7919) % 700 for i in range(700)]), pa.array(chunks, pa.list_(pa.int64()))], ["chunk_id", "terms"])
    tracemalloc.start()
    found = next(blocks.keyword_top_k(asked, iter([batch.slice(0, 300), batch.slice(300)]), ["query_id"], 5, None)).to_pydict()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1 << 30
    got = {}
    for q, c, s in zip(found["query_id"], found["chunk_id"], found["score"]):
        got.setdefault(q, []).append((-s, c))
    sets = [(batch.column(0)[i].as_py(), set(t)) for i, t in enumerate(chunks)]
    for q in range(0, 5_000, 61):
        want = sorted((-len(own & set(questions[q])) / max(1, len(questions[q])), c) for c, own in sets)[:5]
        assert sorted(got[q]) == want


def test_each_distinct_word_set_is_compared_once(spark, monkeypatch):
    # 400 chunks hold one of eight sets of the words asked for, and words of their own that no question has
    monkeypatch.setattr(R, "QUESTION_BLOCK", 3)
    monkeypatch.setattr(R, "CHUNK_BLOCK", 3)
    held = lambda i: [w for bit, w in enumerate(("alpha", "beta", "gamma")) if i >> bit & 1]
    contents = {(i * 7919) % 400: " ".join([*held(i), f"own{i}", "all"]) for i in range(400)}
    asked = ["alpha beta x1", "Beta alpha x1", "gamma", "nothing", "", None, "alpha gamma beta gamma"]
    q = spark.createDataFrame(list(enumerate(asked)), "query_id bigint, query_text string")
    c = spark.createDataFrame([(i, x, f"hash {i}") for i, x in contents.items()] + [(1000, None, "hash 1000")], "chunk_id bigint, content string, content_hash string")
    contents[1000] = ""
    want = set()
    for qi, text in enumerate(asked):
        scored = sorted((-share(text, contents[ci]) if text else 0.0, ci) for ci in contents)[:9]
        want |= {(qi, ci, f"hash {ci}", r + 1, -s) for r, (s, ci) in enumerate(scored)}
    compared, blockwise = [], R.blockwise

    def watched(asked, have, *rest):
        compared.append((asked.count(), have.count()))
        return blockwise(asked, have, *rest)
    monkeypatch.setattr(R, "blockwise", watched)
    for shared in (R.SHARED_BYTES, 0):
        got = R.keyword_top_k(q, c, 9, carry="content_hash", shared_bytes=shared)
        assert rows(got, "query_id", "chunk_id", "content_hash", "rank", "score") == want
    assert compared[0] == (6, 8) and compared[1][0] == 6


def test_no_side_of_a_relationship_search_is_sent_whole(spark):
    d = spark.createDataFrame([("a", "t", "t keys"), ("a", "u", "u")], "tenant string, table_name string, content string")
    found = R.relationship_search(d, d.select("tenant", "table_name"))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.filter("asked = 't' AND rank = 1").first()["doc"] == "t"


def test_a_relationship_search_moves_words_of_names_and_ranks_in_one_place(spark, monkeypatch):
    d = spark.createDataFrame([(t, f"{n}-log", f"{n} log of {m} keys") for t in "ab" for n in "uvwxyz" for m in "u"], "tenant string, table_name string, content string")
    want = None
    for rare in (R.RARE_WORDS, 6, 5, 0):  # a tenant with more rare words than this has all words of its documents moved
        monkeypatch.setattr(R, "RARE_WORDS", rare)
        monkeypatch.setattr(R, "COMMON_NAMES", 5)
        found = R.relationship_search(d, d.select("tenant", "table_name"))
        got = sorted(tuple(r) for r in found.collect())
        want = want or got
        assert got == want and {r[1] for r in got} == {f"{n}-log" for n in "uvwxyz"}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = R.relationship_search(d, d.select("tenant", "table_name"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(re.findall(r"(?<!Reused)Exchange hashpartitioning\([^)]*\basked#", plan)) == 1
    assert "ReusedExchange" in plan and "tenant_rare" in plan  # documents are made once


@pytest.mark.parametrize("by", [None, "kind"])
def test_each_distinct_vector_is_compared_once(spark, monkeypatch, by):
    # 60 questions and 90 chunks have few vectors; some questions come twice, and a key has two vectors
    monkeypatch.setattr(R, "VECTOR_QUESTIONS", 2)
    monkeypatch.setattr(R, "VECTOR_CHUNKS", 2)
    questions, chunks = vectors(60, 3, 4), vectors(90, 4, 5)
    q, c = frames(spark, questions, chunks)
    want = {(i, *r) for i, *r in brute(questions, chunks, 7, by=bool(by))}
    compared, blockwise = {}, R.blockwise

    def watched(asked, have, *rest):
        compared["questions"], compared["chunks"] = asked.count(), have.count()
        return blockwise(asked, have, *rest)
    monkeypatch.setattr(R, "blockwise", watched)
    keys = ("query_id", by) if by else ("query_id",)
    for shared in (R.SHARED_BYTES, 0):
        got = R.top_k(q, c, 7, keys, by=by, carry="content", shared_bytes=shared)
        assert rows(got, "query_id", "chunk_id", "rank", "score") == want
        assert all(r["content"] == f"text {r['chunk_id']}" for r in got.collect())
        assert compared["questions"] <= 4 * (3 if by else 1) and compared["chunks"] <= 5 * (3 if by else 1)
    twice = R.top_k(q.unionByName(q), c, 7, keys, by=by)
    assert twice.count() == len(want) and twice.filter("rank = 2").join(twice.filter("rank = 1").select("query_id", "chunk_id"), ["query_id", "chunk_id"]).count() == 60


@pytest.mark.parametrize("kind", ["float32", "float64"])
def test_single_precision_finds_the_exact_best(kind):
    import numpy as np
    import pyarrow as pa

    from querylore.functions import blocks

    rng = np.random.default_rng(1)
    # next to equal vectors of very different lengths: single precision alone cannot tell them apart
    chunks = (np.repeat(rng.normal(size=(30, 64)), 40, 0) * (1 + 1e-7 * rng.integers(0, 9, (1200, 64)))).astype(kind)
    asked = (rng.normal(size=(25, 64)) * 10.0 ** rng.integers(-3, 4, (25, 1))).astype(kind)
    listed = lambda m: pa.array(list(m), pa.list_(pa.from_numpy_dtype(kind)))
    table = pa.table({"query_id": np.arange(25), "embedding": listed(asked)})
    batch = pa.RecordBatch.from_arrays([pa.array(rng.permutation(1200)), listed(chunks)], ["chunk_id", "embedding"])
    found = pa.Table.from_batches(blocks.vector_top_k(table, iter([batch.slice(0, 700), batch.slice(700)]), ["query_id"], 5, None, None)).to_pydict()
    got = {(q, c) for q, c in zip(found["query_id"], found["chunk_id"])}
    ident, want = batch.column(0).to_numpy(), set()
    for q in range(25):
        score = blocks.plain_dot(chunks.astype(float), np.broadcast_to(asked[q].astype(float), chunks.shape))
        want |= {(q, int(i)) for i in ident[np.lexsort((ident, -score))[:5]]}
    assert got == want
