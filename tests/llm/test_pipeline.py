"""The whole pipeline against the plain operators one after the other, and the registered queries."""

import os
import random

import pytest

import corpus_pipeline
from querylore.llm.queries import QUERIES, SQL, vocabulary
from tests.llm import plain

WORDS = vocabulary("word_bpe_49k.json")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    corpus = plain.corpus(8)
    long_one = max((t for _, t in corpus if t), key=len).split()
    items = [(1, " ".join(long_one[500:530])), (2, plain.sentence(rng, 20)), (3, None)]
    top = max(i for i, _ in corpus)
    corpus += [(top + 1, "12 34 -- 56"), (top + 2, f"{plain.sentence(rng, 30)} {items[1][1]}"), (top + 3, plain.sentence(rng, 80, "mnopqr"))]
    rows = [(i, t, "bb" if t and set(t) & set("mnopqr") else "aa", f"s{i % 3}", len(t) if t is not None else None, 1.5) for i, t in corpus]
    rows[3] = (*rows[3][:2], None, *rows[3][3:])
    path = str(tmp_path_factory.mktemp("corpus"))
    # an extra column whose name an operator uses itself
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, corpus, items


def test_stages_and_run(spark, folder):
    from tokenizers import Tokenizer

    if not os.path.isfile(WORDS):
        pytest.skip("public vocabulary files not found")
    path, corpus, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    left = {i: t for i, t in corpus if t and any(c.isalpha() for c in t)}
    groups = plain.jaccard_components(left.items())
    unique = {i: t for i, t in left.items() if groups[i][1] == i}
    cut = {i: (kept if removed else unique[i]) for i, (_, removed, kept) in plain.cut_windows(unique.items()).items()}
    leaks = plain.leaks(cut.items(), items)
    clean = {i: t for i, t in cut.items() if i not in {d for d, _ in leaks}}
    assert len(corpus) > len(left) > len(unique) > len(clean) and cut != unique
    names = []
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], (left, unique, cut, clean)):
        docs = corpus_pipeline.stored(stage(spark, docs, path), f"test-{name}")
        rows = docs.collect()
        assert sorted(docs.columns) == sorted(["doc_id", "text", "lang", "source", "n_chars", "score"])
        assert {r.doc_id: r.text for r in rows} == want and len(rows) == len(want)
        assert all(r.n_chars == len(r.text) and r.score == 1.5 for r in rows)
        names.append(name)
    public = Tokenizer.from_file(WORDS)
    got = {r.doc_id: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()}
    assert set(got) == set(clean)
    for i, text in clean.items():
        ids = public.encode(text, add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].n_tokens == len(ids) and got[i].decoded == public.decode(ids, skip_special_tokens=False)
    assert [n for n, _ in corpus_pipeline.STAGES] == [*names, "bpe_encoding"]


def test_empty_corpus(spark, folder, tmp_path):
    path, _, _ = folder
    spark.read.parquet(f"{path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{path}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    from oracle import connect, difference, run_duckdb, run_spark

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("supplied tables not found")
    got = run_spark(QUERIES[name](spark, folder))
    assert got[1] and difference(got, run_duckdb(connect(folder), SQL[name])) is None
