"""Joins, dedup, decontamination, shards and fingerprints of documents against plain versions."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from querylore.llm import decontaminate, ngram_join, sharding, substring_dedup, winnowing
from querylore.llm.common import components, following
from tests.llm import plain

DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def corpus():
    return plain.corpus()


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(5)


@pytest.mark.parametrize("leaf_cell, leaf, cell", [(16, 48, 1024), (1, 3, 1024), (1, 2, 4)])
def test_jaccard_join_equals_all_pairs(docs, corpus, monkeypatch, leaf_cell, leaf, cell):
    # small limits send the fixture through pivots, windows, recursion and blocks
    for name, value in (("LEAF_CELL", leaf_cell), ("LEAF", leaf), ("CELL", cell)):
        monkeypatch.setattr(ngram_join, name, value)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_join(docs).collect()}
    assert got == plain.jaccard_components(corpus)


@pytest.mark.parametrize("rows, shingles, often", [(2048, 1 << 19, 64), (7, 1 << 19, 3), (2048, 3000, 1)])
def test_link_counts_equal_all_pairs(docs, corpus, monkeypatch, rows, shingles, often):
    # small limits send the fixture through blocks and matrix products
    for name, value in (("PAIR_ROWS", rows), ("PAIR_SHINGLES", shingles), ("OFTEN", often)):
        monkeypatch.setattr(ngram_join, name, value)
    got = {r.doc_id: r.n_links for r in ngram_join.ngram_jaccard_join(docs).collect()}
    assert got == plain.link_counts(corpus)
    assert sum(got.values()) > 300


def test_link_counts_of_odd_rows(spark):
    rng = random.Random(1)
    text, other = plain.sentence(rng, 40), plain.sentence(rng, 40)
    rows = [(1, text), (1, text), (1, other), (2, other), (None, text), (3, text + " end"), (4, None), (5, "")]
    got = sorted(((r.doc_id, r.n_shingles, r.n_links) for r in ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, DOCS)).collect()), key=repr)
    assert got == [(1, 36, 1), (1, 36, 2), (1, 36, 2), (2, 36, 1), (3, 37, 2), (4, 0, 0), (5, 0, 0), (None, None, None)]


def test_metric_join_equals_all_pairs():
    import numpy as np

    rng = np.random.default_rng(3)
    centres = rng.integers(0, 9, (12, 20))
    points = np.concatenate([c + rng.integers(0, 2, (30, 20)) for c in centres])
    sizes, labels = points.sum(1), np.arange(len(points)) % 50
    want = {(i, j) for j in range(len(points)) for i in range(j) if labels[i] != labels[j] and ngram_join.fold_distances(points, sizes, i)[j] <= 0.1 + 1e-9}
    assert want and set(ngram_join.metric_join(points, sizes, labels, 0.1)) == want


def test_jaccard_join_of_odd_rows(spark):
    text = plain.sentence(random.Random(1), 40)
    rows = [(1, text, "x"), (1, text, "y"), (None, text, "z"), (2, None, "x"), (3, text, None)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_join(odd).collect() if r.doc_id)
    assert got == [(1, 36, 1), (1, 36, 1), (2, 0, 2), (3, 36, 1)]
    kept = ngram_join.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 1, 2]
    assert ngram_join.ngram_jaccard_join(odd.limit(0)).collect() == []


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(1000, k) for k in range(1001, 1300)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, 61)} | {k: 1000 for k in range(1001, 1300)}


def test_windows_equal_plain(docs, corpus):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeated_windows(docs).collect()}
    assert got == plain.cut_windows(corpus)
    assert sum(v[1] for v in got.values()) > 1000


def test_windows_of_odd_rows(spark):
    text = plain.sentence(random.Random(2), 55)
    rows = [(4, text, 1, "a"), (4, text, 2, "b"), (None, text, 3, "c"), (9, text + " end", 4, None), (10, None, 5, "e")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, n_words int, note string")
    got = sorted((r.note or "d", r.n_words, r.n_removed) for r in substring_dedup.remove_repeated_windows(odd).collect())
    assert got == [("a", 55, 0), ("b", 55, 0), ("c", 55, 0), ("d", 56, 55), ("e", 0, 0)]
    assert substring_dedup.remove_repeated_windows(odd.limit(0)).collect() == []


def test_leaks_equal_plain(spark, docs, corpus):
    rng = random.Random(4)
    long_one = max((t for _, t in corpus if t), key=len).split()
    items = [(1, " ".join(long_one[500:530])), (2, "A b c d"), (3, plain.sentence(rng, 30)), (4, None), (5, " ".join(long_one[29_950:29_990]).upper()), (6, ""), (1, " ".join(long_one[500:530]))]
    w = long_one[900:940]
    w[20] = "changed"
    items += [(7, " ".join(w)), (8, " ".join(long_one[700:710] + plain.sentence(rng, 30).split()))]
    found = decontaminate.contained_items(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): (r.item_shingles, r.shared_shingles) for r in found} == plain.leaks(corpus, items)
    assert {r.item_id for r in found} == {1, 2, 5, 7}


def test_short_items_are_found_inside_documents(spark):
    texts = [(1, "zero one Two three four five six"), (2, "one two three"), (3, "one two, three four"), (4, "four"), (5, None), (6, "three four one two three four")]
    items = [(1, "one two three four"), (2, "FOUR"), (3, "one two"), (4, " "), (5, None), (6, "six seven"), (7, "zero one two three four five six")]
    found = decontaminate.contained_items(spark.createDataFrame(texts, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): (r.item_shingles, r.shared_shingles) for r in found} == plain.leaks(texts, items)
    assert {(r.doc_id, r.item_id) for r in found} == {(1, 1), (6, 1), (1, 2), (3, 2), (4, 2), (6, 2), (1, 3), (2, 3), (6, 3), (1, 7)}
    assert all(r.containment == 1.0 for r in found)


def test_columns_that_clash_with_inner_names(spark):
    text = plain.sentence(random.Random(2), 55)
    odd = spark.createDataFrame([(1, text, "a", "b", "c"), (2, text + " end", "d", "e", "f")], "doc_id long, text string, owned string, leak string, letters string")
    items = spark.createDataFrame([(1, text)], "item_id long, text string")
    assert [r.n_removed for r in substring_dedup.remove_repeated_windows(odd).orderBy("doc_id").collect()] == [0, 55]
    assert decontaminate.drop_contaminated(odd, items).columns == odd.columns
    cut = substring_dedup.remove_repeated_windows(odd)
    assert cut.select("owned", "leak", "letters").distinct().count() == 2


def test_clean_documents_stay(spark, docs, corpus):
    rng = random.Random(4)
    long_one = max((t for _, t in corpus if t), key=len).split()
    items = [(1, " ".join(long_one[500:530])), (2, "A b c d")]
    found = decontaminate.contained_items(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    clean = decontaminate.drop_contaminated(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in corpus} - {r.doc_id for r in found}


def test_leaks_of_odd_rows(spark):
    item = plain.sentence(random.Random(8), 20)
    odd = spark.createDataFrame([(None, item, 1), (1, "x " + item, 2), (1, None, 3), (2, "", None)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(None, item), (5, item)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contained_items(odd, items).collect()}
    assert got == {(None, None), (None, 5), (1, None), (1, 5)}
    assert [r.doc_id for r in decontaminate.drop_contaminated(odd, items).collect()] == [2]
    assert decontaminate.contained_items(odd.limit(0), items).collect() == []
    assert decontaminate.contained_items(odd, items.limit(0)).collect() == []


def _check_shards(rows, texts, shards):
    by = defaultdict(list)
    for r in rows:
        assert r.size == len((texts[r.doc_id] or "").encode()) + 1
        assert r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode())
        by[r.shard].append(r)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    assert set(by) <= set(range(shards))
    return {k: sum(r.size for r in own) for k, own in by.items()}


def test_shards(spark, docs, corpus):
    _check_shards(sharding.assign_shards(docs).collect(), dict(corpus), 16)


def test_shards_are_even_when_one_text_holds_a_third(spark):
    rng = random.Random(6)
    rows = [(i, "hot text of some length" * 10 if i % 3 == 0 else plain.sentence(rng, 20)) for i in range(6000)]
    sizes = _check_shards(sharding.assign_shards(spark.createDataFrame(rows, DOCS), 8).collect(), dict(rows), 8)
    assert len(sizes) == 8 and max(sizes.values()) < 1.03 * min(sizes.values())


def test_copies_share_a_shard(spark):
    rng = random.Random(7)
    some = [plain.sentence(rng, 10) for _ in range(500)]
    rows = [(i, some[i % 500]) for i in range(4000)]
    placed = sharding.assign_shards(spark.createDataFrame(rows, DOCS)).groupBy("text_crc32").agg(F.countDistinct("shard").alias("n"))
    assert placed.filter("n > 1").count() == 0


def test_a_group_stays_whole_while_it_fits_a_shard(spark):
    rng = random.Random(11)
    some = [(plain.sentence(rng, 12), share) for share in (0.01, 0.02, 0.05, 0.06, 0.2)]
    rows = [text for text, share in some for _ in range(int(6000 * share))]
    rows = list(enumerate(rows + [plain.sentence(rng, 12) for _ in range(6000 - len(rows))]))
    placed = sharding.assign_shards(spark.createDataFrame(rows, DOCS)).collect()
    sizes = _check_shards(placed, dict(rows), 16)
    assert len(sizes) == 16 and max(sizes.values()) < 1.05 * min(sizes.values())
    shards = defaultdict(set)
    for r in placed:
        shards[dict(rows)[r.doc_id]].add(r.shard)
    assert [len(shards[text]) == 1 for text, _ in some] == [True, True, True, True, False]
    assert all(len(s) == 1 for text, s in shards.items() if text != some[-1][0])


def test_groups_are_parted_where_shards_would_not_come_out_even():
    pieces = {(0, g, t): 10 for g in range(17) for t in range(10)}
    where = sharding.packed(pieces, 16)
    loads = [sum(pieces[p] for p, shard in where.items() if shard == k) for k in range(16)]
    assert max(loads) <= 1.1 * min(loads)
    assert sharding.packed({}, 4) == {}


def test_shards_of_odd_rows(spark):
    odd = spark.createDataFrame([(None, None, 1), (3, "x", 2), (3, "x", 3), (4, "", 4)], "doc_id long, text string, shard int")
    rows = sharding.assign_shards(odd).collect()
    assert sorted(r.size for r in rows) == [1, 1, 2, 2]
    assert sharding.assign_shards(odd.limit(0)).collect() == []


def _edited(texts):
    ids = sorted(texts)
    out = {}
    for k, i in enumerate(ids):
        text, after = texts[i] or "", texts[ids[(k + 1) % len(ids)]] or ""
        cut = len(text) // 4
        out[i] = text[: len(text) - cut] + after[:cut]
    return out


def test_fingerprints(docs, corpus):
    texts = dict(corpus)
    want, rows = _edited(texts), winnowing.fingerprints(docs).collect()
    assert len(rows) == len(corpus)
    prints = defaultdict(set)
    for r in rows:
        assert r.n_chars == len(texts[r.doc_id] or "") and r.edited == want[r.doc_id]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        prints[texts[r.doc_id] or ""].add(r.fingerprint)
        own, edited = plain.winnowed(texts[r.doc_id]), plain.winnowed(r.edited)
        assert (r.fingerprint, r.edited_fingerprint) == (own, edited)
        ids = sorted(texts)
        after = plain.winnowed(texts[ids[(ids.index(r.doc_id) + 1) % len(ids)]])
        assert r.near_edited == pytest.approx(plain.likeness(own, edited)) and r.near_next == pytest.approx(plain.likeness(own, after))
    assert all(len(p) == 1 for p in prints.values())
    long_ = [r for r in rows if r.n_chars > 400 and len(set((texts[r.doc_id]).split())) > 1]
    assert min(r.near_edited for r in long_) > 0.4


def test_shared_runs_share_a_selected_hash(spark):
    rng = random.Random(9)
    run = plain.sentence(rng, winnowing.K + winnowing.W - 1, "abcdef").split()
    run = [w[: winnowing.TOKEN] for w in run]
    rows = [(i, f"{plain.sentence(rng, 40, 'uvwxyz')} {' '.join(run)} {plain.sentence(rng, 40, 'uvwxyz')}") for i in range(20)]
    picked = winnowing.select_grams(spark.createDataFrame(rows, DOCS), "text", "picked").select(winnowing.hashes(F.col("picked")).alias("h")).collect()
    assert set.intersection(*[set(r.h) for r in picked])


@pytest.mark.parametrize("letters, around, n", [("天地人日月山水火木金土", "上下左右大小中", 20), ("กขคงจฉชซ", "ดตถทธน", 20), ("ABCDEFGHIJabcdefghij", "0123456789", 100)])
def test_passages_without_spaces_share_a_selected_hash_at_any_offset(spark, letters, around, n):
    rng = random.Random(10)
    some = lambda k, of: "".join(rng.choice(of) for _ in range(k))
    passage = some(n, letters)
    rows = [(i, some(40 + i, around) + passage + some(40, around)) for i in range(7)]
    picked = winnowing.select_grams(spark.createDataFrame(rows, DOCS), "text", "picked").select(winnowing.hashes(F.col("picked")).alias("h")).collect()
    assert set.intersection(*[set(r.h) for r in picked])


def test_tokens_of_mixed_texts(spark):
    rows = [(1, "information is café"), (2, "information 天地x is"), (3, "b" * 65 + " information")]
    got = [r.t for r in spark.createDataFrame(rows, DOCS).coalesce(1).orderBy("doc_id").select(winnowing._tokens(F.col("text")).alias("t")).collect()]
    assert got == [["inform", "ation", "is", "café"], ["inform", "ation", "天", "地", "x", "is"], ["b"] * 65 + ["inform", "ation"]]


def test_rightmost_of_equal_hashes_is_selected(spark):
    text = " ".join(["tick"] * 30)
    picked = winnowing.select_grams(spark.createDataFrame([(1, text)], DOCS), "text", "p").select(winnowing.fingerprint(F.col("p")).alias("f")).first().f
    positions = [int(x.split(":")[0], 16) for x in picked.split(" ")]
    assert positions == list(range(winnowing.W - 1, 30 - winnowing.K + 1))


def test_fingerprints_of_odd_rows(spark):
    odd = spark.createDataFrame([(None, "abcdefgh", 1), (7, None, 2), (7, "x" * 500, 3), (300, "one", 4), (70_000, "two words", 5)], "doc_id long, text string, near_next int")
    got = {(r.doc_id, r.n_chars): r.edited for r in winnowing.fingerprints(odd).collect()}
    assert got == {(None, 8): "abcdef", (7, 0): "", (7, 500): "x" * 375 + "one", (300, 3): "one", (70_000, 9): "two wor"}
    assert winnowing.fingerprints(odd.limit(0)).collect() == []
    alone = winnowing.fingerprints(odd.filter("doc_id = 300")).first()
    assert alone.edited == "one" and alone.near_next == 1.0


def test_following_ids_over_gaps(spark):
    ids = sorted(random.Random(3).sample(range(-(1 << 40), 1 << 40), 300)) + [1 << 50, (1 << 50) + 1]
    got = {r.id: r.next_id for r in following(spark.createDataFrame([(i,) for i in ids], "id long")).collect()}
    assert got == dict(zip(ids, [*ids[1:], None]))


@pytest.mark.parametrize("parts", [1, 3])
def test_two_bit_sketch_equals_counts(parts):
    """Cells met twice or more are those of a counting sketch, in one task or several, also when keys share bytes and cells."""
    from querylore.llm import sketch as K

    rng = np.random.default_rng(7)
    keys = np.concatenate([rng.integers(0, 1 << 63, 60_000), rng.integers(0, 500, 2_000), np.zeros(5, np.int64)]).astype(np.uint64)
    counts, bits = K.Sketch(K.LEAST_BITS), []
    counts.add(keys)
    for part in np.array_split(keys, parts):
        bits.append(K.Twice(K.LEAST_BITS))
        for batch in [*np.array_split(part, 4), part[:0]]:
            bits[-1].add(batch)
    slices = [b.slices() for b in bits]
    whole = slices[0]
    for other in slices[1:]:
        whole = np.stack([K.Twice.joined(a, b) for a, b in zip(whole, other)])
    both = K.Twice.of(K.LEAST_BITS, whole)
    assert (both.table[1] == np.packbits(counts.table > 1, axis=1)).all() and (both.table[0] == np.packbits(counts.table > 0, axis=1)).all()
