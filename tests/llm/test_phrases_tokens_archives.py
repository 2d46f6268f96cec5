"""Phrases, tokenizer alignment and web archives against plain versions."""

import gzip
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from querylore.llm import align, collocations, warc
from querylore.llm.queries import vocabulary
from querylore.llm.quotient_filter import Packing, QuotientFilter
from tests.llm import plain

FILE_A, FILE_B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


# --- quotient filters and phrases ---------------------------------------------------------------------------------------


def _counts(filter_):
    columns, _, counts = filter_.at_least(1)
    return dict(zip(zip(*[c.tolist() for c in columns]), counts.tolist()))


@pytest.mark.parametrize("n, bits", [(2, 1), (2, 15), (3, 16), (5, 17), (4, 32), (2, 32), (5, 25), (1, 9)])
def test_filters_count_without_loss(n, bits):
    rng = np.random.default_rng(n * bits)
    packing = Packing(n, bits)
    columns = [np.minimum(rng.geometric(0.05, 5000), (1 << bits) - 1) for _ in range(n)]
    limbs = packing.permute(packing.pack(columns))
    assert all((x == y).all() for x, y in zip(columns, packing.unpack(packing.restore(limbs))))
    filter_ = QuotientFilter.count(packing, limbs)
    want = Counter(zip(*[c.tolist() for c in columns]))
    assert _counts(filter_) == want
    assert _counts(QuotientFilter.from_bytes(filter_.to_bytes())) == want
    parts = filter_.ranges(4)
    assert [at for at, _ in parts] == sorted({at for at, _ in parts})
    merged = QuotientFilter.merge([QuotientFilter.from_bytes(p.to_bytes()) for _, p in parts] + [filter_, filter_])
    assert _counts(merged) == {k: 3 * v for k, v in want.items()}


def test_filters_are_small_and_hold_large_counts():
    packing = Packing(2, 16)
    limbs = packing.permute(packing.pack([np.arange(60_000) % 65_536, np.arange(60_000) * 7 % 65_521]))
    assert len(QuotientFilter.count(packing, limbs).to_bytes()) < 5 * 60_000
    heavy = QuotientFilter.count(packing, packing.permute(packing.pack([np.full(3, 9), np.full(3, 8)])), np.array([1 << 40, 254, 3]))
    assert _counts(QuotientFilter.from_bytes(heavy.to_bytes())) == {(9, 8): (1 << 40) + 257}
    nothing = QuotientFilter.count(packing, [np.zeros(0, np.uint64)])
    assert len(QuotientFilter.from_bytes(nothing.to_bytes())) == 0 and nothing.ranges(3) == []


def _texts():
    rng = random.Random(8)
    rows = [(None, "und a b, a b"), ("und", "a b a b"), ("en", None), ("en", ""), ("en", " .,;\n"), ("", "x y x y x y x y"), ("de", "en fr en fr"), ("fr", "en de en de"), ("en", "de fr fr de")]
    hot = "The quick, brown fox: jumps over the lazy dog"
    rows += [("en", hot)] * 40  # a third of all rows
    rows += [(rng.choice(["en", "de", None]), plain.sentence(rng, rng.randint(1, 80), "ab") + rng.choice([". ", "\x0b", "\t", "! ?"]) + plain.sentence(rng, 9, "ab")) for _ in range(70)]
    rows += [("de", "same " * 300), ("de", " ".join("ÄÖ É" for _ in range(30))), ("fr", "x" * 9000 + " y " + "z" * 70_000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shared, held, least, top", [(1000, 1 << 21, 4, 2000), (0, 1 << 21, 4, 2000), (1000, 2000, 3, 7), (1000, 1 << 21, 1, 50)])
def test_phrases_equal_all_ngrams(spark, monkeypatch, shared, held, least, top):
    # ids by a shared table and by a join, tasks that hand on many small filters, cut tops
    monkeypatch.setattr(collocations, "SHARED_WORDS", shared)
    monkeypatch.setattr(collocations, "HELD", held)
    rows = _texts()
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "lang string, text string, n int").repartition(6)
    got = defaultdict(list)
    for r in collocations.collocations(docs, least, top).orderBy("lang", "rank").collect():
        got[r.lang].append((r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score))
    assert dict(got) == plain.phrases(rows, least, top)
    assert any(len(v) > 5 for v in got.values())


def test_phrases_of_odd_tables(spark):
    for rows in ([], [("en", None)], [(None, "one two")], [("en", " . ")]):
        assert collocations.collocations(spark.createDataFrame(rows, "lang string, text string"), 2).count() == 0
    exact = spark.createDataFrame([("en", "a b")] * 100, "lang string, text string")
    assert [tuple(r) for r in collocations.collocations(exact).collect()] == [("en", 1, "a b", 100, 100, 100, 200, 2000)]


# --- alignment ---------------------------------------------------------------------------------------------------------


def _alignable():
    rng = random.Random(4)
    rows = [(1, None), (2, ""), (3, " "), (4, "x "), (5, "a  b"), (6, "▁q r"), (7, "日本語 😀<|endoftext|></s>  \n\n z"), (8, "  "), (8, "  "), (None, "no id"), (9, "\x00\t x y   \n"), (10, "<0x41> ́ é 　")]
    rows += [(100 + i, plain.sentence(rng, rng.randint(1, 60), "abcdefghéß日 -'.")) for i in range(60)]
    rows += [(1000 + i, "Some hot text, isn't it?") for i in range(40)]
    rows += [(2000, "word" * 4000), (2001, "long text of many words " * 1500)]
    return rows


@pytest.mark.parametrize("shared, product", [(1_000_000, 1 << 21), (40, 16)])
def test_alignments_equal_plain_ones(spark, monkeypatch, shared, product):
    # many slices of the pairs, and products in small blocks
    monkeypatch.setattr(align, "SHARED_PAIRS", shared)
    monkeypatch.setattr(align, "PRODUCT", product)
    if product < 100:  # workers have a module of their own: the block size is tested here
        a, b = align._ByteLevel(open(FILE_A, encoding="utf-8").read()), align._SentencePieces(open(FILE_B, "rb").read())
        found = align.Alignment([t or "" for _, t in _alignable()[:60]], a, b)
        small = [np.concatenate(x) for x in zip(*found.links())]
        monkeypatch.setattr(align, "PRODUCT", 1 << 21)
        assert all((x == y).all() for x, y in zip(small, [np.concatenate(x) for x in zip(*found.links())]))
    rows = _alignable()
    tokenizer, pieces = Tokenizer.from_file(FILE_A), sentencepiece.SentencePieceProcessor(model_file=FILE_B)
    tokenizer.encode_special_tokens = True
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_a string").repartition(5)
    got = sorted((tuple(r) for r in align.aligned_documents(docs, FILE_A, FILE_B).collect()), key=repr)
    assert got == plain.alignments(rows, tokenizer, pieces)
    assert sum(r[1] == 0 for r in got) == 3  # null, empty, and a text with the piece's own mark


def test_products_equal_dense_ones():
    rng = np.random.default_rng(2)
    dense = [rng.integers(0, 2, (7, 9)), rng.integers(0, 2, (9, 5))]
    sparse = [align.Csr(np.concatenate([[0], np.cumsum(d.sum(1))]), np.nonzero(d)[1], d.shape[1]) for d in dense]
    got = np.zeros((7, 5), int)
    for begin, block in sparse[0].products(sparse[1]):
        for i in range(block.rows):
            at = slice(block.indptr[i], block.indptr[i + 1])
            got[begin + i, block.indices[at]] = block.values[at]
    assert (got == dense[0] @ dense[1]).all()
    back = sparse[0].transpose()
    assert (np.repeat(np.arange(9), np.diff(back.indptr)) == np.nonzero(dense[0].T)[0]).all() and (back.indices == np.nonzero(dense[0].T)[1]).all()


def test_groups_and_shared_group_links(spark):
    docs = spark.createDataFrame([(1, "Tokenizers disagree about unbelievable words.", "k"), (2, None, "l")], "doc_id long, text string, note string")
    rows = {r.doc_id: r for r in align.align(docs, FILE_A, FILE_B, shared_group=True).collect()}
    sides = [[side.split(",") for side in group.split("|")] for group in rows[1].groups.split(";")]
    assert len(sides) == rows[1].n_groups and sum(len(a) for a, _ in sides) == rows[1].n_a and sum(len(b) for _, b in sides) == rows[1].n_b
    want = Counter((int(a) << 32) + int(b) for own, other in sides for a in own for b in other)
    assert dict(zip(rows[1].pairs, rows[1].times)) == want and rows[1].n_links == sum(want.values())
    assert (rows[2].n_a, rows[2].groups, rows[2].pairs, rows[2].note) == (0, "", [], "l")
    assert align.aligned_documents(docs.limit(0), FILE_A, FILE_B).count() == 0


# --- archives ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("sizes", [[], [0], [5], [0, 3], [4, 4, 4], [1, 0, 9, 2, 30, 7, 1]])
def test_loser_tree_merges(sizes):
    rng = random.Random(sum(sizes))
    runs = [sorted(rng.randint(0, 9) for _ in range(n)) for n in sizes]
    order = list(warc.LoserTree(runs))
    want = sorted((key, run, at) for run, keys in enumerate(runs) for at, key in enumerate(keys))
    assert order == [(run, at) for _, run, at in want]


def test_url_keys():
    keys = {
        "https://www.Example.com:443/a/B?x=1#top": "com,example)/a/B?x=1", "http://u:p@blog.example.co.uk": "uk,co,example,blog)/", "http://example.com?q": "com,example)/?q",
        "not a url": "not a url", None: "", "": "",
    }
    assert {u: warc.url_key(u) for u in keys} == keys


def _pages():
    rng = random.Random(3)
    big, other = "<p>" + "same payload " * 20, "é" * 50
    rows = [(i, f"https://hot.example.com/{i % 2}", big) for i in range(0, 90, 3)]
    rows += [(i, f"http://www.site{rng.randint(1, 9)}.example.org/{rng.randint(1, 3)}#x", plain.sentence(rng, rng.randint(1, 40))) for i in range(1, 120, 3)]
    rows += [(500, None, None), (501, "", ""), (502, "http://x\r\ny/ z", "tiny"), (503, "http://x/", "tiny"), (504, "u", other), (505, "u", other), (505, "u", other), (None, "http://n/", big), (None, "http://n/", "<p>" + "no id " * 30)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("range_rows", [100_000, 7, 1])
def test_archives_round_trip(spark, tmp_path, monkeypatch, range_rows):
    rows = _pages()
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, archive string").repartition(6)
    path = warc.write_archives(pages, str(tmp_path / "w"))
    least = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            least[h] = min(i, least.get(h, i))
    want = []
    for i, u, h in rows:
        data, first = (h or "").encode(), least.get(h)
        revisit = first is not None and i != first
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    table = warc.capture_histories(spark, path, range_rows).orderBy("ordinal").collect()
    assert sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in table), key=repr) == sorted(want, key=repr)
    assert [r.ordinal for r in table] == list(range(len(rows)))
    order = [(r.url_key, r.captured, r.page_id is not None, r.page_id or 0) for r in table]
    assert order == sorted(order)
    seen = Counter()
    for r in table:
        seen[r.url_key] += 1
        assert r.history_no == seen[r.url_key]
    payloads = warc.read_archives(spark, path, payloads=True).collect()
    texts = {i: h for i, _, h in rows}
    assert all((r.payload is None) == (r.record_type == "revisit") for r in payloads)
    assert all(r.payload.decode() == (texts[r.page_id] or "") for r in payloads if r.payload is not None and r.page_id is not None)
    one = next(r for r in table if r.record_type == "response" and r.payload_bytes > 100)
    with open(f"{path}/{one.archive}", "rb") as file:  # any reader of such files finds a record at its offset
        file.seek(one.offset)
        assert gzip.decompress(file.read(one.length)).startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")


def test_archives_of_odd_tables_and_damage(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "x" * 500)], "page_id long, url string, html string")
    none = warc.write_archives(pages.limit(0), str(tmp_path / "none"))
    assert warc.capture_histories(spark, none).count() == 0
    times = F.to_timestamp(F.lit("2024-02-29 10:11:12.123456"))
    path = warc.write_archives(pages, str(tmp_path / "one"), times)
    row = warc.capture_histories(spark, path).select(F.date_format("captured", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("t"), "archive").first()
    assert row.t == "2024-02-29 10:11:12.123456"
    content = warc.record({"page_id": 1, "url": None, "captured": 0, "record_type": "response", "refers_to": None, "payload_bytes": 3, "payload_digest": hashlib.sha256(b"abc").hexdigest(), "payload": b"abc"})
    assert warc.parse(content)[1] == b"abc"
    with pytest.raises(ValueError):
        warc.parse(content.replace(b"abc", b"abd"))
    with pytest.raises(ValueError):
        list(warc.members(gzip.compress(content)[:-9]))
