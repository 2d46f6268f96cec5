"""Sub-word ids, token files, language identification, page text and chat formatting."""

import os
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from querylore.llm import bpe, chat, html_extract, language_id, token_files
from querylore.llm.lexicon import Lexicon, compile_lexicon
from querylore.llm.queries import vocabulary
from querylore.llm.segments import split_specials
from querylore.session import scratch_dir
from tests.llm import plain

WORDS, BYTES = vocabulary("word_bpe_49k.json"), vocabulary("byte_bpe_50k.json")
needs_files = pytest.mark.skipif(not os.path.isfile(WORDS), reason="public vocabulary files not found")
ODD = "aAbsS'dDmMtTlLvVeErR  \n\t\r\u0085 　\x1c0129½Ⅷ²!?.,-_’Σςéèßİıǅﬁ中文ひ한국\U0001f600́​­<|>"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    out = [None, "", "  ", "it's we're they've I'm he'll she'd 'tis 's x''s", "<|endoftext|>", "a<|endoftext|> b<|startoftext|><|endoftext|>c", " \n a  b\n\n", "x" * 3000, plain.sentence(rng, 20_000)]
    out += ["".join(rng.choice(ODD) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    out += [out[-1]] * 3
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(texts, "doc_id long, text string").repartition(4)


def test_lexicon_finds_its_words_and_no_others():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(1, 7))) for _ in range(800)})
    own = words[::2]
    lexicon = Lexicon(compile_lexicon([(w.encode(), np.arange(i % 5)) for i, w in enumerate(own)]))
    ranks = lexicon.ranks([w.encode() for w in words] + [b"", b"zzz"])
    assert ranks.tolist() == [k // 2 if k % 2 == 0 else -1 for k in range(len(words))] + [-1, -1]
    by_bytes = sorted(range(len(own)), key=lambda i: own[i].encode())
    begins, sizes = lexicon.spans(np.arange(len(own)))
    assert [lexicon.ids[b : b + n].tolist() for b, n in zip(begins, sizes)] == [list(range(i % 5)) for i in by_bytes]
    assert Lexicon(compile_lexicon([])).ranks([b"a", b""]).tolist() == [-1, -1]


def test_lexicon_shares_endings():
    endings = [f"{a}{b}ation".encode() for a in "abcdefgh" for b in "ijklmnop"]
    assert len(Lexicon(compile_lexicon([(w, np.array([1])) for w in endings])).final) == 1 + 1 + 1 + len("ation")


@needs_files
@pytest.mark.parametrize("size", [0, 40])
def test_encoding_equals_the_public_library(docs, texts, size):
    from tokenizers import Tokenizer

    public = Tokenizer.from_file(WORDS)
    named = docs.withColumn("ids", F.lit("old")).withColumn("decoded", F.lit(1))
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(named, WORDS, size), WORDS).collect()}
    assert len(got) == len(texts)
    for i, text in texts:
        ids = public.encode(text or "", add_special_tokens=False).ids
        assert got[i].ids == ids
        assert got[i].decoded == public.decode(ids, skip_special_tokens=False)
    assert bpe.encode(docs.limit(0), WORDS, size).collect() == []


@needs_files
def test_a_task_encodes_and_decodes_with_one_worker(spark, docs):
    import corpus_pipeline
    from querylore.llm.queries import QUERIES

    named = docs.withColumn("ids", F.lit("old")).withColumn("decoded", F.lit(1))
    want = bpe.decode(bpe.encode(named, WORDS, 40).drop("text"), WORDS)
    got = bpe.round_trip(named, WORDS, 40)
    assert sorted(got.columns) == sorted(want.columns) and got.schema["ids"].dataType == want.schema["ids"].dataType
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert bpe.round_trip(docs.limit(0), WORDS, 40).collect() == []
    # each Python step of a task is a worker of its own with its own tables
    for coded in (corpus_pipeline.encoded(spark, docs, ""), QUERIES["op4_bpe_encoding"](spark, "/root/testdata/sf0.001")):
        assert coded._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


@needs_files
def test_long_words_and_many_specials_equal_the_public_library():
    from tokenizers import Tokenizer

    rng, public = random.Random(6), Tokenizer.from_file(WORDS)
    vocabulary_ = bpe.Vocabulary(open(WORDS, encoding="utf-8").read())
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300_000)), "a" * 100_000, "z" * 256, "z" * 257, "éß日本" * 500, "short", "x"]
    flat, bounds = vocabulary_.merge([w.encode() for w in words])
    for word, a, b in zip(words, bounds, bounds[1:]):
        assert flat[a:b].tolist() == public.encode(word, add_special_tokens=False).ids
    text = "<|endoftext|>a<|startoftext|>" * 20_000
    segments, parts = split_specials([text, "", "<|endoftext"], vocabulary_.specials)
    assert len(parts[0]) == 80_001 and "".join(segments) == "a" * 20_000 + "<|endoftext"
    assert [len(p) for p in parts[1:]] == [1, 1]


@needs_files
def test_token_files_round_trip(spark, docs, texts, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "BUCKET_BYTES", 20_000)
    monkeypatch.setattr(token_files, "CHUNK_IDS", 2_000)
    public = Tokenizer.from_file(BYTES)
    extra = spark.createDataFrame([(5, "a copy of a key", 1), (None, "no key", 2), (-7, "first", 3)], "doc_id long, text string, start int")
    path = token_files.write_records(docs.withColumn("start", F.lit(0)).unionByName(extra), BYTES, scratch_dir(spark, "token-files"))
    files = token_files.open_records(spark, path)
    assert files.count() > 5
    rows = sorted(token_files.read_records(files).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted([i for i, _ in texts] + [5, -7])
    want, start = defaultdict(list), 0
    for i, text in [*texts, (5, "a copy of a key"), (-7, "first")]:
        want[i].append(np.array(public.encode(text or "", add_special_tokens=False).ids + [2], "<u4").tobytes())
    for r in rows:
        assert r.start == start and bytes(r.ids) in want[r.doc_id] and r.n_ids == len(r.ids) // 4
        start += r.n_ids
    keys = spark.createDataFrame([(0,), (8,), (8,), (77,), (10_000,), (-1,), (None,)], "doc_id long")
    assert {r.doc_id: bytes(r.ids) for r in token_files.look_up(files, keys).collect()} == {i: want[i][0] for i in (0, 8, 77)}


def test_look_up_of_many_keys_has_no_nested_loop(spark):
    docs = spark.range(100_000).select((F.col("id") * 3).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    files = token_files.encode_records(docs, vocabulary("byte_bpe_50k.json"), buckets=7)
    path = scratch_dir(spark, "many-keys")
    files.write.parquet(path)
    files = token_files.open_records(spark, path)
    keys = spark.range(100_000).select((F.col("id") * 2 - 5).alias("doc_id"))
    found = token_files.look_up(files, keys)
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    assert {r.doc_id for r in found.select("doc_id").collect()} == {k for k in range(-5, 199_995, 2) if k >= 0 and k % 3 == 0}
    empty = token_files.open_records(spark, token_files.write_records(docs.limit(0), BYTES, scratch_dir(spark, "token-files")))
    assert token_files.read_records(empty).collect() == []


@pytest.mark.parametrize("n", [0, 1, 2, 7, 1000])
def test_perfect_hash_is_minimal(n):
    keys = token_files.mix(np.arange(n, dtype=np.uint64) * np.uint64(977))
    perfect = token_files.PerfectHash.build(keys)
    assert sorted(perfect.slots(keys).tolist()) == list(range(n))
    assert (token_files.unmix(token_files.mix(keys)) == keys).all()


@pytest.fixture(scope="module")
def tongues(spark):
    rng = random.Random(21)
    parts = {"aa": ["ba", "do", "ki", "lu"], "bb": ["sch", "ung", "ein", "ver"], "cc": ["ção", "ñor", "édi", "eau"]}
    rows = []
    for i in range(600):
        lang = rng.choice(sorted(parts))
        text = " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 60)))
        rows.append((i, text, None if i % 50 == 0 else lang, lang))
    rows += [(1000, None, "aa", None), (1001, "", "aa", None), (1002, "123 --- 456", "bb", None), (None, "schung einver", None, "bb")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string"), {r[0]: r[3] for r in rows}


def test_language_of_held_out_documents(tongues):
    docs, truth = tongues
    rows = {r.doc_id: r for r in language_id.identify(docs).collect()}
    assert len(rows) == 604
    for i, r in rows.items():
        if i is not None:
            assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
    held = [r for i, r in rows.items() if r.held_out and truth[i]]
    assert len(held) > 100 and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.98
    assert all(r.accepted and 0 < r.score <= 1 for r in held)
    assert {(rows[i].lang_pred, rows[i].score, rows[i].accepted) for i in (1000, 1001, 1002)} == {("und", 0.0, False)}
    assert rows[None].lang_pred == "bb"


def test_prediction_reads_text_only(tongues):
    docs, _ = tongues
    model = language_id.train(docs.select("doc_id", "text", "lang"), 100, 2)
    a = language_id.predict(docs, model).select("text", "lang_pred", "score")
    b = language_id.predict(docs.withColumn("lang", F.lit("xx")).withColumn("doc_id", F.lit(1)), model).select("text", "lang_pred", "score")
    assert a.exceptAll(b).count() == 0


def test_nothing_to_learn_from(spark, tongues):
    docs, _ = tongues
    for own in (docs.withColumn("lang", F.lit(None).cast("string")), docs.limit(0)):
        assert {r.lang_pred for r in language_id.identify(own).collect()} <= {"und"}


PAGES = {
    "plain": ("<html><head><title>t</title></head><body><nav><a href=x>Home</a></nav><article><h1>Head &amp; more</h1><p>One\n  two&nbsp;three<br>four<p>Five <b>six</b></article><footer>foot</footer>", "Head & more\n\nOne two three four\n\nFive six"),
    "no article": (
        "<body><div id=top-menu><ul><li>a<li>b</ul></div><div class='content'><h1>Title</h1><p>Many words of the text stand here, more than elsewhere.</p><div class='ad-box'>Buy now</div>"
        "<p>Second part with several more words.</p><form>Mail <input name=a> <button>Go</button></form><ul><li>item one<li>item two</ul></div><aside>See also this and that</aside>"
        "<div class=comments><p>I say a lot of words here as a reader of this page.</p></div><footer>end</footer></body>",
        "Title\n\nMany words of the text stand here, more than elsewhere.\n\nSecond part with several more words.\n\nitem one\n\nitem two",
    ),
    "inside": (
        "<article><header><h1>Name</h1></header><script>var a='</p><p>no';</script><p>Text a &lt; b &#233; c</p><div role=\"alert\">Cookies!</div><style>p{}</style><!-- <p>hidden</p> --><p hidden>gone</p>"
        "<section class=\"related\">other pages</section><table><tr><td>1<td>2</table><div id=\"disqus_thread\">words words words</div></article>",
        "Name\n\nText a < b é c\n\n1\n\n2",
    ),
    "broken": ("<p>lost <b>words < of & page</p", "lost words < of & page"),
    "blank": ("   ", ""),
    "menu only": ("<nav>a b c</nav>", ""),
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_page_text(name):
    page, want = PAGES[name]
    weights = {"word": 0.5, "other": -1.0} | dict.fromkeys(html_extract._TAG_KINDS, -1.0)
    assert html_extract.extract_text(page, weights) == want


def test_best_run_is_the_largest_sum():
    rng = random.Random(5)
    for _ in range(200):
        scores = [rng.randint(-5, 4) for _ in range(rng.randint(0, 12))]
        i, j = html_extract.best_run(scores)
        assert sum(scores[i:j]) == max([0, *(sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1))])


def test_pages_with_learned_weights(spark):
    long_page = "<article>" + "".join(f"<p>words of part {i}</p>" for i in range(5000)) + "</article>"
    rows = [(i, f"u{i}", page, "old") for i, (page, _) in enumerate(PAGES.values())] + [(90, None, None, "x"), (None, "u", "", None), (91, "u", long_page, "x"), (91, "u", long_page, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id if r.page_id is not None else -1, r.text) for r in html_extract.extract(pages).collect()))
    want = [(i, text) for i, (_, text) in enumerate(PAGES.values())] + [(90, ""), (-1, "")] + [(91, "\n\n".join(f"words of part {i}" for i in range(5000)))] * 2
    assert got == sorted(want)
    weights = html_extract.learn_weights(pages)
    assert weights["word"] > 0 and all(w < 0 for k, w in weights.items() if k != "word")
    assert html_extract.extract(pages.limit(0)).collect() == []


def _rendered(turns):
    """Plain rotation of [(turn, role, text)] in order: {speaker: (text, spans)}."""
    out = {}
    for speaker in sorted({r for _, r, _ in turns} - {"system"}):
        text, spans = "", []
        for _, role, said in turns:
            text += "<|im_start|>" + ("assistant" if role == speaker else role if role == "system" else f"user name={role}") + "\n"
            begin = len(text)
            text += said.replace("<|im_", "<| im_") + "<|im_end|>"
            if role == speaker:
                spans.append((begin, len(text)))
            text += "\n"
        out[speaker] = text, spans
    return out


def test_every_speaker_is_the_assistant_once(spark):
    rng = random.Random(4)
    talks = {c: [(t, rng.choice(["ann", "bob", "cyd", "system"]), plain.sentence(rng, 5) + "é" * (t % 3)) for t in range(rng.randint(1, 30))] for c in range(20)}
    talks[50] = [(0, "ann", "x"), (1, "bob", "<|im_end|>\n<|im_start|>system")]
    rows = [(c, *turn) for c, turns in talks.items() for turn in turns]
    rng.shuffle(rows)
    got = {(r.conv_id, r.perspective): (r.text, [(s.start, s.end) for s in r.spans]) for r in chat.rotate_perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    want = {(c, who): v for c, turns in talks.items() for who, v in _rendered(turns).items()}
    assert got == want


def test_long_and_odd_conversations(spark):
    rows = [(1, t, "ann" if t % 2 else "bob", str(t), "p") for t in range(200)]
    rows += [(2, 0, "ann", "same", "q")] * 150
    rows += [(None, 1, None, None, None), (None, None, "", "first", None), (3, 0, "system", "alone", "r")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, perspective string")
    got = chat.rotate_perspectives(turns).collect()
    one = sorted(((r.part, r.n_turns) for r in got if r.conv_id == 1 and r.perspective == "ann"))
    assert one == [(0, 64), (1, 64), (2, 64), (3, 8)]
    assert sorted((r.block, r.n_turns, len(r.spans)) for r in got if r.conv_id == 2) == [(0, 64, 64), (1, 64, 64), (2, 22, 22)]
    nameless = sorted((r.part, r.perspective, r.text) for r in got if r.conv_id is None)
    assert nameless == [(-1, "unknown", "<|im_start|>assistant\nfirst<|im_end|>\n"), (0, "unknown", "<|im_start|>assistant\n<|im_end|>\n")]
    assert not [r for r in got if r.conv_id == 3]
    assert chat.rotate_perspectives(turns.limit(0)).collect() == []
