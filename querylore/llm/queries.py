"""The registered queries of this package: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querylore.llm import align as A
from querylore.llm import bpe as B
from querylore.llm import chat as C
from querylore.llm import collocations as P
from querylore.llm import decontaminate as D
from querylore.llm import html_extract as X
from querylore.llm import language_id as L
from querylore.llm import ngram_join as N
from querylore.llm import sharding as H
from querylore.llm import substring_dedup as S
from querylore.llm import token_files as T
from querylore.llm import warc as R
from querylore.llm import winnowing as W
from querylore.llm.common import text_batches
from querylore.session import scratch_dir


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file; TOKENIZER_DIR names another folder than the installed package's."""
    folder = os.environ.get("TOKENIZER_DIR")
    if not folder:
        found = importlib.util.find_spec("public_tokenizers")
        folder = os.path.dirname(found.origin) if found else "/opt/tokenizers"
    return os.path.join(folder, name)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    text_batches(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return N.ngram_jaccard_join(_table(spark, folder, "documents").select("doc_id", "text"))


def op2_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = H.assign_shards(_table(spark, folder, "documents").select("doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = S.remove_repeated_windows(_table(spark, folder, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_bpe_encoding(spark: SparkSession, folder: str) -> DataFrame:
    coded = B.round_trip(_table(spark, folder, "documents").select("doc_id", "text"), vocabulary("word_bpe_49k.json"))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    rows = C.rotate_perspectives(_table(spark, folder, "conversations"))
    mask = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return rows.select("conv_id", "perspective", "part", "block", "n_turns", "text", mask.alias("mask"))


def op6_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    rows = W.fingerprints(_table(spark, folder, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op7_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return X.extract(_table(spark, folder, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op8_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = T.write_records(_table(spark, folder, "documents").select("doc_id", "text"), vocabulary("byte_bpe_50k.json"), scratch_dir(spark, "token-files"))
    return T.read_records(T.open_records(spark, path)).select("doc_id", "start", F.col("n_ids").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return L.identify(_table(spark, folder, "documents").select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")


def op10_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return D.contained_items(_table(spark, folder, "documents").select("doc_id", "text"), _table(spark, folder, "benchmark"))


def op11_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return P.collocations(_table(spark, folder, "documents").select("text", "lang"))


def op12_cross_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return A.aligned_documents(docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op13_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = R.write_archives(_table(spark, folder, "pages").select("page_id", "url", "html"), scratch_dir(spark, "archives"))
    return R.capture_histories(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "history_no")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_sharding": op2_sharding,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_bpe_encoding": op4_bpe_encoding,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_document_fingerprints": op6_document_fingerprints,
    "op7_html_extraction": op7_html_extraction,
    "op8_token_files": op8_token_files,
    "op9_language_id": op9_language_id,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_cross_tokenizer_alignment": op12_cross_tokenizer_alignment,
    "op13_warc": op13_warc,
}

_WORDS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

_CHAT = """WITH r AS (SELECT conv_id, turn, turn // 64 AS part, CASE WHEN role <> '' THEN role ELSE 'unknown' END AS role,
  replace(coalesce(text, ''), '<|im_', '<| im_') || '<|im_end|>' AS said FROM conversations),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id, part ORDER BY turn, role, said) AS place FROM r),
s AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
m AS (SELECT t.conv_id, perspective, part, (place - 1) // 64 AS block, place, role = perspective AS own, said, '<|im_start|>' || CASE WHEN role = perspective THEN 'assistant'
  WHEN role = 'system' THEN role ELSE 'user name=' || role END || chr(10) AS head FROM t JOIN s ON t.conv_id = s.conv_id),
p AS (SELECT *, sum(length(head) + length(said) + 1) OVER (PARTITION BY conv_id, perspective, part, block ORDER BY place) - 1 AS stop FROM m)
SELECT conv_id, perspective, part, block, count(*) AS n_turns, string_agg(head || said || chr(10), '' ORDER BY place) AS text,
  coalesce(string_agg((stop - length(said))::BIGINT || '-' || stop::BIGINT, ',' ORDER BY place) FILTER (WHERE own), '') AS mask
FROM p GROUP BY conv_id, perspective, part, block"""

_LEAKS = f"""WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents), iw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
z AS (SELECT DISTINCT least(len(w), 5) AS j FROM iw WHERE len(w) > 0),
dl AS (SELECT doc_id, w, j, unnest(range(1, len(w) - j + 2)) AS k FROM dw, z WHERE len(w) >= j),
il AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM iw WHERE len(w) > 0),
d AS (SELECT DISTINCT doc_id, list_slice(w, k, k + j - 1) AS s FROM dl), i AS (SELECT DISTINCT item_id, list_slice(w, k, k + 4) AS s FROM il),
n AS (SELECT item_id, count(*) AS n FROM i GROUP BY 1)
SELECT doc_id, item_id, n AS item_shingles, count(*) AS shared_shingles, count(*) / n AS containment
FROM d JOIN i USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n HAVING 100 * count(*) >= 80 * n"""

_SPLIT = r"list_filter(string_split_regex({0}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"

_LINKS = f"""WITH RECURSIVE d AS (SELECT doc_id, {_SPLIT.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
k AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM d WHERE len(w) > 0),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(list_slice(w, k, k + 4), ' ') AS s FROM k),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b, shared = x.n AND shared = y.n AS same FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
r AS (SELECT doc_id AS a, doc_id AS c FROM d UNION SELECT l.a, r.c FROM r JOIN l ON l.b = r.a),
m AS (SELECT a, min(c) AS component_id FROM r GROUP BY a), e AS (SELECT a, min(b) FILTER (WHERE same) AS b, count(*) AS n_links FROM l GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(e.b, d.doc_id)) AS class_id, m.component_id, coalesce(n_links, 0) AS n_links
FROM d JOIN m ON m.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN e ON e.a = d.doc_id"""

_CUT = f"""WITH d AS (SELECT doc_id, {_SPLIT.format("coalesce(text, '')")} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM d WHERE len(w) >= 50),
h AS MATERIALIZED (SELECT doc_id, k, md5(array_to_string(list_slice(w, k, k + 49), ' ')) AS h FROM p),
m AS (SELECT h, min(doc_id) AS first FROM h GROUP BY h),
c AS (SELECT DISTINCT doc_id, unnest(range(k, k + 50)) AS k FROM h JOIN m ON h.h = m.h WHERE first < doc_id),
u AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d WHERE len(w) > 0),
g AS (SELECT u.doc_id, count(c.k) AS n_removed, string_agg(word, ' ' ORDER BY u.k) FILTER (WHERE c.k IS NULL) AS kept FROM u LEFT JOIN c ON u.doc_id = c.doc_id AND u.k = c.k GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g ON d.doc_id = g.doc_id"""

_PHRASES = r"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS t FROM d),
w AS MATERIALIZED (SELECT lang, list_filter(string_split_regex(t, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, w, j, unnest(range(1, len(w) - j + 2)) AS k FROM w, (SELECT unnest(range(1, 6)) AS j) WHERE len(w) >= j),
f AS MATERIALIZED (SELECT lang, list_slice(w, k, k + j - 1) AS s, count(*) AS f FROM g GROUP BY 1, 2 HAVING count(*) >= 100),
i AS (SELECT lang, s, f, unnest(range(2, len(s))) AS j FROM f WHERE len(s) > 2),
b AS (SELECT lang, s, f, j, unnest(range(1, len(s) - j + 2)) AS k FROM i),
o AS (SELECT lang, list_slice(s, k, k + j - 1) AS s, max(f) AS f FROM b GROUP BY 1, 2),
c AS (SELECT f.lang, f.s, f.f AS a, unnest(range(1, len(f.s))) AS k FROM f LEFT JOIN o ON o.lang = f.lang AND o.s = f.s WHERE len(f.s) > 1 AND (o.f IS NULL OR 100 * o.f < 100 * f.f)),
x AS (SELECT c.lang, c.s, a, k, l.f AS l, r.f AS r, n, ((1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f))::BIGINT AS score FROM c JOIN n ON n.lang = c.lang
  JOIN f l ON l.lang = c.lang AND l.s = list_slice(c.s, 1, k) JOIN f r ON r.lang = c.lang AND r.s = list_slice(c.s, k + 1, len(c.s))),
y AS (SELECT *, array_to_string(s, ' ') AS phrase FROM x QUALIFY row_number() OVER (PARTITION BY lang, s ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM y
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000"""

_CAPTURES = r"""WITH p AS (SELECT page_id, url, coalesce(html, '') AS h, sha256(coalesce(html, '')) AS d FROM pages),
o AS (SELECT d, min(page_id) AS least FROM p WHERE octet_length(encode(h)) >= 100 GROUP BY d),
u AS (SELECT *, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)([^#]*)', ['host', 'path']) AS x FROM p),
k AS (SELECT *, regexp_replace(lower(regexp_replace(regexp_replace(x.host, '^.*@', ''), ':[0-9]*$', '')), '^www\.', '') AS host,
  CASE WHEN starts_with(x.path, '/') THEN '' ELSE '/' END || x.path AS rest, regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.\-]*://') AS is_url FROM u),
n AS (SELECT *, CASE WHEN is_url THEN array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || rest ELSE coalesce(url, '') END AS url_key FROM k)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, n.d AS payload_digest, CASE WHEN least < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN least < page_id THEN least END AS refers_to, url_key, row_number() OVER (PARTITION BY url_key ORDER BY page_id % 4294967296, page_id) AS history_no
FROM n LEFT JOIN o ON n.d = o.d"""

SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": _LINKS,
    "op3_substring_dedup": _CUT,
    "op5_chat_formatting": _CHAT,
    "op10_benchmark_decontamination": _LEAKS,
    "op11_phrase_collocations": _PHRASES,
    "op13_warc": _CAPTURES,
}
