"""Retrieval and its DuckDB twins."""

from pyspark.sql import functions as F

from querylore.operators import catalog as C
from querylore.operators import cells as L
from querylore.operators import retrieval as R
from querylore.plans.catalog import DOC_SQL, _documents
from querylore.plans.query_log import UNIQUE, unique
from querylore.plans.registry import plan
from querylore.session import scratch_dir

DOT = "list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[]))"
CHUNKS = "ch AS MATERIALIZED (SELECT chunk_id, kb_type, label, embedding, content, md5(content) AS content_hash FROM kb_chunk)"
SCORES = f"""{CHUNKS}, sc AS (SELECT q.query_id, q.strategy, q.strategy_no, q.variant_no, q.kb_type AS q_kb, q.label AS q_label, c.chunk_id, c.kb_type, c.label, c.content_hash, {DOT} AS score
  FROM query_variant q CROSS JOIN ch c)"""


def _top(k: int) -> str:
    return f"""{SCORES}, tk AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, strategy_no, variant_no ORDER BY score DESC, chunk_id) AS INT) AS rank FROM sc
  QUALIFY rank <= {k})"""


def _dedup(source: str, name: str, n: int, extra: str) -> str:
    """Best row per content with the first position, then the best n."""
    return f"""{name}_b AS (SELECT *, min(position) OVER (PARTITION BY query_id, content_hash) AS first_position FROM {source}
  QUALIFY row_number() OVER (PARTITION BY query_id, content_hash ORDER BY score DESC, position) = 1),
{name}_c AS (SELECT query_id, content_hash, chunk_id, score, {extra}, first_position,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_position) AS INT) AS place FROM {name}_b),
{name} AS (SELECT * EXCLUDE (place), place AS rank FROM {name}_c WHERE place <= {n})"""


def _multi(per: int) -> str:
    return f"""{_top(per)},
ex_in AS (SELECT *, variant_no * 4294967296 + rank AS position, variant_no AS from_variant FROM tk WHERE strategy = 'expansion'),
{_dedup("ex_in", "ex", per, "from_variant")},
hy AS (SELECT query_id, content_hash, chunk_id, score, rank FROM tk WHERE strategy = 'hyde' UNION ALL
  SELECT query_id, content_hash, chunk_id, score, rank FROM tk WHERE strategy = 'standard' AND query_id NOT IN (SELECT query_id FROM tk WHERE strategy = 'hyde')),
jt AS (SELECT query_id, content_hash, chunk_id, score, rank AS position, 'standard' AS strategy FROM tk WHERE strategy = 'standard'
  UNION ALL SELECT query_id, content_hash, chunk_id, score, 4503599627370496 + rank, 'expansion' FROM ex
  UNION ALL SELECT query_id, content_hash, chunk_id, score, 2 * 4503599627370496 + rank, 'hyde' FROM hy)"""


def _rounded(df, *columns):
    return df.select(*columns, F.round("score", 6).alias("score"))


def _standard(t):
    return t.query_variant.filter(F.col("strategy") == "standard")


@plan("r01_top_k", f"WITH {_top(5)} SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM tk WHERE strategy = 'standard'")
def _(t):
    return _rounded(R.top_k(_standard(t), t.kb_chunk, 5), "query_id", "chunk_id", "rank")


@plan("r02_top_k_of_source", f"""WITH {SCORES}, f AS (SELECT * FROM sc WHERE strategy = 'standard' AND q_kb = kb_type),
tk AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM f QUALIFY rank <= 5)
SELECT query_id, kb_type, chunk_id, rank, round(score, 6) AS score FROM tk""")
def _(t):
    return _rounded(R.top_k(_standard(t), t.kb_chunk, 5, ("query_id", "kb_type"), by="kb_type"), "query_id", "kb_type", "chunk_id", "rank")


def _cells(t):
    return L.CellTable(t.spark, L.write_cells(t.kb_chunk.select("chunk_id", "embedding", "kb_type"), scratch_dir(t.spark, "cells")))


@plan("r01_top_k_by_cells", f"WITH {_top(5)} SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM tk WHERE strategy = 'standard'")
def _(t):
    return _rounded(L.cell_top_k(_standard(t), _cells(t), 5), "query_id", "chunk_id", "rank")


@plan("r02_top_k_of_source_by_cells", f"""WITH {SCORES}, f AS (SELECT * FROM sc WHERE strategy = 'standard' AND q_kb = kb_type),
tk AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM f QUALIFY rank <= 5)
SELECT query_id, kb_type, chunk_id, rank, round(score, 6) AS score FROM tk""")
def _(t):
    return _rounded(L.cell_top_k(_standard(t), _cells(t), 5, ("query_id", "kb_type"), by="kb_type"), "query_id", "kb_type", "chunk_id", "rank")


@plan("r03_content_sample", "SELECT chunk_id, CASE WHEN content = '' THEN '' ELSE left(content, 500) || '...' END AS content_sample FROM kb_chunk")
def _(t):
    return t.kb_chunk.select("chunk_id", R.content_sample(F.col("content")).alias("content_sample"))


@plan("r04_expansion", f"""WITH {_top(5)}, ex_in AS (SELECT *, variant_no * 4294967296 + rank AS position, variant_no AS from_variant FROM tk WHERE strategy = 'expansion'),
{_dedup("ex_in", "ex", 5, "from_variant")} SELECT query_id, chunk_id, from_variant, rank, round(score, 6) AS score FROM ex""")
def _(t):
    found = R.search_variants(t.query_variant.filter(F.col("strategy") == "expansion"), t.kb_chunk, 5)
    return _rounded(R.expansion(found, 5), "query_id", "chunk_id", "from_variant", "rank")


@plan("r05_variant_list", r"""WITH l AS (SELECT doc_id, source || ' ' || lang AS original,
  list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS lines FROM documents),
v AS (SELECT doc_id, CASE WHEN list_contains(lines, original) THEN lines ELSE list_append(lines, original) END AS lines FROM l)
SELECT doc_id, CAST(unnest(range(len(lines))) AS INT) AS variant_no, unnest(lines) AS variant FROM v""")
def _(t):
    variants = R.variant_list(F.col("text"), F.concat("source", F.lit(" "), "lang"))
    return t.documents.select("doc_id", F.posexplode(variants).alias("variant_no", "variant"))


@plan("r06_hyde", f"WITH {_multi(5)} SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM hy")
def _(t):
    found = R.search_variants(t.query_variant.filter(F.col("strategy").isin("standard", "hyde")), t.kb_chunk, 5)
    return _rounded(R.with_hyde_fallback(found), "query_id", "chunk_id", "rank")


@plan("r07_multi_strategy", f"WITH {_multi(2)}, {_dedup('jt', 'ms', 8, 'strategy')} SELECT query_id, chunk_id, strategy, rank, round(score, 6) AS score FROM ms")
def _(t):
    return _rounded(R.multi_strategy(t.query_variant, t.kb_chunk, 8), "query_id", "chunk_id", "strategy", "rank")


_FIXED = ", ".join(f"({i}, '{x}')" for i, x in enumerate(R.RELATIONSHIP_TEXTS))
_TERMS = r"list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+'))"


@plan("r08_relationship_search", f"""{DOC_SQL}, w AS MATERIALIZED (SELECT tenant, table_name AS doc, md5(content) AS content_hash, {_TERMS.format("content")} AS words FROM docs),
qs AS (SELECT d.tenant, d.doc AS asked, v.i AS question_no, {_TERMS.format("replace(v.x, '{}', d.doc)")} AS q FROM w d CROSS JOIN (VALUES {_FIXED}) AS v(i, x)),
sc AS (SELECT q.tenant, q.asked, q.question_no, w.doc, w.content_hash, len(list_intersect(q.q, w.words))::DOUBLE / len(q.q) AS score FROM qs q JOIN w ON q.tenant = w.tenant),
tk AS (SELECT *, row_number() OVER (PARTITION BY tenant, asked, question_no ORDER BY score DESC, doc) AS rank FROM sc QUALIFY rank <= 3),
ps AS (SELECT *, question_no * 4294967296 + rank AS position FROM tk),
b AS (SELECT *, min(position) OVER (PARTITION BY tenant, asked, content_hash) AS first_position FROM ps
  QUALIFY row_number() OVER (PARTITION BY tenant, asked, content_hash ORDER BY score DESC, position) = 1),
f AS (SELECT *, CAST(row_number() OVER (PARTITION BY tenant, asked ORDER BY score DESC, first_position) AS INT) AS r FROM b)
SELECT tenant, asked, doc, question_no, r AS rank, round(score, 6) AS score FROM f WHERE r <= 10""")
def _(t):
    return _rounded(R.relationship_search(C.table_documents(_documents(t)), C.base_tables(t.cat_table)), "tenant", "asked", "doc", "question_no", "rank")


def distinct_documents(t):
    """Table documents of all tenants, each content once."""
    docs = C.table_documents(_documents(t)).withColumn("content_hash", F.md5("content"))
    # sixty bits of the hash serve as the number of a content
    number = F.conv(F.left("content_hash", F.lit(15)), 16, 10).cast("bigint")
    return docs.groupBy("content_hash").agg(F.min("content").alias("content")).withColumn("chunk_id", number)


_STATEMENT = ", ".join(f"replace('{x}', '{{}}', m)" for x in R.STATEMENT_TABLE_TEXTS)


@plan("r09_statement_search", rf"""{DOC_SQL}, {UNIQUE},
dd AS MATERIALIZED (SELECT content_hash, CAST('0x' || left(content_hash, 15) AS BIGINT) AS chunk_id, {_TERMS.format("content")} AS words FROM (SELECT DISTINCT md5(content) AS content_hash, content FROM docs)),
m AS (SELECT query_id, sql, flatten(list_transform(regexp_extract_all(sql, '(?i)(?:FROM|JOIN)\s+(\w+)', 1), lambda m: [{_STATEMENT}])) AS texts FROM uq),
q0 AS (SELECT query_id, list_append(texts, 'SQL query optimization for: ' || left(sql, 100) || '...') AS texts, len(texts) AS last FROM m),
q1 AS (SELECT query_id, last, unnest(range(len(texts))) AS question_no, unnest(texts) AS x FROM q0),
q2 AS (SELECT query_id, question_no, CASE WHEN question_no = last THEN 5 ELSE 3 END AS k, {_TERMS.format("x")} AS q FROM q1),
sc AS (SELECT query_id, question_no, k, chunk_id, content_hash, len(list_intersect(q, words))::DOUBLE / len(q) AS score FROM q2 CROSS JOIN dd),
tk AS (SELECT *, row_number() OVER (PARTITION BY query_id, question_no ORDER BY score DESC, chunk_id) AS rank FROM sc QUALIFY rank <= k),
ps AS (SELECT *, question_no * 4294967296 + rank AS position FROM tk), {_dedup("ps", "fin", 10, "question_no")}
SELECT query_id, chunk_id, CAST(question_no AS INT) AS question_no, rank, round(score, 6) AS score FROM fin""")
def _(t):
    return _rounded(R.statement_search(unique(t), distinct_documents(t)), "query_id", "chunk_id", "question_no", "rank")


@plan("r10_content_dedup", f"""WITH {_top(5)}, p AS (SELECT *, strategy_no * 4503599627370496 + variant_no * 4294967296 + rank AS position FROM tk),
b AS (SELECT *, min(position) OVER (PARTITION BY query_id, content_hash) AS first_position FROM p QUALIFY row_number() OVER (PARTITION BY query_id, content_hash ORDER BY score DESC, position) = 1)
SELECT query_id, content_hash, chunk_id, first_position, round(score, 6) AS score FROM b""")
def _(t):
    position = R.place(F.col("rank"), F.col("variant_no"), F.col("strategy_no"))
    found = R.search_variants(t.query_variant, t.kb_chunk, 5).withColumn("position", position)
    return _rounded(R.dedup_contexts(found, ["query_id"], ["chunk_id"]), "query_id", "content_hash", "chunk_id", "first_position")


@plan("r11_hybrid", f"""WITH c AS MATERIALIZED (SELECT chunk_id, embedding, {_TERMS.format("content")} AS words FROM kb_chunk),
q AS MATERIALIZED (SELECT query_id, embedding, {_TERMS.format("query_text")} AS words FROM text_question),
s AS (SELECT q.query_id, c.chunk_id, {DOT} AS v, len(list_intersect(q.words, c.words))::DOUBLE / greatest(len(q.words), 1) AS k FROM q CROSS JOIN c),
r AS (SELECT query_id, min(v) AS lv, max(v) AS hv, min(k) AS lk, max(k) AS hk FROM s GROUP BY 1),
h AS (SELECT s.query_id, chunk_id, 0.7::DOUBLE * CASE WHEN hv > lv THEN (v - lv) / (hv - lv) ELSE 0 END + 0.3::DOUBLE * CASE WHEN hk > lk THEN (k - lk) / (hk - lk) ELSE 0 END AS score FROM s JOIN r ON s.query_id = r.query_id),
t AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM h QUALIFY rank <= 5)
SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM t""")
def _(t):
    return _rounded(R.hybrid_top_k(t.text_question, t.kb_chunk, 5), "query_id", "chunk_id", "rank")


def _named_questions(t):
    """All vector questions under a text; some ask for a source nothing was found in."""
    return t.embeddings.select(F.col("vec_id").alias("query_id"), F.concat(F.lit("question "), F.col("vec_id").cast("string")).alias("query_text"))


_NOTHING = R.NOTHING_FOUND.replace("'", "''")


@plan("r12_context_text", rf"""WITH {_multi(2)}, {_dedup('jt', 'ms', 8, 'strategy')},
x AS (SELECT m.query_id, m.rank, regexp_replace(c.content, '^\s+|\s+$', '', 'g') AS content FROM ms m JOIN ch c ON m.chunk_id = c.chunk_id),
j AS (SELECT query_id, string_agg(content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS contexts FROM x WHERE content <> '' GROUP BY 1)
SELECT q.vec_id AS query_id, md5(coalesce(j.contexts || CASE WHEN q.label = 3 THEN chr(10) || chr(10) || '--- USER CORRECTIONS ---' || chr(10) || chr(10) || 'use db_order' ELSE '' END,
  replace('{_NOTHING}', '{{}}', 'question ' || q.vec_id))) AS context_text FROM embeddings q LEFT JOIN j ON q.vec_id = j.query_id""")
def _(t):
    corrections = t.embeddings.filter("label = 3").select(F.col("vec_id").alias("query_id"), F.lit("use db_order").alias("corrections"))
    text = R.context_text(_named_questions(t), R.multi_strategy(t.query_variant, t.kb_chunk, 8), t.kb_chunk, corrections)
    return text.withColumn("context_text", F.md5("context_text"))


@plan("r13_funnel", f"""WITH {_multi(2)} SELECT query_id, count(*) FILTER (WHERE strategy = 'standard') AS standard, count(*) FILTER (WHERE strategy = 'expansion') AS expansion,
  count(*) FILTER (WHERE strategy = 'hyde') AS hyde, count(*) AS found, count(DISTINCT content_hash) AS unique_contexts, least(count(DISTINCT content_hash), 8) AS selected FROM jt GROUP BY 1""")
def _(t):
    return R.funnel(t.query_variant, t.kb_chunk, 8)


@plan("r14_request_key", "SELECT question_id, md5(query_text || '::5::company:' || CAST(company_id AS VARCHAR) || '::method:' || query_mode) AS request_key FROM question_log")
def _(t):
    return t.question_log.select("question_id", R.request_key(F.col("query_text"), 5, method=F.col("query_mode"), company=F.col("company_id").cast("string")).alias("request_key"))


@plan("r15_reuse_within_ttl", """WITH RECURSIVE rq AS (SELECT event_type AS request_key, epoch_us(ts) // 1000000 AS second, count(*) AS requests FROM events GROUP BY 1, 2),
chain AS (SELECT request_key, min(second) AS second FROM rq GROUP BY 1
  UNION ALL SELECT c.request_key, min(r.second) FROM chain c JOIN rq r ON r.request_key = c.request_key AND r.second >= c.second + 3600 GROUP BY c.request_key)
SELECT r.request_key, r.second, r.requests, CASE WHEN c.second IS NULL THEN 0 ELSE 1 END::BIGINT AS computed,
  (r.requests - CASE WHEN c.second IS NULL THEN 0 ELSE 1 END)::BIGINT AS reused FROM rq r LEFT JOIN chain c ON r.request_key = c.request_key AND r.second = c.second""")
def _(t):
    # five keys over the whole event log: every key is busy
    return R.reused_requests(t.events.select(F.col("event_type").alias("request_key"), "ts"))


@plan("r16_error_rows", f"""WITH {_top(2)}, n AS (SELECT query_id, count(*) AS contexts FROM tk WHERE strategy = 'hyde' GROUP BY 1)
SELECT q.vec_id AS query_id, coalesce(n.contexts, 0) AS contexts, CASE WHEN n.contexts IS NULL THEN 'no contexts found' END AS error FROM embeddings q LEFT JOIN n ON q.vec_id = n.query_id""")
def _(t):
    found = R.search_variants(t.query_variant.filter(F.col("strategy") == "hyde"), t.kb_chunk, 2)
    return R.with_errors(_named_questions(t), found)


@plan("j14_questions_by_chunks", f"WITH {_top(3)} SELECT query_id, variant_no, chunk_id, rank, round(score, 6) AS score FROM tk WHERE strategy = 'expansion'")
def _(t):
    found = R.top_k(t.query_variant.filter(F.col("strategy") == "expansion"), t.kb_chunk, 3, ("query_id", "variant_no"))
    return _rounded(found, "query_id", "variant_no", "chunk_id", "rank")
