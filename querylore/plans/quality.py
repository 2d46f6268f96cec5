"""Answer quality and its DuckDB twins."""

from pyspark.sql import functions as F

from querylore.operators import quality as X
from querylore.operators import retrieval as R
from querylore.operators import routing as G
from querylore.plans.registry import plan
from querylore.plans.retrieval import SCORES
from querylore.plans.routing import FAN

# answers of the assistant, questions of the log and statements of the query log
ANSWERS = """ans AS (SELECT 'chat' AS origin, conv_id * 20 + turn AS id, text FROM conversations WHERE role = 'assistant'
  UNION ALL SELECT 'question', question_id, query_text FROM question_log UNION ALL SELECT 'file', query_id, content FROM query_log)"""


def answers(t):
    chat = t.conversations.filter("role = 'assistant'").select(F.lit("chat").alias("origin"), (F.col("conv_id") * 20 + F.col("turn")).alias("id"), "text")
    asked = t.question_log.select(F.lit("question").alias("origin"), F.col("question_id").alias("id"), F.col("query_text").alias("text"))
    files = t.query_log.select(F.lit("file").alias("origin"), F.col("query_id").alias("id"), F.col("content").alias("text"))
    return chat.unionByName(asked).unionByName(files)


def _share_sql(words: list[str]) -> str:
    def has(x):
        return "(" + " OR ".join(f"contains(lower({x}), '{w}')" for w in words) + ")"
    return rf"""WITH {ANSWERS}, l AS (SELECT *, string_split(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10)) AS lines FROM ans),
s AS (SELECT origin, id, {has("text")} AS has_sql, len(list_filter(lines, lambda x: {has("x")}))::DOUBLE / len(lines) AS sql_share FROM l)
SELECT *, sql_share > 0.3::DOUBLE AS sql_focused FROM s"""


@plan("x01_sql_share", _share_sql(X.SQL_WORDS))
def _(t):
    return X.sql_share(answers(t)).drop("text")


@plan("x01_sql_share_short_list", _share_sql(X.SQL_WORDS_SHORT))
def _(t):
    return X.sql_share(answers(t), X.SQL_WORDS_SHORT).drop("text")


@plan("x01_contains_sql", f"WITH {ANSWERS} SELECT origin, id, " + " OR ".join(f"contains(lower(text), '{w}')" for w in X.SQL_WORDS_PROBE) + " AS has_sql FROM ans")
def _(t):
    return X.contains_sql(answers(t)).drop("text")


@plan("x02_truncation_flags", f"WITH {ANSWERS} SELECT origin, id, ends_with(text, '...') AS ends_with_dots, length(text) < 100 AS short FROM ans")
def _(t):
    return X.truncation_flags(answers(t)).drop("text")


@plan("x03_secondary_flags", f"""WITH {FAN}, d AS (SELECT f.question_id, CASE WHEN secondary THEN 1 ELSE 0 END AS position, f.target, secondary, x.text FROM fo f
  JOIN documents x ON x.doc_id = (f.question_id + CASE WHEN secondary THEN 1 ELSE 0 END) % (SELECT count(*) FROM documents)),
m AS (SELECT question_id, count(*) FILTER (WHERE secondary) > 0 AS sec, any_value(text) FILTER (WHERE NOT secondary) AS p FROM d GROUP BY 1)
SELECT question_id, sec OR contains(p, '**Related Information:**') AS has_section, sec OR (contains(p, '**Related Information:**') AND contains(p, '...') AND contains(p, 'From')) AS section_truncated FROM m""")
def _(t):
    position = F.col("secondary").cast("int")
    documents = t.documents.agg(F.count("*")).scalar()
    parts = G.fan_out(t.question_log).select("question_id", position.alias("position"), F.col("target").alias("source_type"), "secondary", ((F.col("question_id") + position) % documents).alias("doc_id"))
    merged = G.merge_answers(parts.join(t.documents.select("doc_id", F.col("text").alias("answer")), "doc_id"))
    return X.secondary_flags(merged).drop("answer")


@plan("x04_expected_found", f"""WITH {SCORES}, tk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc WHERE strategy = 'expansion' AND variant_no = 0 QUALIFY rank <= 5),
f AS (SELECT query_id, min(rank) AS r FROM tk WHERE label = q_label GROUP BY 1), e AS (SELECT query_id, label FROM query_variant WHERE strategy = 'expansion' AND variant_no = 0)
SELECT label AS "group", count(*) AS questions, count(r) AS hits, round(count(r)::DOUBLE / count(*), 6) AS hit_rate, round(sum(coalesce(1.0::DOUBLE / r, 0)) / count(*), 6) AS mean_reciprocal_rank
FROM e LEFT JOIN f ON e.query_id = f.query_id GROUP BY 1""")
def _(t):
    # the vector of another question stands in for a rewrite; a chunk is relevant when it has the question's label
    asked = t.query_variant.filter("strategy = 'expansion' AND variant_no = 0")
    found = R.top_k(asked, t.kb_chunk, 5, ("query_id", "label"))
    labels = t.kb_chunk.select("chunk_id", F.col("label").alias("chunk_label"))
    judged = found.join(labels, "chunk_id").select("query_id", "rank", (F.col("label") == F.col("chunk_label")).alias("relevant"))
    return X.hit_report(judged, asked.select("query_id", F.col("label").alias("group")))
