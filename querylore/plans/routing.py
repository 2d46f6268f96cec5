"""Routing and its DuckDB twins."""

from pyspark.sql import functions as F

from querylore.operators import routing as G
from querylore.plans.registry import plan


def _score_sql(words: list[str]) -> str:
    return "(" + " + ".join(f"CASE WHEN contains(l, '{w}') THEN 1 ELSE 0 END" for w in words) + ")"


def _scores(name: str, keywords: dict) -> str:
    cols = ", ".join(f"CAST({_score_sql(w)} AS INT) AS {k}_score" for k, w in keywords.items())
    return f"{name} AS (SELECT * EXCLUDE (l), {cols} FROM (SELECT *, lower(query_text) AS l FROM question_log))"


SERVER, CLIENT = _scores("sv", G.SERVER_KEYWORDS), _scores("cl", G.CLIENT_KEYWORDS)
ROUTED = f"""{SERVER}, ap AS (SELECT company_id, name AS application, database_kb, support_kb, documentation_kb FROM application WHERE is_active),
kn AS (SELECT sv.*, application, database_kb, support_kb, documentation_kb FROM sv LEFT JOIN ap ON sv.company_id = ap.company_id),
rt AS (SELECT *, CASE WHEN application IS NULL THEN NULL
    WHEN query_mode = 'database' THEN 'database'
    WHEN query_mode = 'support' THEN CASE WHEN support_kb IS NOT NULL THEN 'support' END
    WHEN query_mode = 'documentation' THEN CASE WHEN documentation_kb IS NOT NULL THEN 'documentation' END
    WHEN database_score >= support_score AND database_score >= documentation_score THEN 'database'
    WHEN support_score > documentation_score AND support_kb IS NOT NULL THEN 'support'
    WHEN documentation_kb IS NOT NULL THEN 'documentation' ELSE 'database' END AS target FROM kn),
tg AS (SELECT *, CASE target WHEN 'database' THEN database_kb WHEN 'support' THEN support_kb WHEN 'documentation' THEN documentation_kb END AS target_kb FROM rt)"""


@plan("g01_server_scores", f"WITH {SERVER} SELECT question_id, database_score, support_score, documentation_score FROM sv")
def _(t):
    return G.scores(t.question_log).select("question_id", "database_score", "support_score", "documentation_score")


@plan("g01_smart_routing", f"WITH {ROUTED} SELECT question_id, company_id, target, target_kb FROM tg WHERE query_mode = 'smart'")
def _(t):
    return G.route(t.question_log.filter("query_mode = 'smart'"), t.application).select("question_id", "company_id", "target", "target_kb")


@plan("g02_forced_routing", f"WITH {ROUTED} SELECT question_id, query_mode, target, target_kb FROM tg WHERE query_mode <> 'smart'")
def _(t):
    return G.route(t.question_log.filter("query_mode <> 'smart'"), t.application).select("question_id", "query_mode", "target", "target_kb")


@plan("g03_client_kind", f"""WITH {CLIENT} SELECT question_id, database_score, support_score, documentation_score,
  CASE WHEN database_score >= support_score AND database_score >= documentation_score THEN 'database' WHEN support_score >= documentation_score THEN 'support' ELSE 'documentation' END AS kind FROM cl""")
def _(t):
    scored = G.scores(t.question_log, G.CLIENT_KEYWORDS)
    return scored.select("question_id", "database_score", "support_score", "documentation_score", G.client_kind().alias("kind"))


FAN = f"""{CLIENT}, kd AS (SELECT *, CASE WHEN query_mode <> 'smart' THEN query_mode WHEN database_score >= support_score AND database_score >= documentation_score THEN 'database'
  WHEN support_score >= documentation_score THEN 'support' ELSE 'documentation' END AS kind FROM cl),
fo AS (SELECT question_id, kind AS target, false AS secondary FROM kd UNION ALL SELECT question_id, 'support', true FROM kd WHERE query_mode = 'smart' AND kind = 'database')"""


@plan("g04_fan_out", f"WITH {FAN} SELECT * FROM fo")
def _(t):
    return G.fan_out(t.question_log)


_TABLE = """regexp_extract(query_text, '(?i)(?:relationship|foreign keys|references for|join with)\\s+(?:table\\s+)?[''"]?(\\w+)[''"]?', 1)""".replace("\\\\", "\\")
_END = f"""CASE WHEN {_TABLE} <> '' THEN '/relationship' WHEN contains(query_text, 'SELECT') AND (contains(query_text, 'FROM') OR contains(query_text, 'WHERE')) AND contains(query_text, 'optimize')
  THEN '/optimize' ELSE '/query' END"""


@plan("g05_endpoint", f"SELECT question_id, {_END} AS endpoint FROM question_log")
def _(t):
    return t.question_log.select("question_id", G.endpoint(F.col("query_text")).alias("endpoint"))


@plan("g06_request_subject", rf"""WITH e AS (SELECT question_id, query_text, {_END} AS endpoint, {_TABLE} AS tab, regexp_extract(query_text, '(?i)\b(SELECT\s+.*)\b', 1, 's') AS st FROM question_log)
SELECT question_id, endpoint, CASE WHEN endpoint = '/relationship' THEN tab WHEN endpoint = '/optimize' AND st <> '' THEN st ELSE query_text END AS subject FROM e""")
def _(t):
    text = F.col("query_text")
    return t.question_log.select("question_id", G.endpoint(text).alias("endpoint"), G.request_subject(text).alias("subject"))


@plan("g07_application_sources", f"WITH {ROUTED} SELECT question_id, application, database_kb, support_kb, documentation_kb FROM kn")
def _(t):
    return G.application_sources(t.question_log, t.application).select("question_id", "application", "database_kb", "support_kb", "documentation_kb")


@plan("g08_target_precedence", f"""WITH {ROUTED}, x AS (SELECT *, CASE WHEN session_id % 7 = 0 THEN 'kb_explicit' END AS explicit_kb, session_id % 3 <> 0 AS has_application FROM tg),
e AS (SELECT *, CASE WHEN explicit_kb IS NOT NULL THEN NULL WHEN has_application AND application IS NULL THEN 'application not found' WHEN has_application AND target_kb IS NULL THEN 'no target available' END AS error FROM x)
SELECT question_id, error, CASE WHEN error IS NULL THEN coalesce(explicit_kb, CASE WHEN has_application THEN target_kb ELSE 'kb_default' END) END AS chosen_kb FROM e""")
def _(t):
    # some requests name their target, some come without an application
    asked = t.question_log.withColumn("explicit_kb", F.when(F.col("session_id") % 7 == 0, "kb_explicit")).withColumn("has_application", F.col("session_id") % 3 != 0)
    return G.resolve_targets(asked, t.application).select("question_id", "error", "chosen_kb")


@plan("g09_merged_answers", f"""WITH {FAN}, an AS (SELECT f.question_id, CASE WHEN secondary THEN 1 ELSE 0 END AS position, f.target AS source_type, secondary AND f.question_id % 11 <> 0 OR f.question_id % 13 = 0 AS secondary,
  d.text AS answer FROM fo f JOIN documents d ON d.doc_id = (f.question_id + CASE WHEN secondary THEN 1 ELSE 0 END) % (SELECT count(*) FROM documents)),
pr AS (SELECT question_id, arg_min(answer, position) AS p FROM an WHERE NOT secondary GROUP BY 1), fi AS (SELECT question_id, arg_min(answer, position) AS f FROM an GROUP BY 1),
se AS (SELECT question_id, string_agg(chr(10) || '*From ' || upper(left(source_type, 1)) || substring(source_type, 2) || ':* ' || left(answer, 1000) || '...', '' ORDER BY position) AS s FROM an WHERE secondary GROUP BY 1)
SELECT fi.question_id, md5(CASE WHEN p IS NOT NULL THEN p || coalesce(chr(10) || chr(10) || '**Related Information:**' || chr(10) || s, '') ELSE f END) AS answer
FROM fi LEFT JOIN pr ON fi.question_id = pr.question_id LEFT JOIN se ON fi.question_id = se.question_id""")
def _(t):
    targets = G.fan_out(t.question_log)
    position = F.col("secondary").cast("int")
    documents = t.documents.agg(F.count("*")).scalar()
    answers = targets.select("question_id", position.alias("position"), F.col("target").alias("source_type"),
                             ((F.col("secondary") & (F.col("question_id") % 11 != 0)) | (F.col("question_id") % 13 == 0)).alias("secondary"),
                             ((F.col("question_id") + position) % documents).alias("doc_id"))
    merged = G.merge_answers(answers.join(t.documents.select("doc_id", F.col("text").alias("answer")), "doc_id"))
    return merged.withColumn("answer", F.md5("answer"))
