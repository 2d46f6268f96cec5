"""Feedback operators and their DuckDB twins."""

from pyspark.sql import functions as F

from querylore.operators import feedback as V
from querylore.plans.registry import plan
from querylore.plans.sessions import STAMP, stamp

PATTERN = "lower({0})"
for _term, _place in V.PATTERN_TERMS.items():
    PATTERN = f"replace({PATTERN}, '{_term}', '{_place}')"
TAKEN = "processing_status = 'pending' AND feedback_type = 'correction'"
TRAINING = f"""tr AS (SELECT id AS training_id, id AS feedback_id, kb_id, company_id, {PATTERN.format("original_query")} AS query_pattern, corrected_response AS correct_response,
  original_response AS incorrect_response, feedback_notes AS improvement_notes, 1.0::DOUBLE AS confidence_weight, 'pending' AS status, 0 AS times_used
  FROM query_feedback WHERE {TAKEN} AND corrected_response IS NOT NULL)"""
NOW = "(SELECT max(created_at) FROM query_feedback)"


def now(t):
    """Newest time in the feedback, the stand-in for the clock."""
    return t.query_feedback.agg(F.max("created_at")).scalar()


def training(t):
    return V.training_rows(t.query_feedback)


@plan("v01_accept_feedback", """SELECT f.id, s.id AS session_id, coalesce(nullif(m.source_kb, ''), 'epic') AS kb_id FROM query_feedback f
JOIN chat_session s ON s.session_uuid = 'sess-' || lpad(CAST(f.message_id // 20 AS VARCHAR), 8, '0') JOIN chat_message m ON m.id = f.message_id""")
def _(t):
    uuid = F.concat(F.lit("sess-"), F.lpad(F.floor(F.col("message_id") / 20).cast("string"), 8, "0"))
    requests = t.query_feedback.select("id", "message_id", uuid.alias("session_uuid"), F.lit("epic").alias("application"))
    return V.accept_feedback(requests, t.chat_session, t.chat_message).select("id", "session_id", "kb_id")


@plan("v02_classify_feedback", """WITH s AS (SELECT id, corrected_response, feedback_notes, CASE WHEN id % 8 < 4 THEN NULL ELSE rating END AS rating,
  CASE WHEN id % 2 = 0 THEN corrected_response ELSE original_response END AS original_response FROM query_feedback)
SELECT id, CASE WHEN corrected_response IS NOT NULL THEN 'correction' ELSE 'rating' END AS feedback_type, coalesce(corrected_response = original_response, false) AS equals_original
FROM s WHERE corrected_response IS NOT NULL OR feedback_notes IS NOT NULL OR rating IS NOT NULL""")
def _(t):
    submitted = t.query_feedback.select(
        "id", "corrected_response", "feedback_notes", F.when(F.col("id") % 8 >= 4, F.col("rating")).alias("rating"),
        F.when(F.col("id") % 2 == 0, F.col("corrected_response")).otherwise(F.col("original_response")).alias("original_response"))
    return V.classify_feedback(submitted).select("id", "feedback_type", "equals_original")


@plan("v03_pending_corrections", f"SELECT id, kb_id, company_id, {STAMP.format('created_at')} AS created_at FROM query_feedback WHERE {TAKEN}")
def _(t):
    return V.pending_corrections(t.query_feedback).orderBy("kb_id", "company_id", "created_at", "id").select("id", "kb_id", "company_id", stamp("created_at"))


@plan("v04_query_pattern", f"SELECT id, {PATTERN.format('original_query')} AS query_pattern FROM query_feedback")
def _(t):
    return t.query_feedback.select("id", V.query_pattern(F.col("original_query")).alias("query_pattern"))


@plan("v05_training_rows", f"WITH {TRAINING} SELECT * FROM tr")
def _(t):
    return training(t).withColumn("confidence_weight", F.col("confidence_weight").cast("double"))


@plan("v05_rejected_corrections", f"SELECT id, kb_id, company_id, 'correct_response must not be null' AS error FROM query_feedback WHERE {TAKEN} AND corrected_response IS NULL")
def _(t):
    return V.rejected_corrections(t.query_feedback)


@plan("v06_mark_reviewed", f"""WITH x AS (SELECT *, {TAKEN} AND corrected_response IS NOT NULL AS taken FROM query_feedback)
SELECT id, CASE WHEN taken THEN 'reviewed' ELSE processing_status END AS processing_status, CASE WHEN taken THEN {STAMP.format(NOW)} END AS processed_at, CASE WHEN taken THEN 'system' END AS processed_by FROM x""")
def _(t):
    return V.mark_reviewed(t.query_feedback, now(t)).select("id", "processing_status", stamp("processed_at"), "processed_by")


LOG = f"""WITH {TRAINING}, c AS (SELECT kb_id, company_id, count(*) AS n FROM tr GROUP BY 1, 2),
l AS (SELECT *, row_number() OVER (ORDER BY left(md5(kb_id || '|' || CAST(company_id AS VARCHAR)), 3), kb_id, company_id) AS log_id FROM c)"""


@plan("v07_improvement_log", f"""{LOG}
SELECT log_id, kb_id, company_id, 'content_update' AS improvement_type, 'Processed ' || n || ' user corrections' AS description, 'ingestion_job' AS implementation_method,
  'in_progress' AS status FROM l""")
def _(t):
    return V.improvement_log(training(t))


@plan("v07_improvement_log_ids", f"{LOG} SELECT log_id, training_id FROM tr JOIN l ON tr.kb_id = l.kb_id AND tr.company_id = l.company_id")
def _(t):
    return V.improvement_log_ids(training(t))


@plan("v08_correction_documents", f"""WITH {TRAINING} SELECT training_id, query_pattern, correct_response AS correct_sql, 'Corrected based on user feedback: ' || coalesce(improvement_notes, 'None') AS explanation,
  'user_corrections' AS category, strftime({NOW}, '%Y-%m-%dT%H:%M:%S') AS created_at FROM tr""")
def _(t):
    return V.correction_documents(training(t), now(t))


@plan("v09_processing_result", f"""SELECT kb_id, company_id, CASE WHEN count(*) FILTER (WHERE {TAKEN}) = 0 THEN 'no_pending_feedback' ELSE 'success' END AS status,
  count(*) FILTER (WHERE {TAKEN} AND corrected_response IS NOT NULL) AS processed FROM query_feedback GROUP BY 1, 2""")
def _(t):
    return V.processing_result(t.query_feedback)


@plan("v10_training_status", f"""WITH c AS (SELECT kb_id, company_id, count(*) FILTER (WHERE processing_status = 'pending') AS pending_feedback,
  count(*) FILTER (WHERE processing_status IN ('applied', 'reviewed')) AS processed_feedback FROM query_feedback GROUP BY 1, 2),
l AS (SELECT kb_id, company_id, max(completed_at) AS m FROM kb_improvement_log WHERE status = 'completed' GROUP BY 1, 2)
SELECT c.*, {STAMP.format('l.m')} AS last_update FROM c LEFT JOIN l ON c.kb_id = l.kb_id AND c.company_id = l.company_id""")
def _(t):
    return V.training_status(t.query_feedback, t.kb_improvement_log).withColumn("last_update", stamp("last_update"))


@plan("v11_dry_run", f"SELECT kb_id, company_id, count(*) AS would_process FROM query_feedback WHERE {TAKEN} GROUP BY 1, 2")
def _(t):
    return V.dry_run(t.query_feedback)


@plan("v12_pending_report", "SELECT kb_id, count(*) AS n FROM query_feedback WHERE processing_status = 'pending' GROUP BY 1")
def _(t):
    return V.pending_report(t.query_feedback)


@plan("v12_category_report", "SELECT kb_id, problem_category, count(*) AS n FROM query_feedback GROUP BY 1, 2")
def _(t):
    return V.category_report(t.query_feedback)


@plan("v12_usage_report", f"SELECT kb_id, query_pattern, times_used, {STAMP.format('last_used_at')} AS last_used_at, id FROM training_data")
def _(t):
    return V.usage_report(t.training_data).withColumn("last_used_at", stamp("last_used_at"))


@plan("v12_newest_improvements", f"SELECT id, status, {STAMP.format('created_at')} AS created_at FROM kb_improvement_log WHERE kb_id = 'kb_database' ORDER BY kb_improvement_log.created_at DESC, id DESC LIMIT 10")
def _(t):
    return V.newest_improvements(t.kb_improvement_log, "kb_database").select("id", "status", stamp("created_at"))


@plan("v12_completed_improvements", "SELECT id, kb_id, improvement_type, status, success_metrics FROM kb_improvement_log WHERE status = 'completed'")
def _(t):
    return V.completed_improvements(t.kb_improvement_log)


@plan("v13_relevant_corrections", f"""WITH {TRAINING}, n AS (SELECT company_id, query_pattern, count(*) AS corrections, max(training_id) AS newest_id, arg_max(correct_response, training_id) AS newest_response FROM tr GROUP BY 1, 2),
q AS (SELECT question_id, company_id, {PATTERN.format("query_text")} AS query_pattern FROM question_log)
SELECT q.question_id, q.company_id, q.query_pattern, coalesce(corrections, 0) AS corrections, newest_id, newest_response FROM q LEFT JOIN n ON q.company_id = n.company_id AND q.query_pattern = n.query_pattern""")
def _(t):
    return V.relevant_corrections(t.question_log, training(t))
