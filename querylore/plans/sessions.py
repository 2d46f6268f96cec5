"""Session operators and their DuckDB twins."""

from pyspark.sql import functions as F

from querylore.operators import sessions as H
from querylore.plans.registry import plan

STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')"


def stamp(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name)


_NEW_ID = "(SELECT max(id) FROM {0}) + row_number() OVER (ORDER BY left(md5({1}), 3), {2})"
UPSERT = f"""ac AS (SELECT u.* FROM user_context u WHERE application_id IN (SELECT company_id FROM application WHERE is_active)),
nc AS (SELECT DISTINCT company_code FROM ac WHERE company_code NOT IN (SELECT company_code FROM company)),
co AS (SELECT id, company_code FROM company UNION ALL SELECT {_NEW_ID.format("company", "company_code", "company_code")}, company_code FROM nc)"""


@plan("h01_upsert_companies", f"WITH {UPSERT} SELECT id, company_code FROM co")
def _(t):
    return H.upsert_companies(t.company, H.accepted_contexts(t.user_context, t.application))


@plan("h01_upsert_users", f"""WITH {UPSERT}, se AS (SELECT a.login_id, co.id AS company_id, max(a.ts) AS last_active FROM ac a JOIN co ON a.company_code = co.company_code GROUP BY 1, 2),
nu AS (SELECT s.login_id, s.company_id FROM se s WHERE NOT EXISTS (SELECT 1 FROM app_user u WHERE u.login_id = s.login_id AND u.company_id = s.company_id)),
us AS (SELECT id, login_id, company_id FROM app_user UNION ALL
  SELECT {_NEW_ID.format("app_user", "login_id || '|' || CAST(company_id AS VARCHAR)", "login_id, company_id")}, login_id, company_id FROM nu)
SELECT us.id, us.login_id, us.company_id, {STAMP.format("last_active")} AS last_active FROM us LEFT JOIN se ON us.login_id = se.login_id AND us.company_id = se.company_id""")
def _(t):
    accepted = H.accepted_contexts(t.user_context, t.application)
    users = H.upsert_users(t.app_user, H.upsert_companies(t.company, accepted), accepted)
    return users.select("id", "login_id", "company_id", stamp("last_active"))


@plan("h02_active_session", """SELECT user_id, company_id, id, session_uuid FROM chat_session WHERE is_active
QUALIFY row_number() OVER (PARTITION BY user_id, company_id ORDER BY created_at DESC, id DESC) = 1""")
def _(t):
    return H.active_session(t.chat_session)


@plan("h03_last_messages", f"""WITH b AS (SELECT session_id, id, message_type, created_at, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, id DESC) AS back FROM chat_message),
k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at, id) AS shown FROM b WHERE back <= 50)
SELECT session_id, id, message_type, CAST(shown AS INT) AS shown, {STAMP.format("created_at")} AS created_at FROM k""")
def _(t):
    return H.last_messages(t.chat_message).select("session_id", "id", "message_type", "shown", stamp("created_at"))


@plan("h04_append_messages", f"""WITH n AS (SELECT session_id, count(*) AS added, max(ts) AS touched FROM question_log GROUP BY 1),
m AS (SELECT session_id, count(*) AS messages FROM (SELECT session_id FROM chat_message UNION ALL SELECT session_id FROM question_log) GROUP BY 1)
SELECT s.id, {STAMP.format("greatest(s.updated_at, coalesce(n.touched, s.updated_at))")} AS updated_at, coalesce(n.added, 0) AS added, coalesce(m.messages, 0) AS messages
FROM chat_session s LEFT JOIN n ON s.id = n.session_id LEFT JOIN m ON s.id = m.session_id""")
def _(t):
    old = t.chat_message.select("session_id", "content", "created_at")
    new = t.question_log.select("session_id", F.col("query_text").alias("content"), F.col("ts").alias("created_at"))
    messages, sessions = H.append_messages(t.chat_session, old, new)
    counts = messages.groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("messages"))
    zero = F.lit(0)
    return sessions.join(counts, "id", "left").select("id", stamp("updated_at"), F.coalesce("added", zero).alias("added"), F.coalesce("messages", zero).alias("messages"))


@plan("h05_source_sessions", f"""WITH r AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id, company_id ORDER BY updated_at DESC, id DESC) AS INT) AS position FROM chat_session WHERE kb_id = 'kb_support')
SELECT r.user_id, r.company_id, r.id, position, count(m.id) AS message_count, {STAMP.format("any_value(r.updated_at)")} AS updated_at FROM r LEFT JOIN chat_message m ON r.id = m.session_id
WHERE position <= 10 GROUP BY 1, 2, 3, 4""")
def _(t):
    return H.source_sessions(t.chat_session, t.chat_message, "kb_support").select("user_id", "company_id", "id", "position", "message_count", stamp("updated_at"))


@plan("h06_source_questions", """WITH r AS (SELECT m.*, CAST(row_number() OVER (PARTITION BY m.user_id, m.company_id ORDER BY m.created_at DESC, m.id DESC) AS INT) AS position
FROM chat_message m JOIN chat_session s ON m.session_id = s.id WHERE s.kb_id = 'kb_support' AND m.message_type = 'user')
SELECT user_id, company_id, id, position FROM r WHERE position <= 20""")
def _(t):
    return H.source_questions(t.chat_session, t.chat_message, "kb_support").select("user_id", "company_id", "id", "position")


ANALYTICS = """an AS (SELECT company_id, md5(content) AS question_hash, count(*) AS use_count, min(created_at) AS first_used, max(created_at) AS last_used,
  arg_max(query_type, created_at) AS query_type, arg_max(endpoint_used, created_at) AS endpoint_used, arg_max(response_time_ms, created_at) AS response_time_ms, arg_max(success, created_at) AS success
  FROM chat_message WHERE message_type = 'user' GROUP BY 1, 2)"""


@plan("h07_query_analytics", f"WITH {ANALYTICS} SELECT * REPLACE ({STAMP.format('first_used')} AS first_used, {STAMP.format('last_used')} AS last_used) FROM an")
def _(t):
    return H.query_analytics(t.chat_message).withColumns({"first_used": stamp("first_used"), "last_used": stamp("last_used")})


@plan("h08_popular_questions", f"WITH {ANALYTICS}, r AS (SELECT company_id, question_hash, use_count, CAST(row_number() OVER (PARTITION BY company_id ORDER BY use_count DESC, question_hash) AS INT) AS position FROM an) SELECT * FROM r WHERE position <= 10")
def _(t):
    return H.popular_questions(H.query_analytics(t.chat_message)).select("company_id", "question_hash", "use_count", "position")


@plan("h08_slow_questions", f"WITH {ANALYTICS}, r AS (SELECT company_id, question_hash, response_time_ms, CAST(row_number() OVER (PARTITION BY company_id ORDER BY response_time_ms DESC, question_hash) AS INT) AS position FROM an) SELECT * FROM r WHERE position <= 10")
def _(t):
    return H.slow_questions(H.query_analytics(t.chat_message)).select("company_id", "question_hash", "response_time_ms", "position")


@plan("h09_cascade_delete", """WITH u AS (SELECT DISTINCT user_id, company_id FROM chat_session WHERE company_id NOT IN (SELECT company_id FROM application WHERE NOT is_active)),
s AS (SELECT * FROM chat_session c WHERE EXISTS (SELECT 1 FROM u WHERE u.user_id = c.user_id AND u.company_id = c.company_id)), m AS (SELECT * FROM chat_message WHERE session_id IN (SELECT id FROM s)),
f AS (SELECT * FROM query_feedback WHERE message_id IN (SELECT id FROM m))
SELECT 'user' AS kept, count(*) AS n FROM u UNION ALL SELECT 'session', count(*) FROM s UNION ALL SELECT 'message', count(*) FROM m UNION ALL SELECT 'feedback', count(*) FROM f""")
def _(t):
    kept = H.cascade_delete(t.application.filter("NOT is_active").select("company_id"), t.chat_session.select("user_id", "company_id").distinct(),
                            t.chat_session, t.chat_message, t.query_feedback)
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("kept"), "n") for name, df in kept.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


@plan("h10_constraint_report", """
SELECT 'message.message_type in domain' AS rule, count(*) AS violations FROM chat_message WHERE message_type NOT IN ('user', 'assistant', 'system')
UNION ALL SELECT 'message.content not null', count(*) FROM chat_message WHERE content IS NULL
UNION ALL SELECT 'feedback.feedback_type in domain', count(*) FROM query_feedback WHERE feedback_type NOT IN ('correction', 'rating', 'improvement_suggestion')
UNION ALL SELECT 'feedback.problem_category in domain', count(*) FROM query_feedback WHERE problem_category NOT IN ('wrong_table', 'wrong_columns', 'missing_where_clause', 'incorrect_joins', 'syntax_error', 'other')
UNION ALL SELECT 'feedback.processing_status in domain', count(*) FROM query_feedback WHERE processing_status NOT IN ('pending', 'reviewed', 'applied', 'rejected')
UNION ALL SELECT 'feedback.rating from 1 to 5', count(*) FROM query_feedback WHERE rating NOT BETWEEN 1 AND 5
UNION ALL SELECT 'feedback.correction has text', count(*) FROM query_feedback WHERE feedback_type = 'correction' AND corrected_response IS NULL
UNION ALL SELECT 'session.session_uuid unique', coalesce(CAST(sum(n) AS BIGINT), 0) FROM (SELECT count(*) AS n FROM chat_session GROUP BY session_uuid HAVING count(*) > 1)
UNION ALL SELECT 'analytic.question unique in company', coalesce(CAST(sum(n) AS BIGINT), 0) FROM (SELECT count(*) AS n FROM chat_message WHERE message_type = 'user' GROUP BY company_id, md5(content) HAVING count(*) > 1)
UNION ALL SELECT 'message.session_id refers to session', count(*) FROM chat_message WHERE session_id NOT IN (SELECT id FROM chat_session)
UNION ALL SELECT 'feedback.message_id refers to message', count(*) FROM query_feedback WHERE message_id NOT IN (SELECT id FROM chat_message)""")
def _(t):
    return H.constraint_report(t.chat_session, t.chat_message, t.query_feedback)


SETTINGS = ["click", "view", "purchase"]


@plan("h11_user_preferences", "SELECT user_id, " + ", ".join(f"arg_max(props, ts) FILTER (WHERE event_type = '{s}') AS {s}" for s in SETTINGS) + " FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY 1")
def _(t):
    settings = t.events.select("user_id", F.col("event_type").alias("name"), F.col("props").alias("value"), "ts", F.col("event_id").alias("id"))
    return H.user_preferences(settings, SETTINGS)


@plan("h12_service_report", """SELECT source_kb, endpoint_used, count(*) AS requests, round(sum(response_time_ms)::DOUBLE / count(*), 4) AS mean_ms, round(quantile_cont(response_time_ms, 0.95), 4) AS p95_ms,
  count(*) FILTER (WHERE NOT success) AS errors, max(response_time_ms) > 10000 AS slow, (count(*) FILTER (WHERE NOT success))::DOUBLE / count(*) > 0.01 AS failing FROM chat_message GROUP BY 1, 2""")
def _(t):
    return H.service_report(t.chat_message)
