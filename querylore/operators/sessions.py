"""Users, chat sessions, messages and what can be counted from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querylore.functions.columns import count_if
from querylore.operators.relational import insert_missing, last_per_group

# Allowed values of the columns.
ENUMS = {
    "message_type": ["user", "assistant", "system"],
    "feedback_type": ["correction", "rating", "improvement_suggestion"],
    "problem_category": ["wrong_table", "wrong_columns", "missing_where_clause", "incorrect_joins", "syntax_error", "other"],
    "processing_status": ["pending", "reviewed", "applied", "rejected"],
}
SLOW_MS = 10_000
ERROR_LIMIT = 0.01


# --- users ----------------------------------------------------------------------------------------------------------

def accepted_contexts(contexts: DataFrame, applications: DataFrame) -> DataFrame:
    """Contexts of a known, active application; the others are rejected."""
    active = applications.filter("is_active").select(F.col("company_id").alias("application_id"))
    return contexts.join(active, "application_id", "left_semi")


def upsert_companies(existing: DataFrame, contexts: DataFrame) -> DataFrame:
    return insert_missing(existing, contexts.groupBy("company_code").agg(F.count("*").alias("n")).drop("n"), ["company_code"], "id")


def upsert_users(existing: DataFrame, companies: DataFrame, contexts: DataFrame) -> DataFrame:
    """Users by login and company; everyone seen gets the time of the last context. Contexts are reduced to one row per
    user before any join."""
    seen = contexts.groupBy("login_id", "company_code").agg(F.max("ts").alias("last_active"))
    seen = seen.join(companies.select("company_code", F.col("id").alias("company_id")), "company_code").drop("company_code")
    users = insert_missing(existing.select("id", "login_id", "company_id"), seen.select("login_id", "company_id"), ["login_id", "company_id"], "id")
    return users.join(seen, ["login_id", "company_id"], "left")


# --- sessions and messages ------------------------------------------------------------------------------------------

def active_session(sessions: DataFrame) -> DataFrame:
    """Newest active session of each user and company."""
    newest = F.max_by(F.struct("id", "session_uuid"), F.struct("created_at", "id"))
    return sessions.filter("is_active").groupBy("user_id", "company_id").agg(newest.alias("newest")).select("user_id", "company_id", "newest.*")


def last_messages(messages: DataFrame, n: int = 50) -> DataFrame:
    """The last n messages per session, to be shown oldest first (``shown`` counts from the oldest)."""
    last = last_per_group(messages.select("session_id", "id", "message_type", "created_at"), ["session_id"], [F.desc("created_at"), F.desc("id")], n, rank="back")
    kept = last.groupBy("session_id").agg(F.max("back").alias("kept"))
    return last.join(kept, "session_id").withColumn("shown", F.col("kept") - F.col("back") + 1).drop("kept", "back")


def append_messages(sessions: DataFrame, messages: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages with the new ones, and sessions touched by them."""
    touched = incoming.groupBy("session_id").agg(F.max("created_at").alias("touched"), F.count("*").alias("added"))
    updated = sessions.join(touched.withColumnRenamed("session_id", "id"), "id", "left").withColumn("updated_at", F.greatest("updated_at", F.coalesce("touched", "updated_at"))).drop("touched")
    return messages.unionByName(incoming), updated


def source_sessions(sessions: DataFrame, messages: DataFrame, source: str, n: int = 10) -> DataFrame:
    """Newest sessions of a source per user and company, with their message counts, zero included."""
    newest = last_per_group(sessions.filter(F.col("kb_id") == source), ["user_id", "company_id"], [F.desc("updated_at"), F.desc("id")], n)
    counts = messages.groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("message_count"))
    return newest.join(counts, "id", "left").withColumn("message_count", F.coalesce("message_count", F.lit(0)))


def source_questions(sessions: DataFrame, messages: DataFrame, source: str, n: int = 20) -> DataFrame:
    """Newest user messages in the sessions of a source, per user and company."""
    own = sessions.filter(F.col("kb_id") == source).select(F.col("id").alias("session_id"))
    asked = messages.filter(F.col("message_type") == "user").join(own, "session_id", "left_semi")
    return last_per_group(asked, ["user_id", "company_id"], [F.desc("created_at"), F.desc("id")], n)


# --- analytics ------------------------------------------------------------------------------------------------------

def query_analytics(messages: DataFrame) -> DataFrame:
    """One row per company and question text: use, first and last time, and how it went last time."""
    order = F.struct("created_at", "id")
    last = F.max_by(F.struct("query_type", "endpoint_used", "response_time_ms", "success"), order)
    return (
        messages.filter(F.col("message_type") == "user").groupBy("company_id", F.md5("content").alias("question_hash"))
        .agg(F.count("*").alias("use_count"), F.min("created_at").alias("first_used"), F.max("created_at").alias("last_used"), last.alias("last"))
        .select("company_id", "question_hash", "use_count", "first_used", "last_used", "last.*")
    )


def popular_questions(analytics: DataFrame, n: int = 10) -> DataFrame:
    return last_per_group(analytics, ["company_id"], [F.desc("use_count"), F.col("question_hash")], n)


def slow_questions(analytics: DataFrame, n: int = 10) -> DataFrame:
    return last_per_group(analytics, ["company_id"], [F.desc("response_time_ms"), F.col("question_hash")], n)


def cascade_delete(companies: DataFrame, users: DataFrame, sessions: DataFrame, messages: DataFrame, feedback: DataFrame) -> dict[str, DataFrame]:
    """What is left when companies are deleted with their users, sessions, messages and feedback. ``companies`` holds
    the company ids to delete."""
    kept_users = users.join(companies.select("company_id"), "company_id", "left_anti")
    kept_sessions = sessions.join(kept_users.select("user_id", "company_id"), ["user_id", "company_id"], "left_semi")
    kept_messages = messages.join(kept_sessions.select(F.col("id").alias("session_id")), "session_id", "left_semi")
    kept_feedback = feedback.join(kept_messages.select(F.col("id").alias("message_id")), "message_id", "left_semi")
    return {"user": kept_users, "session": kept_sessions, "message": kept_messages, "feedback": kept_feedback}


def _violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One pass over a table counts the rows that break each rule; a rule that gives null is not broken."""
    counted = df.agg(*[count_if(broken, f"r{i}") for i, broken in enumerate(rules.values())])
    rows = [F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("violations")) for i, name in enumerate(rules)]
    return counted.select(F.inline(F.array(*rows)))


def _outside(column: str) -> Column:
    return ~F.col(column).isin(ENUMS[column])


def constraint_report(sessions: DataFrame, messages: DataFrame, feedback: DataFrame) -> DataFrame:
    """Rows that break the domains, not-null rules, unique keys and references of the chat and feedback tables."""
    def repeated(df, name, *keys):
        many = df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
        return many.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations")).select(F.lit(name).alias("rule"), "violations")

    def dangling(df, name, key, target):
        missing = df.filter(F.col(key).isNotNull()).join(target.select(F.col("id").alias(key)), key, "left_anti")
        return missing.agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations")

    parts = [
        _violations(messages, {"message.message_type in domain": _outside("message_type"), "message.content not null": F.col("content").isNull()}),
        _violations(feedback, {
            "feedback.feedback_type in domain": _outside("feedback_type"), "feedback.problem_category in domain": _outside("problem_category"),
            "feedback.processing_status in domain": _outside("processing_status"), "feedback.rating from 1 to 5": ~F.col("rating").between(1, 5),
            "feedback.correction has text": (F.col("feedback_type") == "correction") & F.col("corrected_response").isNull()}),
        repeated(sessions, "session.session_uuid unique", "session_uuid"),
        repeated(messages.filter("message_type = 'user'"), "analytic.question unique in company", "company_id", F.md5("content")),
        dangling(messages, "message.session_id refers to session", "session_id", sessions),
        dangling(feedback, "feedback.message_id refers to message", "message_id", messages),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def user_preferences(settings: DataFrame, names: list[str]) -> DataFrame:
    """Latest value of each named setting, one row per user. Settings have user_id, name, value, ts and a unique id."""
    def latest(name):
        own = F.col("name") == name
        return F.max_by(F.when(own, F.col("value")), F.when(own, F.struct("ts", "id"))).alias(name)
    return settings.filter(F.col("name").isin(names)).groupBy("user_id").agg(*[latest(n) for n in names])


def service_report(messages: DataFrame) -> DataFrame:
    """Requests, mean and 95th percentile response time and error share per source and endpoint, with alarm flags.

    The exact percentile counts distinct milliseconds, of which there are few however many the messages.
    """
    time = F.col("response_time_ms")
    grouped = messages.groupBy("source_kb", "endpoint_used").agg(
        F.count("*").alias("requests"), (F.sum(time) / F.count("*")).alias("mean_ms"), F.percentile(time, 0.95).alias("p95_ms"),
        F.max(time).alias("max_ms"), count_if(~F.col("success"), "errors"))
    share = F.col("errors") / F.col("requests")
    return grouped.select("source_kb", "endpoint_used", "requests", F.round("mean_ms", 4).alias("mean_ms"), F.round("p95_ms", 4).alias("p95_ms"), "errors",
                          (F.col("max_ms") > SLOW_MS).alias("slow"), (share > ERROR_LIMIT).alias("failing"))
