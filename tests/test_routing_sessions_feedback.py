"""Routing table, sessions, feedback and answer quality on literal rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from querylore.operators import feedback as V
from querylore.operators import quality as X
from querylore.operators import relational as L
from querylore.operators import routing as G
from querylore.operators import sessions as H

# question, server scores, server kind, client scores, client kind
EXPECTED = [
    ("Show me all tables in the database", (2, 0, 0), "database", (2, 0, 0), "database"),
    ("What columns are in the orders table?", (2, 0, 0), "database", (2, 0, 0), "database"),
    ("How do I join customers with orders?", (1, 0, 0), "database", (1, 0, 0), "database"),
    ("SELECT * FROM db_order WHERE DatePaid is not null", (0, 0, 0), "database", (1, 0, 0), "database"),
    ("I'm having an error with my login", (0, 1, 0), "support", (0, 1, 0), "support"),
    ("How do I troubleshoot connection issues?", (0, 2, 0), "support", (0, 2, 0), "support"),
    ("I need help with a ticket", (0, 2, 0), "support", (0, 2, 0), "support"),
    ("What support articles are available for this problem?", (0, 2, 0), "support", (0, 2, 0), "support"),
    ("Where is the tutorial and the manual for this feature?", (0, 0, 3), "documentation", (0, 0, 3), "documentation"),
    ("Show me information about orders", (0, 0, 0), "database", (0, 0, 0), "database"),
    ("foreign keys table db_order", (2, 0, 0), "database", (2, 0, 0), "database"),
    ("optimize SELECT a FROM db_order WHERE a = 1", (0, 0, 0), "database", (1, 0, 0), "database"),
    ("Show me all sales orders by payment date", (0, 0, 0), "database", (0, 0, 0), "database"),
    ("error in the query", (1, 1, 0), "database", (1, 1, 0), "database"),
    ("how to guide for the error", (0, 1, 2), "documentation", (0, 1, 2), "documentation"),
    ("hello", (0, 0, 0), "database", (0, 0, 0), "database"),
]
APPS = [(0, "all", "d", "s", "o", True), (1, "no_docs", "d", "s", None, True), (2, "no_support", "d", None, "o", True), (3, "db_only", "d", None, None, True), (4, "off", "d", "s", "o", False)]
KINDS = ("database_score", "support_score", "documentation_score")


@pytest.fixture(scope="module")
def apps(spark):
    return spark.createDataFrame(APPS, "company_id int, name string, database_kb string, support_kb string, documentation_kb string, is_active boolean")


def asked(spark, rows):
    return spark.createDataFrame(rows, "question_id int, query_text string, query_mode string, company_id int")


def test_routing_table(spark, apps):
    questions = asked(spark, [(i, e[0], "smart", 0) for i, e in enumerate(EXPECTED)])
    for keywords, scores, kind in ((G.SERVER_KEYWORDS, 1, None), (G.CLIENT_KEYWORDS, 3, 4)):
        rows = G.scores(questions, keywords).withColumn("kind", G.client_kind()).orderBy("question_id").collect()
        assert [tuple(r[k] for k in KINDS) for r in rows] == [e[scores] for e in EXPECTED]
        if kind:
            assert [r["kind"] for r in rows] == [e[kind] for e in EXPECTED]
    assert [r["target"] for r in G.route(questions, apps).orderBy("question_id").collect()] == [e[2] for e in EXPECTED]


def test_missing_sources(spark, apps):
    rows = [(i, "help with this error", "smart", i) for i in range(5)] + [(10 + i, "hello", "support", i) for i in range(5)] + [(20 + i, "hello", "documentation", i) for i in range(5)]
    got = {r["question_id"]: r["target"] for r in G.route(asked(spark, rows), apps).collect()}
    assert [got[i] for i in range(5)] == ["support", "support", "documentation", "database", None]
    assert [got[10 + i] for i in range(5)] == ["support", "support", None, None, None]
    assert [got[20 + i] for i in range(5)] == ["documentation", None, "documentation", None, None]


def test_precedence(spark, apps):
    rows = [(1, "x", "support", 3, "kb_me", True), (2, "x", "smart", 0, None, True), (3, "x", "smart", 4, None, True), (4, "x", "support", 3, None, True), (5, "x", "smart", 4, None, False)]
    df = spark.createDataFrame(rows, "question_id int, query_text string, query_mode string, company_id int, explicit_kb string, has_application boolean")
    got = {r["question_id"]: (r["chosen_kb"], r["error"]) for r in G.resolve_targets(df, apps).collect()}
    assert got == {1: ("kb_me", None), 2: ("d", None), 3: (None, "application not found"), 4: (None, "no target available"), 5: ("kb_default", None)}


def test_endpoints_and_fan_out(spark):
    texts = ["foreign keys table db_order", "Join with 'x'", "optimize SELECT a WHERE b", "optimize select a from b", "SELECT a FROM b", "please optimize this: SELECT a\nFROM b ;"]
    rows = asked(spark, [(i, x, "smart" if i else "support", 0) for i, x in enumerate(texts)])
    got = rows.orderBy("question_id").select(G.endpoint(F.col("query_text")), G.request_subject(F.col("query_text"))).collect()
    assert [tuple(r) for r in got] == [("/relationship", "db_order"), ("/relationship", "x"), ("/optimize", "SELECT a WHERE b"), ("/query", texts[3]), ("/query", texts[4]), ("/optimize", "SELECT a\nFROM b")]
    fan = {(r["question_id"], r["target"], r["secondary"]) for r in G.fan_out(rows).collect()}
    assert (0, "support", False) in fan and (4, "database", False) in fan and (4, "support", True) in fan and (0, "support", True) not in fan


def test_merged_answers(spark):
    rows = [(1, 0, "database", False, "main"), (1, 1, "support", True, "y" * 1200), (1, 2, "documentation", True, "z"), (2, 0, "support", True, "only"), (3, 0, "database", False, "a"), (3, 1, "support", False, "b")]
    got = dict(tuple(r) for r in G.merge_answers(spark.createDataFrame(rows, "question_id int, position int, source_type string, secondary boolean, answer string")).collect())
    assert got[1] == "main\n\n**Related Information:**\n\n*From Support:* " + "y" * 1000 + "...\n*From Documentation:* z..."
    assert got[2] == "only" and got[3] == "a"


T0 = dt.datetime(2024, 1, 1)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def test_upsert(spark, apps):
    contexts = spark.createDataFrame([("u1", "C1", 0, at(1)), ("u1", "C1", 0, at(3)), ("u2", "C1", 1, at(2)), ("u1", "C9", 2, at(4)), ("u3", "C8", 4, at(5))],
                                     "login_id string, company_code string, application_id int, ts timestamp_ntz")
    companies = spark.createDataFrame([(7, "C1"), (9, "C2")], "id bigint, company_code string")
    users = spark.createDataFrame([(1, "u1", 7), (2, "u5", 9)], "id bigint, login_id string, company_id bigint")
    accepted = H.accepted_contexts(contexts, apps)
    all_companies = H.upsert_companies(companies, accepted)
    assert sorted(tuple(r) for r in all_companies.collect()) == [(7, "C1"), (9, "C2"), (10, "C9")]
    got = {(r["login_id"], r["company_id"]): (r["id"], r["last_active"]) for r in H.upsert_users(users, all_companies, accepted).collect()}
    assert got["u1", 7] == (1, at(3)) and got["u5", 9] == (2, None) and {got["u2", 7][0], got["u1", 10][0]} == {3, 4} and len(got) == 4


def test_numbers_are_dense_and_stable(spark):
    df = spark.range(5_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"))
    one = {r["k"]: r["n"] for r in L.number_rows(df.repartition(7), ["k"], "n", F.lit(10)).collect()}
    two = {r["k"]: r["n"] for r in L.number_rows(df.repartition(3), ["k"], "n", F.lit(10)).collect()}
    assert sorted(one.values()) == list(range(11, 5_011)) and one == two
    assert L.number_rows(df.limit(0), ["k"], "n", F.lit(0)).count() == 0


def session_rows(spark):
    sessions = spark.createDataFrame([(1, "a", 1, 1, "kb_support", True, at(0), at(9)), (2, "b", 1, 1, "kb_support", True, at(0), at(5)), (3, "c", 2, 1, "kb_x", False, at(1), at(1))],
                                     "id bigint, session_uuid string, user_id int, company_id int, kb_id string, is_active boolean, created_at timestamp_ntz, updated_at timestamp_ntz")
    rows = [(i, 1, 1, 1, "user" if i % 2 else "assistant", f"m{i % 3}", at(i), "general", "/query", i * 100, i != 4, "kb") for i in range(60)]
    messages = spark.createDataFrame(rows, "id bigint, session_id bigint, user_id int, company_id int, message_type string, content string, created_at timestamp_ntz, "
                                           "query_type string, endpoint_used string, response_time_ms int, success boolean, source_kb string")
    return sessions, messages


def test_sessions(spark):
    sessions, messages = session_rows(spark)
    # created at the same time: the larger id is the newer one
    assert [r["id"] for r in H.active_session(sessions).collect()] == [2]
    shown = H.last_messages(messages).orderBy("shown").collect()
    assert [r["id"] for r in shown] == list(range(10, 60)) and [r["shown"] for r in shown] == list(range(1, 51))
    listed = {r["id"]: (r["position"], r["message_count"]) for r in H.source_sessions(sessions, messages, "kb_support").collect()}
    assert listed == {1: (1, 60), 2: (2, 0)}
    assert [r["id"] for r in H.source_questions(sessions, messages, "kb_support").orderBy("position").collect()] == list(range(59, 19, -2))
    analytics = {r["use_count"] for r in H.query_analytics(messages).collect()}
    assert analytics == {10}
    report = H.service_report(messages).first()
    assert report["requests"] == 60 and report["errors"] == 1 and report["failing"] and not report["slow"] and report["p95_ms"] == 5605.0
    both, touched = H.append_messages(sessions, messages.select("session_id", "content", "created_at"), spark.createDataFrame([(2, "n", at(99)), (1, "n", at(2))], "session_id bigint, content string, created_at timestamp_ntz"))
    assert both.count() == 62 and {r["id"]: r["updated_at"] for r in touched.collect()} == {1: at(9), 2: at(99), 3: at(1)}


def test_cascade_and_constraints(spark):
    sessions, messages = session_rows(spark)
    feedback = spark.createDataFrame([(1, 5, "rating", 9, None, "other", "pending"), (2, 999, "praise", None, None, "odd", "lost"), (3, 6, "correction", 5, None, None, "pending")],
                                     "id bigint, message_id bigint, feedback_type string, rating int, corrected_response string, problem_category string, processing_status string")
    users = sessions.select("user_id", "company_id").distinct()
    kept = H.cascade_delete(spark.createDataFrame([(1,)], "company_id int"), users, sessions, messages, feedback)
    assert [kept[k].count() for k in ("user", "session", "message", "feedback")] == [0, 0, 0, 0]
    kept = H.cascade_delete(spark.createDataFrame([(8,)], "company_id int"), users, sessions, messages, feedback)
    assert [kept[k].count() for k in ("user", "session", "message", "feedback")] == [2, 3, 60, 2]
    report = dict(tuple(r) for r in H.constraint_report(sessions.unionByName(sessions.limit(1)), messages, feedback).collect())
    assert report["session.session_uuid unique"] == 2 and report["feedback.rating from 1 to 5"] == 1 and report["feedback.feedback_type in domain"] == 1
    assert report["feedback.problem_category in domain"] == 1 and report["feedback.processing_status in domain"] == 1
    assert report["feedback.message_id refers to message"] == 1 and report["feedback.correction has text"] == 1 and report["message.session_id refers to session"] == 0


def feedback_rows(spark, rows):
    return spark.createDataFrame(rows, "id bigint, kb_id string, company_id int, feedback_type string, original_query string, original_response string, corrected_response string, "
                                       "feedback_notes string, processing_status string, created_at timestamp_ntz")


def test_patterns(spark):
    texts = ["Show me all Sales Orders by payment date", "reorders by CUSTOMERS", "late payments of products", "sales orders orders"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").orderBy("i")
    assert [r[0] for r in rows.select(V.query_pattern(F.col("x"))).collect()] == [
        "show me all [SALES_ENTITY] by payment date", "re[ORDER_ENTITY] by [CUSTOMER_ENTITY]", "late [PAYMENT_ENTITY] of [PRODUCT_ENTITY]", "[SALES_ENTITY] [ORDER_ENTITY]"]


def test_training(spark):
    rows = [(1, "k", 1, "correction", "Orders", "bad", "good", None, "pending", at(1)), (2, "k", 1, "correction", "x", "bad", None, "n", "pending", at(2)),
            (3, "k", 1, "rating", "x", "bad", "good", "n", "pending", at(3)), (4, "k", 1, "correction", "x", "bad", "good", "n", "reviewed", at(4)),
            (12_000, "k", 1, "correction", "x", "bad", "good2", "n", "pending", at(5)), (5, "l", 2, "rating", "x", "bad", None, None, "rejected", at(6))]
    feedback = feedback_rows(spark, rows)
    training = V.training_rows(feedback)
    assert {(r["feedback_id"], r["query_pattern"], float(r["confidence_weight"]), r["status"], r["times_used"]) for r in training.collect()} == {
        (1, "[ORDER_ENTITY]", 1.0, "pending", 0), (12_000, "x", 1.0, "pending", 0)}
    assert [r["id"] for r in V.rejected_corrections(feedback).collect()] == [2]
    now = F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")
    after = {r["id"]: (r["processing_status"], r["processed_by"]) for r in V.mark_reviewed(feedback, now).collect()}
    assert after[1] == ("reviewed", "system") and after[2] == ("pending", None) and after[4] == ("reviewed", None)
    log = V.improvement_log(training).collect()
    assert [(r["log_id"], r["description"], r["status"]) for r in log] == [(1, "Processed 2 user corrections", "in_progress")]
    assert sorted(tuple(r) for r in V.improvement_log_ids(training).collect()) == [(1, 1), (1, 12_000)]
    documents = {r["training_id"]: r["explanation"] for r in V.correction_documents(training, now).collect()}
    assert documents == {1: "Corrected based on user feedback: None", 12_000: "Corrected based on user feedback: n"}
    assert {(r["kb_id"], r["status"], r["processed"]) for r in V.processing_result(feedback).collect()} == {("k", "success", 2), ("l", "no_pending_feedback", 0)}
    questions = spark.createDataFrame([(1, 1, "ORDERS"), (2, 2, "orders")], "question_id int, company_id int, query_text string")
    assert {r["question_id"]: (r["corrections"], r["newest_id"]) for r in V.relevant_corrections(questions, training).collect()} == {1: (1, 1), 2: (0, None)}


def test_classification(spark):
    rows = [(1, " fix ", None, None, "fix"), (2, " ", "note", None, "o"), (3, None, None, 4, "o"), (4, "", "", None, "o"), (5, None, None, 0, "o"), (6, "new", None, 1, "old")]
    got = {r["id"]: (r["feedback_type"], r["equals_original"]) for r in V.classify_feedback(
        spark.createDataFrame(rows, "id int, corrected_response string, feedback_notes string, rating int, original_response string")).collect()}
    assert got == {1: ("correction", True), 2: ("rating", False), 3: ("rating", False), 6: ("correction", False)}


def test_quality(spark):
    rows = [(1, "SELECT a\nFROM b\n\nplain"), (2, "hello"), (3, "one\ntwo\nthree\nfrom four..."), (4, "")]
    got = {r["id"]: r for r in X.sql_share(X.truncation_flags(spark.createDataFrame(rows, "id int, text string"))).collect()}
    assert got[1]["sql_share"] == 0.5 and got[1]["sql_focused"] and got[2]["sql_share"] == 0 and got[3]["sql_share"] == 0.25 and not got[3]["sql_focused"]
    assert got[3]["ends_with_dots"] and got[4]["short"] and not got[4]["has_sql"]
    found = spark.createDataFrame([(1, 1, False), (1, 2, True), (1, 3, True), (2, 1, False)], "query_id int, rank int, relevant boolean")
    report = X.hit_report(found, spark.createDataFrame([(1, "g"), (2, "g"), (3, "g")], "query_id int, group string")).first()
    assert (report["questions"], report["hits"], report["hit_rate"], report["mean_reciprocal_rank"]) == (3, 1, 0.333333, 0.166667)
