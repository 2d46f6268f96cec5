"""Routing of questions to knowledge sources by keyword score, and merging of the answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querylore.functions.columns import keyword_score

# Keywords of the server's rule.
SERVER_KEYWORDS = {
    "database": ["table", "column", "database", "sql", "query", "schema", "index", "foreign key", "primary key", "relationship", "join"],
    "support": ["error", "issue", "problem", "troubleshoot", "fix", "bug", "help", "support", "ticket", "resolve"],
    "documentation": ["how to", "guide", "tutorial", "documentation", "manual", "instruction", "feature", "functionality"],
}

# Keywords of the client's rule.
CLIENT_KEYWORDS = {
    "database": ["table", "schema", "join", "query", "sql", "column", "index", "database", "select", "insert", "update", "delete",
                 "create", "alter", "drop", "foreign key", "primary key", "relationship", "normalize"],
    "support": ["error", "issue", "problem", "slow", "help", "troubleshoot", "bug", "performance", "timeout", "crash", "fail", "broken",
                "not working", "support", "ticket", "resolve", "fix", "solution"],
    "documentation": ["how to", "tutorial", "guide", "documentation", "feature", "setup", "configure", "install", "getting started",
                      "best practice", "workflow", "process", "procedure", "manual"],
}

# Patterns that name a table or hold a statement.
TABLE_QUESTION = r"""(?i)(?:relationship|foreign keys|references for|join with)\s+(?:table\s+)?['"]?(\w+)['"]?"""
STATEMENT = r"(?is)\b(SELECT\s+.*)\b"


def scores(questions: DataFrame, keywords: dict[str, list[str]] = SERVER_KEYWORDS, text: str = "query_text") -> DataFrame:
    """Number of distinct keywords per kind of source, as ``<kind>_score``."""
    return questions.withColumns({f"{kind}_score": keyword_score(F.col(text), words) for kind, words in keywords.items()})


def application_sources(questions: DataFrame, applications: DataFrame, key: str = "company_id") -> DataFrame:
    """Source ids of the active application of each question; applications are a list of products, one row each."""
    active = applications.filter("is_active").select(key, F.col("name").alias("application"), "database_kb", "support_kb", "documentation_kb")
    return questions.join(active, key, "left")


def _kb(kind: Column) -> Column:
    return F.when(kind == "database", F.col("database_kb")).when(kind == "support", F.col("support_kb")).when(kind == "documentation", F.col("documentation_kb"))


def smart_kind() -> Column:
    """Database when it scores at least as much as both others; support only when it beats documentation; a missing
    support source falls through to documentation, a missing documentation source to the database."""
    db, support, doc = F.col("database_score"), F.col("support_score"), F.col("documentation_score")
    return (
        F.when((db >= support) & (db >= doc), "database")
        .when((support > doc) & F.col("support_kb").isNotNull(), "support")
        .when(F.col("documentation_kb").isNotNull(), "documentation")
        .otherwise("database")
    )


def forced_kind() -> Column:
    """The forced kind, or null when the application lacks that source."""
    mode = F.col("query_mode")
    return F.when((mode == "database") | _kb(mode).isNotNull(), mode)


def route(questions: DataFrame, applications: DataFrame) -> DataFrame:
    """Target kind and source id of each question. Questions need query_text, query_mode and company_id."""
    known = application_sources(scores(questions), applications)
    forced = F.col("query_mode").isin("database", "support", "documentation")
    routed = known.withColumn("target", F.when(F.col("application").isNotNull(), F.when(forced, forced_kind()).otherwise(smart_kind())))
    return routed.withColumn("target_kb", _kb(F.col("target")))


def resolve_targets(questions: DataFrame, applications: DataFrame) -> DataFrame:
    """Explicit target first, then the application's routing, then the default source; an unknown application is an error.

    Needs ``explicit_kb`` and ``has_application`` beside the columns of ``route``.
    """
    routed = route(questions, applications)
    unknown = F.col("has_application") & F.col("application").isNull()
    error = F.when(F.col("explicit_kb").isNotNull(), None).when(unknown, "application not found").when(
        F.col("has_application") & F.col("target_kb").isNull(), "no target available")
    chosen = F.coalesce(F.col("explicit_kb"), F.when(F.col("has_application"), F.col("target_kb")).otherwise(F.lit("kb_default")))
    return routed.withColumn("error", error).withColumn("chosen_kb", F.when(error.isNull(), chosen))


def client_kind() -> Column:
    db, support, doc = F.col("database_score"), F.col("support_score"), F.col("documentation_score")
    return F.when((db >= support) & (db >= doc), "database").when(support >= doc, "support").otherwise("documentation")


def fan_out(questions: DataFrame) -> DataFrame:
    """Targets of the client: in smart mode the classified kind, and support as a secondary one behind database."""
    kind = F.when(F.col("query_mode") == "smart", client_kind()).otherwise(F.col("query_mode"))
    def target(name, secondary):
        return F.struct(name.alias("target"), F.lit(secondary).alias("secondary"))
    both = F.array(target(F.col("kind"), False), target(F.lit("support"), True))
    one = F.array(target(F.col("kind"), False))
    targets = F.when((F.col("query_mode") == "smart") & (F.col("kind") == "database"), both).otherwise(one)
    return scores(questions, CLIENT_KEYWORDS).withColumn("kind", kind).select("question_id", F.inline(targets))


def asked_table(text: Column) -> Column:
    return F.regexp_extract(text, TABLE_QUESTION, 1)


def endpoint(text: Column) -> Column:
    optimize = text.contains("SELECT") & (text.contains("FROM") | text.contains("WHERE")) & text.contains("optimize")
    return F.when(asked_table(text) != "", "/relationship").when(optimize, "/optimize").otherwise("/query")


def request_subject(text: Column) -> Column:
    """What is sent to the endpoint: the table name, the statement in the question, or the question itself."""
    statement = F.regexp_extract(text, STATEMENT, 1)
    path = endpoint(text)
    return F.when(path == "/relationship", asked_table(text)).when((path == "/optimize") & (statement != ""), statement).otherwise(text)


def merge_answers(results: DataFrame) -> DataFrame:
    """One answer per question from rows (question_id, position, source_type, secondary, answer).

    The first primary answer, followed by the starts of the secondary ones; without a primary the first answer as it is.
    Secondary texts are cut to their 1,000 characters before they are gathered; there is one row per source of a question.
    """
    related = F.concat(F.lit("\n*From "), F.initcap("source_type"), F.lit(":* "), F.left("answer", F.lit(1000)), F.lit("..."))
    grouped = results.groupBy("question_id").agg(
        F.min_by(F.when(~F.col("secondary"), F.col("answer")), F.when(~F.col("secondary"), F.col("position"))).alias("primary"),
        F.min_by("answer", "position").alias("first_answer"),
        F.array_sort(F.collect_list(F.when(F.col("secondary"), F.struct("position", related.alias("text"))))).alias("secondaries"),
    )
    extra = F.array_join(F.transform("secondaries", lambda s: s["text"]), "")
    block = F.when(F.size("secondaries") > 0, F.concat(F.lit("\n\n**Related Information:**\n"), extra)).otherwise("")
    return grouped.select("question_id", F.when(F.col("primary").isNotNull(), F.concat("primary", block)).otherwise(F.col("first_answer")).alias("answer"))
