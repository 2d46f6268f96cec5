"""User feedback: acceptance, training rows from corrections, improvement log, status and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querylore.functions.columns import count_if, strip
from querylore.operators.relational import number_rows

GROUP = ["kb_id", "company_id"]

# Terms and their placeholders, replaced one after the other in this order.
PATTERN_TERMS = {
    "sales orders": "[SALES_ENTITY]",
    "customers": "[CUSTOMER_ENTITY]",
    "products": "[PRODUCT_ENTITY]",
    "orders": "[ORDER_ENTITY]",
    "payments": "[PAYMENT_ENTITY]",
}


def accept_feedback(requests: DataFrame, sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Feedback whose session and message are known; its source is that of the message, else the application's name."""
    known = sessions.select("session_uuid", F.col("id").alias("session_id"))
    source = messages.select(F.col("id").alias("message_id"), "source_kb")
    return (
        requests.join(known, "session_uuid").join(source, "message_id")
        .withColumn("kb_id", F.coalesce(F.nullif("source_kb", F.lit("")), F.col("application"))).drop("source_kb")
    )


def classify_feedback(submitted: DataFrame) -> DataFrame:
    """Type by content; rows without correction, notes and rating are refused. Blank texts count as missing."""
    def text(name):
        return F.nullif(strip(F.col(name)), F.lit(""))
    filled = submitted.withColumns({"corrected_response": text("corrected_response"), "feedback_notes": text("feedback_notes")})
    given = F.coalesce("corrected_response", "feedback_notes", F.nullif(F.col("rating"), F.lit(0)).cast("string")).isNotNull()
    return filled.filter(given).withColumns({
        "feedback_type": F.when(F.col("corrected_response").isNotNull(), "correction").otherwise("rating"),
        "equals_original": F.coalesce(F.col("corrected_response") == F.col("original_response"), F.lit(False))})


def query_pattern(question: Column) -> Column:
    """Question with business terms replaced by placeholders, as substrings."""
    pattern = F.lower(question)
    for term, placeholder in PATTERN_TERMS.items():
        pattern = F.replace(pattern, F.lit(term), F.lit(placeholder))
    return pattern


def pending_corrections(feedback: DataFrame) -> DataFrame:
    return feedback.filter((F.col("processing_status") == "pending") & (F.col("feedback_type") == "correction"))


def training_rows(feedback: DataFrame) -> DataFrame:
    """Training rows of pending corrections. A feedback gives one row at most, so its id serves as the row's id."""
    return pending_corrections(feedback).filter("corrected_response IS NOT NULL").select(
        F.col("id").alias("training_id"), F.col("id").alias("feedback_id"), *GROUP, query_pattern(F.col("original_query")).alias("query_pattern"),
        F.col("corrected_response").alias("correct_response"), F.col("original_response").alias("incorrect_response"),
        F.col("feedback_notes").alias("improvement_notes"), F.lit(1.0).cast("decimal(3,2)").alias("confidence_weight"),
        F.lit("pending").alias("status"), F.lit(0).alias("times_used"))


def rejected_corrections(feedback: DataFrame) -> DataFrame:
    """Pending corrections without a text: they are logged and stay pending."""
    return pending_corrections(feedback).filter("corrected_response IS NULL").select("id", *GROUP, F.lit("correct_response must not be null").alias("error"))


def mark_reviewed(feedback: DataFrame, now: Column) -> DataFrame:
    """Feedback after processing: the accepted rows are reviewed by the system."""
    taken = (F.col("processing_status") == "pending") & (F.col("feedback_type") == "correction") & F.col("corrected_response").isNotNull()
    return feedback.withColumns({
        "processed_at": F.when(taken, now), "processed_by": F.when(taken, "system"),
        "processing_status": F.when(taken, "reviewed").otherwise(F.col("processing_status"))})


def improvement_log(training: DataFrame) -> DataFrame:
    """One row per source and company. The ids are in ``improvement_log_ids``."""
    counted = training.groupBy(*GROUP).agg(F.count("*").alias("processed"))
    numbered = number_rows(counted, GROUP, "log_id", F.lit(0))
    return numbered.select(
        "log_id", *GROUP, F.lit("content_update").alias("improvement_type"),
        F.concat(F.lit("Processed "), F.col("processed").cast("string"), F.lit(" user corrections")).alias("description"),
        F.lit("ingestion_job").alias("implementation_method"), F.lit("in_progress").alias("status"))


def improvement_log_ids(training: DataFrame) -> DataFrame:
    """The training rows of each log row, as rows: their number grows with the corrections of one source."""
    log = improvement_log(training).select("log_id", *GROUP)
    return training.select("training_id", *GROUP).join(log, GROUP).select("log_id", "training_id")


def correction_documents(training: DataFrame, now: Column) -> DataFrame:
    """Documents built from corrections; missing notes read ``None``."""
    return training.select(
        "training_id", "query_pattern", F.col("correct_response").alias("correct_sql"),
        F.concat(F.lit("Corrected based on user feedback: "), F.coalesce("improvement_notes", F.lit("None"))).alias("explanation"),
        F.lit("user_corrections").alias("category"), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"))


def processing_result(feedback: DataFrame) -> DataFrame:
    """Outcome per source and company: nothing pending, or how many corrections were taken."""
    pending = (F.col("processing_status") == "pending") & (F.col("feedback_type") == "correction")
    counted = feedback.groupBy(*GROUP).agg(count_if(pending, "pending"), count_if(pending & F.col("corrected_response").isNotNull(), "processed"))
    return counted.select(*GROUP, F.when(F.col("pending") == 0, "no_pending_feedback").otherwise("success").alias("status"), "processed")


def training_status(feedback: DataFrame, log: DataFrame) -> DataFrame:
    """Pending and processed feedback with the newest completed improvement."""
    status = F.col("processing_status")
    counts = feedback.groupBy(*GROUP).agg(count_if(status == "pending", "pending_feedback"), count_if(status.isin("applied", "reviewed"), "processed_feedback"))
    last = log.filter("status = 'completed'").groupBy(*GROUP).agg(F.max("completed_at").alias("last_update"))
    return counts.join(last, GROUP, "left")


def dry_run(feedback: DataFrame) -> DataFrame:
    return pending_corrections(feedback).groupBy(*GROUP).agg(F.count("*").alias("would_process"))


def pending_report(feedback: DataFrame) -> DataFrame:
    return feedback.filter("processing_status = 'pending'").groupBy("kb_id").agg(F.count("*").alias("n"))


def category_report(feedback: DataFrame) -> DataFrame:
    """Feedback per problem category; a missing category is a group of its own."""
    return feedback.groupBy("kb_id", "problem_category").agg(F.count("*").alias("n"))


def usage_report(training: DataFrame) -> DataFrame:
    return training.select("kb_id", "query_pattern", "times_used", "last_used_at", "id").orderBy(F.desc("times_used"), "id")


def newest_improvements(log: DataFrame, source: str, n: int = 10) -> DataFrame:
    return log.filter(F.col("kb_id") == source).orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def completed_improvements(log: DataFrame) -> DataFrame:
    return log.filter("status = 'completed'").select("id", "kb_id", "improvement_type", "status", "success_metrics")


def relevant_corrections(questions: DataFrame, training: DataFrame) -> DataFrame:
    """Corrections whose pattern is that of the question, same company: how many there are and the newest one.

    Corrections are reduced to one row per pattern first, so a popular pattern does not multiply questions by corrections.
    """
    newest = training.groupBy("company_id", "query_pattern").agg(
        F.count("*").alias("corrections"), F.max("training_id").alias("newest_id"), F.max_by("correct_response", "training_id").alias("newest_response"))
    patterned = questions.select("question_id", "company_id", query_pattern(F.col("query_text")).alias("query_pattern"))
    return patterned.join(newest, ["company_id", "query_pattern"], "left").withColumn("corrections", F.coalesce("corrections", F.lit(0)))
