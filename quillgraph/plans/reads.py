"""Relational reads: documents, logs, sessions and messages.  Every read is scoped to a user or a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X


def of_user(table: DataFrame, user_id: int) -> DataFrame:
    return table.where(F.col("user_id") == user_id)


def dashboards(documents: DataFrame) -> DataFrame:
    """Every user's documents with their ``place``, newest first."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("document_id"))
    return documents.withColumn("place", F.row_number().over(newest))


def dashboard(documents: DataFrame, user_id: int) -> DataFrame:
    return dashboards(of_user(documents, user_id)).orderBy("place").drop("place")


def document_logs(logs: DataFrame, document_id: int) -> DataFrame:
    return logs.where(F.col("document_id") == document_id).orderBy("created_at")


def log_line(created_at: Column, stage: Column, message: Column) -> Column:
    return F.concat(F.lit("["), F.date_format(created_at, "yyyy-MM-dd HH:mm:ss"), F.lit("] ["), stage, F.lit("] "), message)


def log_export(logs: DataFrame, documents: DataFrame | None = None, empty: str = "No logs available.") -> DataFrame:
    """One text a document, its log lines by time; documents without logs get ``empty``."""
    line = log_line(F.col("created_at"), F.col("stage"), F.col("message"))
    lines = F.array_sort(F.collect_list(F.struct("created_at", line.alias("line"))))
    out = logs.groupBy("document_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("export"))
    if documents is None:
        return out
    return documents.select("document_id").join(out, "document_id", "left").na.fill(empty, ["export"])


def sessions(messages: DataFrame) -> DataFrame:
    """Sessions from their messages: first question (80 characters) as the title, turns, last role; newest first is
    the caller's order."""
    asked = F.struct("turn", "text")
    rows = messages.groupBy("session_id").agg(F.count("*").alias("turns"), F.min(F.when(F.col("role") == "user", asked)).alias("first"), F.max(F.struct("turn", "role")).alias("last"))
    return rows.select("session_id", "turns", session_title(F.lit(""), F.coalesce("first.text", F.lit(""))).alias("title"), F.col("last.role").alias("last_role"))


def session_title(title: Column, question: Column) -> Column:
    return F.when(title == "", F.left(question, F.lit(80))).otherwise(title)


def next_session_title(sessions_: DataFrame) -> DataFrame:
    return sessions_.groupBy("document_id", "user_id").agg(F.concat(F.lit("Conversation "), (F.count("*") + 1).cast("string")).alias("title"))


def may_start(status: Column) -> Column:
    return status != "processing"


def may_delete(status: Column) -> Column:
    """A document that is being processed can't be deleted."""
    return status != "processing"


def final_status(error: Column) -> Column:
    return F.when(error.isNull(), "complete").otherwise("error")


def shown_count(n: Column) -> Column:
    return F.format_number(n, 0)


def shown_seconds(s: Column) -> Column:
    return F.format_string("%.2f s", s)


def shown_row(documents: DataFrame) -> DataFrame:
    return documents.select("document_id", "name", "status", X.progress(F.col("progress")).alias("progress"), shown_count(F.col("nodes")).alias("nodes"), shown_seconds(F.col("processing_time")).alias("time"))
