"""Conversations from logged sessions, and message histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafspan.functions import text as tx

HISTORY_MESSAGES = 8
HISTORY_CHARS = 4000
HISTORY_NOTE = "\n...[history truncated]"


def with_conversation(sessions: DataFrame) -> DataFrame:
    """Sessions (id, timestamp, context_session_id, ...) with conversation_id, and the id where a timestamp is missing."""
    own = F.nullif(F.trim("context_session_id"), F.lit(""))
    return sessions.withColumn("conversation_id", F.coalesce(own, "id")).withColumn(
        "timestamp", F.coalesce(F.nullif("timestamp", F.lit("")), "id")
    )


def summaries(sessions: DataFrame) -> DataFrame:
    """A row per conversation: its latest session's fields, last title that is not blank, number and ids of sessions."""
    order = F.struct("timestamp", "id")
    title = F.trim(F.coalesce("title", F.lit("")))
    ids = F.array_sort(F.collect_list(order))
    return (
        with_conversation(sessions)
        .groupBy("conversation_id")
        .agg(
            F.max("timestamp").alias("timestamp"),
            F.max_by(F.coalesce("query", F.lit("")), order).alias("query"),
            F.max_by(F.coalesce("doc_name", F.lit("")), order).alias("doc_name"),
            F.max_by(F.coalesce("total_turns", F.lit(0)), order).alias("total_turns"),
            F.coalesce(F.max_by(title, F.when(title != "", order)), F.lit("")).alias("title"),
            F.count("*").alias("entry_count"),
            F.array_join(F.transform(ids, lambda x: x["id"]), ",").alias("session_ids"),
        )
    )


def entries(sessions: DataFrame, conversation: str) -> DataFrame:
    """The sessions of one conversation in time order, with defaults for missing fields."""
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    rows = with_conversation(sessions).filter(F.col("conversation_id") == conversation)
    order = Window.orderBy("timestamp", "id")
    return rows.select(
        F.row_number().over(order).cast("long").alias("seq"),
        "id",
        "timestamp",
        blank("doc_name"),
        blank("query"),
        blank("title"),
        blank("answer"),
        F.coalesce("total_turns", F.lit(0)).cast("long").alias("total_turns"),
    )


def renamed(sessions: DataFrame, conversation: str, title: str) -> DataFrame:
    """All sessions, those of one conversation with a new title."""
    own = with_conversation(sessions).withColumn(
        "title", F.when(F.col("conversation_id") == conversation, F.lit(title)).otherwise(F.col("title"))
    )
    return own


def without(sessions: DataFrame, conversation: str) -> DataFrame:
    """All sessions but those of one conversation."""
    return with_conversation(sessions).filter(F.col("conversation_id") != conversation)


def history(messages: DataFrame, most: int = HISTORY_MESSAGES) -> DataFrame:
    """The last ``most`` messages of each conversation, and of those the user's and assistant's that are not blank, clipped.

    ``messages`` has conversation_id, seq, role, content. The cut comes first, so that fewer may stay.
    """
    last = Window.partitionBy("conversation_id").orderBy(F.desc("seq"))
    recent = messages.withColumn("_r", F.row_number().over(last)).filter(F.col("_r") <= most)
    content = F.regexp_replace("content", r"^\s+|\s+$", "")
    rows = recent.filter("role IN ('user', 'assistant')").withColumn("content", content).filter("content <> ''")
    return rows.select("conversation_id", "seq", "role", tx.clip(F.col("content"), HISTORY_CHARS, HISTORY_NOTE).alias("content"))


def system_text(messages: DataFrame) -> DataFrame:
    """(conversation_id, system, others): system messages joined by line ends, and the number of others."""
    parts = F.array_sort(F.collect_list(F.when(F.col("role") == "system", F.struct("seq", "content"))))
    return messages.groupBy("conversation_id").agg(
        F.array_join(F.transform(parts, lambda x: x["content"]), "\n").alias("system"),
        F.count(F.when(F.col("role") != "system", 1)).alias("others"),
    )
