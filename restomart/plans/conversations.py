"""Chat history jobs over messages (conversation_id, role, content, created_at or a turn)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from restomart.functions.text import preview, trim_all


def list_conversations(messages: DataFrame, at: str = "created_at", limit: int = 50) -> DataFrame:
    """Most recently touched conversations with the start of their first user message."""
    by_user = F.col("role") == "user"
    return (
        messages.groupBy("conversation_id").agg(
            F.min_by(F.when(by_user, preview("content")), F.when(by_user, F.col(at))).alias("preview"),
            F.count(F.lit(1)).alias("message_count"), F.min(at).alias("created_at"),
            F.max(at).alias("updated_at"))
        .orderBy(F.desc("updated_at"), "conversation_id").limit(limit)
    )


def conversation_messages(messages: DataFrame, conversation_id, at: str = "created_at") -> DataFrame:
    return messages.filter(F.col("conversation_id") == conversation_id).orderBy(at)


def conversation_exists(conversations: DataFrame, conversation_id) -> bool:
    return not conversations.filter(F.col("id") == conversation_id).limit(1).isEmpty()


def touched_at(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Conversations with ``updated_at`` moved to their newest message."""
    newest = messages.groupBy(F.col("conversation_id").alias("id")).agg(
        F.max("created_at").alias("_newest"))
    return (conversations.join(newest, "id", "left")
            .withColumn("updated_at", F.greatest("created_at", "_newest")).drop("_newest"))


def append_messages(messages: DataFrame, path: str) -> None:
    messages.write.mode("append").parquet(path)


def history_lines(messages: DataFrame, at: str = "created_at") -> DataFrame:
    """``User: ...`` / ``Assistant: ...`` lines, all but each conversation's last message.

    Lines stay rows: a conversation of any length is never gathered in one place.
    """
    last = messages.groupBy("conversation_id").agg(F.max(at).alias("_last"))
    speaker = F.when(F.col("role") == "user", "User: ").otherwise("Assistant: ")
    return (
        messages.join(last, "conversation_id").filter(F.col(at) < F.col("_last"))
        .select("conversation_id", F.col(at).alias("position"),
                F.concat(speaker, "content").alias("line"))
    )


def history_text(messages: DataFrame, conversation_id, at: str = "created_at") -> DataFrame:
    """The lines of one conversation as one text, for showing it."""
    lines = history_lines(messages.filter(F.col("conversation_id") == conversation_id), at)
    ordered = F.array_sort(F.collect_list(F.struct("position", "line")))
    return lines.groupBy("conversation_id").agg(F.concat(
        F.lit("Previous conversation:\n"),
        F.array_join(F.transform(ordered, lambda x: x["line"]), "\n"), F.lit("\n\n")).alias("context"))


def stored_answers(captured: DataFrame) -> DataFrame:
    """Which assistant messages of an exchange are kept.

    ``captured``: conversation_id, partial, streamed, charts (JSON array or null). With charts
    the partial answer (if any) and the streamed one with its charts are kept, otherwise the
    streamed one or, failing that, the partial one.
    """
    filled = lambda c: F.coalesce(F.length(trim_all(c)) > 0, F.lit(False))
    charted = F.coalesce(F.json_array_length("charts") > 0, F.lit(False))
    text = lambda step, c, charts: F.struct(
        F.lit(step).alias("step"), F.coalesce(c, F.lit("")).alias("content"), charts.alias("charts"))
    none = F.lit(None).cast("string")
    partial, streamed = text(1, "partial", none), text(2, "streamed", none)
    kept = (
        F.when(charted, F.array_compact(F.array(
            F.when(filled("partial"), partial), text(2, "streamed", F.col("charts")))))
        .when(filled("streamed"), F.array(streamed))
        .when(filled("partial"), F.array(partial))
    )
    keys = [c for c in captured.columns if c not in ("partial", "streamed", "charts")]
    return captured.select(*keys, F.explode(kept).alias("m")).select(
        *keys, "m.step", F.lit("assistant").alias("role"), "m.content", "m.charts")
