"""Conversation history and prompt parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Kept messages of a session, turns in a prompt, seconds a session is kept; known roles.
KEPT_MESSAGES, PROMPT_TURNS, EXPIRY_S = 30, 5, 86_400
ROLES = ("user", "assistant", "system")


def role(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low.isin(*ROLES), low).otherwise("user")


def recent(messages: DataFrame, keep: int = KEPT_MESSAGES, now: Column | None = None, ttl_s: int = EXPIRY_S) -> DataFrame:
    """The last messages of each session; place counts from the oldest kept. With now, sessions whose last message is
    older than ttl_s are gone: each message renews the whole session."""
    if now is not None:
        alive = messages.groupBy("session_id").agg(F.max("at").alias("__last")).where(F.col("__last") + F.make_dt_interval(secs=F.lit(ttl_s)) >= now)
        messages = messages.join(alive.select("session_id"), "session_id", "left_semi")
    last = messages.withColumn("n", F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("at"), F.desc("msg_id")))).where(F.col("n") <= keep)
    return last.withColumn("place", F.row_number().over(W.partitionBy("session_id").orderBy("at", "msg_id")).cast("bigint")).drop("n")


def prompt_history(messages: DataFrame, turns: int = PROMPT_TURNS) -> DataFrame:
    """(session_id, history): the last turns as lines User: / Assistant:."""
    held = recent(messages, turns * 2).withColumn("line", F.concat(F.when(role(F.col("role")) == "user", "User").otherwise("Assistant"), F.lit(": "), F.trim(F.coalesce("content", F.lit("")))))
    return held.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("x")).select("session_id", F.array_join(F.transform("x", lambda r: r["line"]), "\n").alias("history"))


def context(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """(q_id, context): numbered sources of a question. docs may say which are files (source_type, pages)."""
    kinds = [c for c in ("source_type", "pages") if c in docs.columns]
    held = hits.join(docs.select(F.col("doc_id").alias("vec_id"), "title", "text", *kinds), "vec_id")
    title = F.coalesce("title", F.lit(""))
    head = F.concat(F.lit("[Page "), F.col("place"), F.lit(": "), title, F.lit("] "))
    if len(kinds) == 2:
        head = F.when(F.col("source_type") == "pdf_document", F.concat(F.lit("[PDF Document "), F.col("place"), F.lit(": "), title, F.lit(" ("), F.coalesce("pages", F.lit(0)), F.lit(" pages)] "))).otherwise(head)
    line = F.concat(head, F.substring(F.coalesce("text", F.lit("")), 1, 1000))
    return held.groupBy("q_id").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("x")).select("q_id", F.array_join(F.transform("x", lambda r: r["line"]), "\n\n").alias("context"))


def without_history(messages: DataFrame) -> DataFrame:
    """(msg_id): messages that open their session, for which the response cache may be asked."""
    return messages.groupBy("session_id").agg(F.min_by("msg_id", F.struct("at", "msg_id")).alias("msg_id")).select("msg_id")
