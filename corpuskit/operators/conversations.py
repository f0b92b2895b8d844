"""Conversations, their summaries, and dashboard figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def list_conversations(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Conversations with their number of messages, newest first."""
    counts = messages.groupBy("conv_id").agg(F.count("*").alias("n_messages"))
    return conversations.join(counts, "conv_id", "left").withColumn("n_messages", F.coalesce("n_messages", F.lit(0))).orderBy(F.desc("created_at"), "conv_id")


def load_conversation(messages: DataFrame, conv_id) -> DataFrame:
    return messages.where(F.col("conv_id") == conv_id).orderBy("turn")


def upsert_messages(messages: DataFrame, incoming: DataFrame) -> DataFrame:
    """Messages by ``id``: content and status of the last version (by ``seq``), the first creation time."""
    every = messages.unionByName(incoming)
    return every.groupBy("id").agg(*(F.max_by(c, "seq").alias(c) for c in ("conv_id", "role", "content", "status")), F.min("created_at").alias("created_at"), F.max("seq").alias("seq"))


def turn_counts(messages: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """``(conv_id, turns, summary)``: answers of the assistant, and the stored summary or null."""
    done = (F.col("role") == "assistant") & (F.col("status") == "complete" if "status" in messages.columns else F.lit(True))
    counts = messages.groupBy("conv_id").agg(F.count_if(done).alias("turns"))
    if summaries is None:
        return counts.withColumn("summary", F.lit(None).cast("string"))
    return counts.join(summaries.select("conv_id", "summary"), "conv_id", "left")


def summary_due(messages: DataFrame, every_n: int = 10, oldest_n: int = 16) -> DataFrame:
    """``(conv_id, turns, transcript)`` of conversations at a multiple of ``every_n`` answers: their oldest messages as lines."""
    due = turn_counts(messages).where((F.col("turns") > 0) & (F.col("turns") % every_n == 0)).select("conv_id", "turns")
    said = messages.where(F.col("role").isin("user", "assistant"))
    first = said.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).where(F.col("n") <= oldest_n)
    line = F.concat(F.upper("role"), F.lit(": "), F.col("text"))
    told = first.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("l")))), lambda s: s["l"]), "\n").alias("transcript"))
    return due.join(told, "conv_id")


def dashboard_stats(documents: DataFrame, chunks: DataFrame, errors: DataFrame) -> DataFrame:
    """One row: documents, characters, chunks and files whose errors are live."""
    live = errors.join(documents.select("file_path"), "file_path", "left_anti")
    docs = documents.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("characters"))
    return docs.join(F.broadcast(chunks.agg(F.count("*").alias("chunks")))).join(F.broadcast(live.agg(F.countDistinct("file_path").alias("live_errors"))))


def recent_files(documents: DataFrame, limit: int = 5) -> DataFrame:
    return documents.orderBy(F.desc("indexed_at"), F.desc("doc_id")).limit(limit)


def pending_counts(rows: DataFrame) -> DataFrame:
    """``(status, n)`` of recommendations or proposals."""
    return rows.groupBy("status").agg(F.count("*").alias("n"))
