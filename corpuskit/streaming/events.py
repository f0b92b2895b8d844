"""File events as a stream: routing, debouncing, and applying them to the tables."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from corpuskit.functions import text as T

from corpuskit.sources.files import is_wanted_path

#: Watched folders of one broadcast row; more become several rows.
WATCHED_AT_ONCE = 10_000


def route_events(events: DataFrame, watched: DataFrame) -> DataFrame:
    """``(ts, path, old_path, action)`` of events ``(ts, event_type, path, dest_path)``; stateless, for streams and tables.

    Deletes act as they are. A move inside the watched folders is a rename, or a
    create if its source was no wanted file; a move out of them is a delete, one
    into them a create. Unwanted paths are left out. ``watched`` is the table of
    watched folders, a setting: some ``WATCHED_AT_ONCE`` of them meet the events
    at a time as one broadcast row. A ``seq`` of the events is kept.
    """
    roots = watched.select(F.regexp_replace("path", "/+$", "").alias("_root")).where("_root is not null").distinct()
    blocks = max(1, -(-roots.count() // WATCHED_AT_ONCE))
    rows, sides = events, [f"_roots{i}" for i in range(blocks)]
    for i, name in enumerate(sides):
        some = roots.where(F.pmod(F.xxhash64("_root"), F.lit(blocks)) == i)
        rows = rows.join(F.broadcast(some.agg(F.collect_set("_root").alias(name))))
    inside = lambda c: functools.reduce(operator.or_, [F.arrays_overlap(T.ancestors(F.col(c)), name) for name in sides])
    moved = F.col("event_type") == "moved"
    source_ok = inside("path") & is_wanted_path(F.col("path"))
    dest_ok = F.coalesce(inside("dest_path") & is_wanted_path(F.col("dest_path")), F.lit(False))
    action = (
        F.when(moved & source_ok & dest_ok, "rename").when(moved & dest_ok, "create").when(moved & source_ok, "delete")
        .when(~moved & source_ok & (F.col("event_type") == "deleted"), "delete").when(~moved & source_ok & (F.col("event_type") == "created"), "create").when(~moved & source_ok, "modify")
    )
    rows = rows.withColumn("action", action).where("action is not null")
    gone = F.col("action") == "delete"
    path = F.when(moved & ~gone, F.col("dest_path")).otherwise(F.col("path")).alias("path")
    return rows.select("ts", path, F.when(F.col("action") == "rename", F.col("path")).alias("old_path"), "action", *[c for c in events.columns if c == "seq"])


def debounce(events: DataFrame, gap: str = "2 seconds", delay: str = "1 minute", key: str = "path", created: str = "is_create") -> DataFrame:
    """``(key, first, last, n_events, is_new)``: one row per burst, a run of events with no longer pause than ``gap``.

    Works on tables and, in append mode, on streams, where events later than
    ``delay`` are dropped and a burst comes out once the watermark has passed it.
    """
    rows = events.withWatermark("ts", delay) if events.isStreaming else events
    burst = rows.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_events"), F.bool_or(created).alias("is_new"), F.max("ts").alias("last"))
    return burst.select(key, F.col("w.start").alias("first"), "last", "n_events", "is_new")


def latest_actions(batch: DataFrame) -> DataFrame:
    """Of one batch the last action of each path; equal times are told apart by ``seq``, if there is one, and then by the action."""
    order = F.struct("ts", *[c for c in batch.columns if c == "seq"], "action", "old_path")
    return batch.groupBy("path").agg(F.max(order).alias("x")).select("path", "x.action", "x.old_path", "x.ts")


def index_stream(events: DataFrame, watched: DataFrame, handlers: dict[str, Callable[[DataFrame, int], None]], checkpoint: str):
    """Start a query that hands each batch's latest actions to handlers by action: create, modify, delete, rename.

    A batch may come again after a failure, so handlers must write by path and batch number.
    """

    def apply(batch: DataFrame, number: int) -> None:
        last = latest_actions(batch).persist()
        for action, fn in handlers.items():
            fn(last.where(F.col("action") == action), number)
        last.unpersist()

    return route_events(events, watched).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).start()
