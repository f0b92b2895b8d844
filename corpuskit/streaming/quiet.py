"""Debouncing on a live stream: a burst comes out once its path has been quiet, with no later event needed."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Bursts(StatefulProcessor):
    """Per path: its open bursts in the order of their times, and one timer."""

    def __init__(self, gap: int):
        self.gap = gap  # microseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("bursts", "held string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = json.loads(self.held.get()[0]) if self.held.exists() else {"bursts": [], "due": None}
        bursts = before["bursts"]
        for pdf in rows:
            bursts += [[t, t, 1, bool(new)] for t, new in zip(pdf["at"].tolist(), pdf["is_new"].tolist())]
        merged: list[list] = []
        for first, last, n, new in sorted(bursts):
            if merged and first <= merged[-1][1] + self.gap:
                old = merged[-1]
                merged[-1] = [old[0], max(old[1], last), old[2] + n, old[3] or new]
            else:
                merged.append([first, last, n, new])
        if before["due"] is not None:
            self.handle.deleteTimer(before["due"])
        due = timerValues.getCurrentProcessingTimeInMs() + max(1, self.gap // 1000)
        self.handle.registerTimer(due)
        self.held.update((json.dumps({"bursts": merged, "due": due}),))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        bursts = json.loads(self.held.get()[0])["bursts"] if self.held.exists() else []
        self.held.clear()
        if bursts:
            first, last, n, new = zip(*bursts)
            yield pd.DataFrame({"key": [key[0]] * len(bursts), "first": first, "last": last, "n_events": n, "is_new": new})

    def close(self) -> None:
        pass


def quiet_bursts(events: DataFrame, gap_seconds: float = 2.0, key: str = "path", created: str = "is_create") -> DataFrame:
    """``(key, first, last, n_events, is_new)`` of a stream: bursts as ``debounce`` has them, out ``gap_seconds`` after the last arrival.

    Each path has one timer, which every arrival for it sets anew; when it runs
    out, all bursts that have gathered come out. Late events join the bursts they
    belong to as long as these are held; afterwards they make a burst of their
    own, for nothing is dropped. A null path is a path. State is one short text
    a path between its first arrival and its firing; the stream keeps it in
    RocksDB, which this sets for the session.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    rows = events.where("ts is not null").select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.coalesce(F.col(created), F.lit(False)).alias("is_new"))
    out = rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=_Bursts(round(gap_seconds * 1_000_000)),
        outputStructType="key string, first long, last long, n_events long, is_new boolean",
        outputMode="append",
        timeMode="processingTime",
    )
    return out.select(F.col("key").alias(key), F.timestamp_micros("first").alias("first"), F.timestamp_micros("last").alias("last"), "n_events", "is_new")
