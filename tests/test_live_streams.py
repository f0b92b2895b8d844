"""Streams that run: debouncing by timers, and the source of file changes, down to the index."""

import datetime as dt
import time

from corpuskit.sources.watched import watch_files
from corpuskit.streaming import events as E
from corpuskit.streaming.quiet import quiet_bursts
from corpuskit.streaming.store import IndexStore

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "ts timestamp, path string, is_create boolean"


def until(done, seconds=90):
    end = time.time() + seconds
    while not done():
        assert time.time() < end, "took too long"
        time.sleep(0.3)


def test_timers_give_the_bursts_of_the_table(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [(at(s), p, c) for s, p, c in [(0, "a", True), (1, "a", False), (1, "a", False), (3, "a", False), (10, "a", False), (0, "b", False), (2, "b", False), (500, "z", False), (4, None, None)]]
    late = [(at(s), p, c) for s, p, c in [(8.5, "a", True), (4.9, "a", False), (-1, "b", True), (1, "a", False)]]
    path = f"{tmp_path}/in"
    spark.createDataFrame(rows[::-1], SCHEMA).coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    q = quiet_bursts(stream, 12.0).writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        until(lambda: q.lastProgress is not None and sum(p["numInputRows"] for p in q.recentProgress) >= len(rows))
        spark.createDataFrame(late, SCHEMA).coalesce(1).write.mode("append").parquet(path)  # before any timer has run out
        until(lambda: sum(p["numInputRows"] for p in q.recentProgress) >= len(rows) + len(late))
        want = {(x.path, x.first, x.last, x.n_events, x.is_new) for x in E.debounce(spark.createDataFrame(rows + late, SCHEMA).fillna(False, ["is_create"]), "12 seconds").collect()}
        until(lambda: spark.table("live").count() >= len(want))  # z comes out too, though nothing later arrives
    finally:
        q.stop()
    assert {tuple(x) for x in spark.table("live").collect()} == want


def test_bursts_are_split_where_the_table_splits_them(spark, tmp_path):
    rows = [(T0 + dt.timedelta(seconds=s), "a", False) for s in (0, 1.5, 3.5, 5.4, 7.5)]  # a pause of exactly the gap, and others
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    q = quiet_bursts(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("split").start()
    want = {tuple(x) for x in E.debounce(spark.createDataFrame(rows, SCHEMA)).collect()}
    try:
        until(lambda: spark.table("split").count() >= len(want))
    finally:
        q.stop()
    assert {tuple(x) for x in spark.table("split").collect()} == want


def test_files_to_index_without_a_prepared_table(spark, tmp_path):
    ws = tmp_path / "ws"
    (ws / "sub").mkdir(parents=True)
    (ws / ".git").mkdir()
    (ws / "a.txt").write_text("alpha")
    (ws / "sub" / "b.md").write_text("beta")
    (ws / ".git" / "no.txt").write_text("no")
    (ws / "~$a.txt").write_text("no")
    store = IndexStore(spark, f"file://{tmp_path}/index")
    watched = spark.createDataFrame([(str(ws),)], "path string")
    start = lambda: store.follow(watch_files(spark, str(ws), f"{tmp_path}/snapshots", buckets=3), watched, f"{tmp_path}/cp", compact_every=3)
    terms = lambda: {x.term for x in store.postings().collect()}
    q = start()
    try:
        until(lambda: terms() == {"alpha", "beta"})
        (ws / "a.txt").write_text("omega")
        (ws / "c.txt").write_text("gamma")
        until(lambda: terms() == {"omega", "beta", "gamma"})
    finally:
        q.stop()
    (ws / "c.txt").unlink()  # while nothing runs
    (ws / "sub" / "d.txt").write_text("delta")
    q = start()
    try:
        until(lambda: terms() == {"omega", "beta", "delta"})
    finally:
        q.stop()
