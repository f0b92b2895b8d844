"""The index that follows file events: any cut into batches ends alike; restarts, compaction, streams; text hooks."""

import random
import re

import pytest

from corpuskit.sources.files import read_text
from corpuskit.streaming import store as S
from corpuskit.streaming.lifetimes import lifetimes
from corpuskit.streaming.store import IndexStore

EVENTS = "ts long, seq long, path string, old_path string, action string"


class Disk:
    """Files as they are; ``load`` reads them as a store does."""

    def __init__(self, spark, **files):
        self.spark, self.files = spark, dict(files)

    def load(self, paths):
        rows = [(x.file_path, self.files[x.file_path]) for x in paths.distinct().collect() if x.file_path in self.files]
        return self.spark.createDataFrame(rows, "file_path string, text string")


def log_of(seed, many):
    """Random file operations: ``(event, the files after it)``."""
    rng, files, out = random.Random(seed), {"/w/unknown.txt": "never seen"}, []
    names = [f"/w/{c}.txt" for c in "abcde"] + ["/w/unknown.txt"]
    for i in range(many):
        kind, path = rng.choice(["create", "modify", "modify", "delete", "rename", "rename", "rename"]), rng.choice(names)
        if kind in ("create", "modify"):
            kind = "modify" if path in files else "create"
            files[path] = rng.choice(["alpha beta", "gamma", " ", f"text {i}"])
            event = (path, None, kind)
        elif path not in files:
            continue
        elif kind == "delete":
            del files[path]
            event = (path, None, "delete")
        else:
            to = rng.choice(names)
            files[to] = files.pop(path)
            event = (to, path, "rename")
        out.append(((i // 3, i, *event), dict(files)))  # times repeat, numbers don't
    return out


def one_by_one(log):
    """What applying the events one at a time leaves: path to (key of the first event, text)."""
    state = {}
    for (ts, seq, path, old, action), files in log:
        if action == "delete":
            state.pop(path, None)
        elif action == "rename":
            if path == old:
                continue
            state[path] = state.pop(old, None) or [(path, ts, seq), files[path]]
        else:
            state.setdefault(path, [(path, ts, seq), None])[1] = files[path]
    return {p: (key, text) for p, (key, text) in state.items() if text.strip()}


def state_of(store):
    import uuid

    docs = {x.file_path: (x.doc_id, x.n_chars, x.file_hash) for x in store.documents().collect()}
    ids = {d for d, *_ in docs.values()}
    assert {x.doc_id for x in store.chunks().collect()} == ids == {x.doc_id for x in store.postings().collect()}
    return docs, {x.file_path: x.text for x in store.chunks().withColumnRenamed("content", "text").join(store.documents().select("doc_id", "file_path"), "doc_id").collect()}, uuid


@pytest.mark.parametrize("seed,cuts", [(2, [9, 30]), (4, [7])])
def test_any_cut_ends_as_one_by_one(spark, tmp_path, seed, cuts):
    log = log_of(seed, 60)
    disk = Disk(spark)
    store = IndexStore(spark, f"file://{tmp_path}/index", disk.load)
    bounds = [0, *cuts, len(log)]
    for number, (a, b) in enumerate(zip(bounds, bounds[1:])):
        disk.files = log[b - 1][1]
        rows = [e for e, _ in log[a:b]]
        random.Random(seed).shuffle(rows)
        store.apply(spark.createDataFrame(rows + rows[:2], EVENTS), number)  # some come twice
    docs, texts, _ = state_of(store)
    want = one_by_one(log)
    assert texts == {p: t for p, (_, t) in want.items()} and want
    keys = {p: k for p, (k, _) in want.items()}
    ids = {r.path: r.id for r in spark.createDataFrame([(p, f"{k[0]}:{k[1]}:{k[2]}") for p, k in keys.items()], "path string, name string").select("path", S.T.uuid5(S.F.col("name")).alias("id")).collect()}
    assert {p: d for p, (d, *_) in docs.items()} == ids


def test_one_by_one_in_the_store_itself(spark, tmp_path):
    log = log_of(5, 9)
    found = []
    for size in (1, len(log)):
        disk = Disk(spark)
        store = IndexStore(spark, f"file://{tmp_path}/index{size}", disk.load)
        for number, a in enumerate(range(0, len(log), size)):
            disk.files = log[min(a + size, len(log)) - 1][1]
            store.apply(spark.createDataFrame([e for e, _ in log[a : a + size]], EVENTS), number)
        found.append(state_of(store)[:2])
    assert found[0] == found[1]


def test_chains_and_new_files_that_move(spark, tmp_path):
    disk = Disk(spark, **{"/a": "one"})
    store = IndexStore(spark, f"file://{tmp_path}/index", disk.load)
    rows = lambda *r: spark.createDataFrame([(i, 0, *x) for i, x in enumerate(r)], EVENTS)
    store.apply(rows(("/a", None, "create")), 0)
    first = store.documents().first().doc_id
    disk.files = {"/c": "one", "/y": "two"}
    store.apply(rows(("/b", "/a", "rename"), ("/x", None, "create"), ("/c", "/b", "rename"), ("/y", "/x", "rename")), 1)
    got = {x.file_path: x.doc_id for x in store.documents().collect()}
    assert got["/c"] == first and set(got) == {"/c", "/y"}
    chain = lifetimes(rows(*[(f"/p{i + 1}", f"/p{i}", "rename") for i in range(40)])).where("not ended").collect()
    assert [(x.start, x.path, x.born_path) for x in chain] == [("/p0", "/p40", "/p1")]


def test_a_file_that_was_gone_is_read_where_it_went(spark, tmp_path):
    disk = Disk(spark, **{"/b": "text"})  # the disk is ahead of the events
    store = IndexStore(spark, f"file://{tmp_path}/index", disk.load)
    store.apply(spark.createDataFrame([(1, 1, "/a", None, "create")], EVENTS), 0)
    assert store.documents().count() == 0
    store.apply(spark.createDataFrame([(2, 2, "/b", "/a", "rename")], EVENTS), 1)
    assert [(x.file_path, x.n_chars) for x in store.documents().collect()] == [("/b", 4)]
    assert store.chunks().count() == 1


def test_restarts_and_compaction(spark, tmp_path):
    disk = Disk(spark, **{"/a": "alpha", "/b": "beta"})
    store = IndexStore(spark, f"file://{tmp_path}/index", disk.load)
    one = lambda ts, *r: spark.createDataFrame([(ts, 0, *r)], EVENTS)
    store.apply(one(1, "/a", None, "create"), 0, "first")
    store.apply(one(2, "/b", None, "create"), 0, "second")  # another checkpoint begins at 0 again
    assert {x.file_path for x in store.documents().collect()} == {"/a", "/b"}
    disk.files["/a"] = "changed"
    store.apply(one(1, "/a", None, "modify"), 0, "first")  # came again after it was done
    assert store.documents().where("n_chars = 7").count() == 0
    for round_ in (1, 2):
        before = sorted(map(tuple, store.documents().drop("content").collect())), sorted(map(tuple, store.postings().select("doc_id", "term").collect()))
        store.compact()
        assert (sorted(map(tuple, store.documents().drop("content").collect())), sorted(map(tuple, store.postings().select("doc_id", "term").collect()))) == before
        assert len(list((tmp_path / "index").glob("generation=*/chunks/part=[0-9]*"))) <= 3
        store.apply(one(2, "/b", None, "modify"), 0, "second")
        store.apply(one(3 + round_, "/a", None, "modify"), round_, "first")
    assert {x.file_path: x.n_chars for x in store.documents().collect()} == {"/a": 7, "/b": 4}
    store.apply(spark.createDataFrame([], EVENTS), 9, "first")
    store.apply(one(9, "/a", None, "delete"), 10, "first")
    assert [x.file_path for x in store.documents().collect()] == ["/b"] and {x.term for x in store.postings().collect()} == {"beta"}


def test_load_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "PATHS_AT_ONCE", 2)
    names = ["a[1].txt", "b{x}.txt", "c*.txt", "d.txt"]
    for n in names:
        (tmp_path / n).write_text(n)
    paths = spark.createDataFrame([(f"{tmp_path}/{n}",) for n in [*names, "gone.txt", "d.txt"]], "file_path string")
    assert sorted((x.file_path, x.text) for x in S.load_files(paths).collect()) == sorted((f"{tmp_path}/{n}", n) for n in names)
    assert S.load_files(paths.limit(0)).count() == 0


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "ws").mkdir()
    (tmp_path / "ws" / "a.txt").write_text("alpha beta")
    path = f"{tmp_path}/ws/a.txt"
    rows = spark.createDataFrame([(1, "created", path, None), (2, "created", f"{tmp_path}/ws/a.tmp", None)], "ts long, event_type string, path string, dest_path string")
    rows.write.parquet(f"{tmp_path}/events")
    store = IndexStore(spark, f"file://{tmp_path}/index")
    watched = spark.createDataFrame([(f"{tmp_path}/ws/",)], "path string")
    for run in ("checkpoint", "again"):  # a new checkpoint reads the same events again
        query = store.follow(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/events"), watched, f"{tmp_path}/{run}", compact_every=1)
        query.processAllAvailable()
        query.stop()
        assert [x.file_path for x in store.documents().collect()] == [path]
        assert {x.term for x in store.postings().collect()} == {"alpha", "beta"}


def test_text_hooks_that_fail_are_skipped(spark):
    files = spark.createDataFrame([("/a.txt", bytearray(b"one")), ("/b.txt", bytearray(b"two")), ("/c.bin", bytearray(b"x"))], "file_path string, content binary")

    def fails(text, path):
        if path == "/a.txt":
            raise ValueError(text)
        return text + "!"

    got = {x.file_path: x.text for x in read_text(files, hooks_on_text=[fails, lambda t, p: t.upper()]).collect()}
    assert got == {"/a.txt": "ONE", "/b.txt": "TWO!", "/c.bin": None}


def test_events_are_dealt_once_and_sorted_once(spark):
    """Intervals come from one sort of the marks by path, repeated events and touches among them, not from aggregates of them all."""
    e = [(1, "/a", None, "create"), (1, "/a", None, "create"), (2, "/a", None, "modify"), (3, "/b", "/a", "rename"), (4, "/b", None, "modify"), (5, "/a", None, "modify"), (6, "/a", None, "delete"), (7, "/c", None, "delete")]
    found = lifetimes(spark.createDataFrame(e, "ts long, path string, old_path string, action string"))
    assert {(x.start, x.born_at and x.born_at.ts, x.born_path, x.touched, x.path, x.ended) for x in found.collect()} == {("/a", 1, "/a", True, "/b", False), ("/b", None, None, False, "/b", True), (None, 5, "/a", True, "/a", True), ("/c", None, None, False, "/c", True)}
    assert not {"begin", "end", "touch"} & set(re.findall(r"\w+", found._jdf.queryExecution().optimizedPlan().toString()))
