"""Files, table upkeep, conversations, and the event stream."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from corpuskit.operators import conversations as H, documents as B, ingest as A
from corpuskit.sources import files as S
from corpuskit.streaming import events as E


def test_scan_and_read(spark, tmp_path):
    for name, data in {"a/x.txt": b"caf\xc3\xa9 \xff", "a/y.md": b"m", "a/z.exe": b"", "node_modules/q.txt": b"q", "a/~$x.txt": b"l", "a/t.docx": b"doc"}.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(data)
    S.register_extractor([".docx"], lambda raw, path: raw.decode() + "!")
    try:
        got = {x.file_path.rsplit("/", 1)[-1]: x.text for x in S.read_text(S.scan_files(spark, str(tmp_path)), [F.upper]).collect()}
    finally:
        S._EXTRACTORS.clear()
    assert got == {"x.txt": "CAFÉ \ufffd", "y.md": "M", "t.docx": "DOC!"}


def test_tables_and_slides_to_text(spark):
    cells = [("d", "S", 0, 0, "Name"), ("d", "S", 0, 1, "Age"), ("d", "S", 1, 0, "Ada"), ("d", "S", 1, 1, "36"), ("d", "S", 2, 0, " "), ("d", "S", 2, 1, None), ("d", "S", 3, 2, "x")]
    assert S.cells_to_text(spark.createDataFrame(cells, "doc string, sheet string, row int, col int, value string")).first().text == "Sheet: S\nName  |  Age\nName: Ada  |  Age: 36\nx"
    par = [("d", 2, 0, "b"), ("d", 1, 1, "a2"), ("d", 1, 0, "a1"), ("d", 1, 2, " ")]
    assert S.paragraphs_to_text(spark.createDataFrame(par, "doc string, slide int, pos int, text string")).first().text == "Slide 1:\na1\na2\n\nSlide 2:\nb"


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, file_path string, workspace_path string, file_hash string")


def test_upkeep(spark):
    old = docs(spark, [(1, "/w/a.txt", "/w", "h1"), (2, "/w/b.txt", "/w", "h2"), (3, "/v/c.txt", "/v", "h3")])
    after = {x.file_path: (x.doc_id, x.file_hash) for x in A.upsert_documents(old, docs(spark, [(9, "/w/a.txt", "/w", "n1"), (8, "/w/n.txt", "/w", "n2")])).collect()}
    assert after == {"/w/a.txt": (1, "n1"), "/w/b.txt": (2, "h2"), "/v/c.txt": (3, "h3"), "/w/n.txt": (8, "n2")}
    kids = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, c string")
    assert {x.c for x in A.replace_children(kids, spark.createDataFrame([(1, "z")], "doc_id long, c string"), old.where("doc_id = 1")).collect()} == {"z", "y"}
    assert {x.doc_id for x in A.in_folder(old, "/w/").collect()} == {1, 2}
    assert {x.doc_id for x in A.purge_orphans(old, spark.createDataFrame([("/w",)], "path string")).collect()} == {3}
    assert {x.doc_id for x in A.pending_graph_builds(old, spark.createDataFrame([(1, "h1"), (2, "old")], "doc_id long, file_hash string")).collect()} == {2, 3}
    details = spark.createDataFrame([({"API_Key": "s", "user": "u"},)], "m map<string,string>")
    row = A.audit_event(details, "login", F.col("m")).first()
    assert row.details == {"API_Key": "<redacted>", "user": "u"} and row.event_type == "login"


def test_filters(spark):
    rows = docs(spark, [(1, "C:/Windows/x.txt", "C:", "h"), (2, "/w/My-Garden_plan.txt", "/w", "h"), (3, "/w/ok.txt", "/w", "h"), (4, "/w/p/misc/ok.txt", "/w", "h"), (5, "/w/q/ok.txt", "/w", "h")])
    pending = spark.createDataFrame([("/w/q/ok.txt",)], "source_path string")
    assert {x.doc_id for x in B.eligible_documents(rows, pending).collect()} == {3, 4}
    roots, leaves = spark.createDataFrame([("/w",)], "path string"), spark.createDataFrame([("/w/p/misc",), ("/w/q",)], "path string")
    assert {x.doc_id for x in B.floating_documents(rows.where("doc_id > 2"), roots, leaves).collect()} == {3, 4}


def test_conversations(spark):
    said = [(1, i, r, f"t{i}") for i, r in enumerate(["system", "user", "assistant", "user", "assistant"])] + [(2, 0, "user", "x")]
    m = spark.createDataFrame(said, "conv_id long, turn long, role string, text string")
    due = H.summary_due(m, 2, 3).collect()
    assert [(x.conv_id, x.transcript) for x in due] == [(1, "USER: t1\nASSISTANT: t2\nUSER: t3")]
    assert H.load_conversation(m, 1).count() == 5


def test_streamed_bursts_equal_the_table(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(t0 + dt.timedelta(seconds=s), p, c) for s, p, c in [(0, "a", True), (1, "a", False), (3, "a", False), (10, "a", False), (0, "b", False), (500, "z", False)]]
    table = spark.createDataFrame(rows, "ts timestamp, path string, is_create boolean")
    table.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in")
    q = E.debounce(stream).writeStream.format("memory").queryName("bursts").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(x.path, x.n_events, x.is_new) for x in spark.table("bursts").collect()}
    assert got == {("a", 3, True), ("a", 1, False), ("b", 1, False)}
    assert {(x.path, x.n_events, x.is_new) for x in E.debounce(table).collect()} == got | {("z", 1, False)}


def test_routed_stream_reaches_handlers(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(t0, "created", "/w/a.txt", None), (t0 + dt.timedelta(seconds=1), "modified", "/w/a.txt", None), (t0, "deleted", "/w/b.txt", None), (t0, "moved", "/w/c.txt", "/w/d.txt"), (t0, "moved", "/w/e.tmp", "/w/e.txt"), (t0, "moved", "/w/f.txt", "/x/f.txt"), (t0, "created", "/x/no.txt", None), (t0, "created", "/w/.git/no.txt", None)]
    table = spark.createDataFrame(rows, "ts timestamp, event_type string, path string, dest_path string")
    table.coalesce(1).write.parquet(f"{tmp_path}/in")
    seen = {}
    handlers = {a: (lambda df, n, a=a: seen.setdefault(a, set()).update((x.path, x.old_path) for x in df.collect())) for a in ("create", "modify", "delete", "rename")}
    q = E.index_stream(spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in"), spark.createDataFrame([("/w",)], "path string"), handlers, f"{tmp_path}/cp")
    q.processAllAvailable()
    q.stop()
    assert seen == {"modify": {("/w/a.txt", None)}, "create": {("/w/e.txt", None)}, "delete": {("/w/b.txt", None), ("/w/f.txt", None)}, "rename": {("/w/d.txt", "/w/c.txt")}}


def test_page_bounds(spark):
    with pytest.raises(ValueError):
        from corpuskit.operators.graph import search_entities

        search_entities(None, None, 51)


def test_sheets_are_dealt_once_by_their_document(spark):
    """Cells that lie by document already are not dealt again, and a sheet's lines don't meet through joins."""
    rows = [("d", "s", 0, 0, "a"), ("d", "s", 0, 1, " "), ("d", "s", 0, 2, "c"), ("d", "s", 2, 0, "1"), ("d", "s", 2, 2, "3"), ("d", "s", 1, 1, "2"), ("d", "r", 3, 0, "x"), ("e", "s", 0, 0, "only")]
    cells = spark.createDataFrame(rows, "doc string, sheet string, row int, col int, value string").repartition("doc")
    found = S.cells_to_text(cells)
    assert {x.doc: x.text for x in found.collect()} == {"d": "Sheet: r\nx\nSheet: s\na  |  c\nc: 2\na: 1  |  3", "e": "Sheet: s\nonly"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("Exchange") == 1 and "Join" not in plan
