"""Positional matches against a search over all places."""

import glob
import hashlib
import random
import re

import duckdb
import pyarrow.parquet as pq
import pytest

from corpuskit.llm import decontamination as D
from corpuskit.plans import scratch as S

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cut(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def tightest(ws, q, slop):
    """Spans of at most ``slop`` words more that hold the query's words in order, around each place of each word."""
    found = set()
    for i, w in enumerate(ws):
        if w == q[0]:
            for end in range(i + len(q), min(len(ws), i + len(q) + slop) + 1):
                j, ok = i, True
                for word in q[1:]:
                    j = next((k for k in range(j + 1, end) if ws[k] == word), None)
                    if j is None:
                        ok = False
                        break
                if ok and j == end - 1:
                    found.add((i, end))
                    break
    return found


def brute(docs, items, window=10, slop=0):
    windows = [(item, tuple(w[i : i + min(window, len(w))])) for item, text in items if (w := cut(text)) for i in range(max(1, len(w) - window + 1))]
    out = []
    for doc, text in docs:
        ws, hit, named = cut(text), set(), set()
        for item, q in windows:
            for a, b in tightest(ws, q, slop):
                hit |= set(range(a, b))
                named |= {item}
        out.append((doc, len(ws), sorted(hit), sorted(named - {None})))
    return sorted(out, key=str)


def found(spark, docs, items, window=10, slop=0):
    a = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id string, text string, doc_id int")
    rows = D.contamination(a, b, window, slop).collect()
    return sorted([(r.doc_id, r.n_words, sorted({p for s in r.spans for p in range(s.starts, s.ends)}), sorted(r["items"])) for r in rows], key=str)


def drawn(seed, n_docs=40, n_items=12, letters="abcde"):
    rng = random.Random(seed)
    line = lambda n: " ".join(rng.choice(letters) for _ in range(n))
    items = [(f"i{k}", line(rng.choice([1, 2, 4, 7, 9]))) for k in range(n_items)]
    docs = [(k, line(rng.randrange(60)) + ". " + (rng.choice(items)[1].upper() if k % 3 else "") + "-" + line(5)) for k in range(n_docs)]
    return docs, items


@pytest.mark.parametrize("window,slop,seed", [(4, 0, 1), (10, 0, 2), (1, 0, 3), (4, 2, 4), (3, 5, 5)])
def test_random_texts(spark, monkeypatch, window, slop, seed):
    monkeypatch.setattr(D, "BLOCK_BYTES", 40)  # several blocks of items
    monkeypatch.setattr(D, "PIECE", 3)
    docs, items = drawn(seed)
    if slop:  # of overlapping tight matches the hit words may differ from the first ones found, so single ones are compared below
        docs, items = drawn(seed, 30, 6, "abcdefghijklmnopq")
        got, want = found(spark, docs, items, window, slop), brute(docs, items, window, slop)
        assert [(d, n, i) for d, n, _, i in got] == [(d, n, i) for d, n, _, i in want] and any(i for *_, i in got)
    else:
        assert found(spark, docs, items, window) == brute(docs, items, window)


def test_near_spans(spark):
    docs = [(1, "x one y two three x"), (2, "one y y two three"), (3, "two one three two"), (4, "one one two three")]
    assert found(spark, docs, [("q", "one two three")], 3, 1) == [(1, 5 + 1, [1, 2, 3, 4], ["q"]), (2, 5, [], []), (3, 4, [], []), (4, 4, [1, 2, 3], ["q"])]


def test_odd_rows(spark):
    long = "w " * 200_000 + "Alpha beta, GAMMA"
    docs = [(1, None), (2, ""), (3, "..."), (None, "Ünï-çode 3x ALPHA"), (5, long), (5, long), (6, "alpha beta|gamma")]
    items = [("a", "alpha beta gamma"), ("a", "Ünï çode"), (None, "3x"), ("e", None), ("f", "?")]
    got = found(spark, docs, items)
    assert got == brute(docs, items)
    assert (None, 4, [0, 1, 2], ["a"]) in got
    assert found(spark, [], items) == [] and found(spark, docs[:1], []) == [(1, 0, [], [])]


def test_row_groups_of_the_index_stay_small(spark, monkeypatch):
    monkeypatch.setattr(D, "SHARD_BYTES", 20_000)
    monkeypatch.setattr(S, "GROUP_BYTES", 200_000)
    seen, table = [], S.Scratch.table
    monkeypatch.setattr(S.Scratch, "table", lambda self, df, name, *a, **b: (seen.append(f"{self.root}/{name}"), table(self, df, name, *a, **b))[1])
    rng = random.Random(6)
    docs = [(k, " ".join(str(rng.randrange(10**6)) for _ in range(5000))) for k in range(90)]
    rows = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    got = D.contamination(rows, spark.createDataFrame([("a", docs[7][1])], "item_id string, text string")).where("size(spans) > 0").collect()
    assert [(r.doc_id, r.n_words) for r in got] == [(7, 5000)]
    path = next(x for x in seen if x.endswith("/index")).removeprefix("file://")
    groups = [m.row_group(i) for f in glob.glob(f"{path}/*.parquet") for m in [pq.read_metadata(f)] for i in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 90 and max(g.total_byte_size for g in groups) < 2 * S.GROUP_BYTES


def test_query_and_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = D.op11_decontamination(spark, sf)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    rows = sorted(map(tuple, got.collect()))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert rows == sorted(con.execute(D.OP11_SQL).fetchall())
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    few = docs[::10]
    want = {d: (n, len(h), len(i), hashlib.sha256(",".join(sorted(map(str, i))).encode()).hexdigest(), bool(h)) for d, n, h, i in brute(few, items)}
    assert all(tuple(r[1:]) == want[r[0]] for r in rows if r[0] in want) and any(r[-1] for r in rows)
