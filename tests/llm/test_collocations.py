"""Phrases against counts of all contiguous word runs."""

import glob
import random
import re
from collections import Counter

import duckdb
import pyarrow.parquet as pq
import pytest

from corpuskit.llm import collocations as C
from corpuskit.plans import scratch as S

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, longest=5, least=100, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            ws = re.findall(r"[^ \t]+", piece)
            n[lang] += len(ws)
            f.update((lang, tuple(ws[i : i + k])) for k in range(1, longest + 1) for i in range(len(ws) - k + 1))
    frequent = {g: a for g, a in f.items() if a >= least}
    covered = {(lang, q[s : s + m]) for (lang, q), a in frequent.items() for m in range(2, len(q)) for s in range(len(q) - m + 1) if a >= f[lang, q[s : s + m]]}
    out = {}
    for (lang, q), a in frequent.items():
        if len(q) > 1 and (lang, q) not in covered:
            cuts = [(1000 * a * n[lang] // (f[lang, q[:k]] * f[lang, q[k:]]), k) for k in range(1, len(q))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(q).encode(), f[lang, q[:k]], f[lang, q[k:]]))
    return sorted((lang, i, p.decode(), -a, x, y, n[lang], -s) for lang, found in out.items() for i, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1))


def found(spark, rows, *args):
    df = spark.createDataFrame([(t, lang, 1) for t, lang in rows], "text string, lang string, rank int")
    got = C.collocations(df, *args)
    assert got.columns == COLUMNS
    return sorted(map(tuple, got.collect()))


def drawn(seed, many=120):
    rng = random.Random(seed)
    names = ["new york", "ice cream van", "the", "a", "of", "be to be", "é ü", "x\ty", "p|q"]
    line = lambda: "".join(rng.choice(names).upper() + rng.choice([" ", " ", " ", ", ", ".\n", "  "]) for _ in range(rng.randrange(30)))
    return [(line(), rng.choice(["en", "de", None, "und"])) for _ in range(many)]


@pytest.mark.parametrize("seed,longest,least,top", [(1, 5, 10, 2000), (2, 3, 2, 7), (3, 2, 1, 50), (4, 6, 3, 40)])
def test_random_texts(spark, monkeypatch, seed, longest, least, top):
    monkeypatch.setattr(C, "SHARD_WORDS", 300)
    monkeypatch.setattr(C, "RANGE_WORDS", 500)
    rows = drawn(seed)
    want = brute(rows, longest, least, top)
    assert want and found(spark, rows, longest, least, top) == want


def test_odd_rows(spark):
    rows = [("again and again " * 5000, "en"), (None, "en"), ("", None), ("...", "x"), ("  one two\tthree\x0bone two. three" * 200, None), ("\n".join(["cell"] * 300), "t\ta")]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == [] and found(spark, rows[1:4]) == []


def test_row_groups_of_messages_stay_small(spark, monkeypatch):
    monkeypatch.setattr(C, "SHARD_WORDS", 300)
    monkeypatch.setattr(S, "GROUP_BYTES", 50_000)
    groups, table = [], S.Scratch.table

    def seen(self, df, name, *a, **b):
        out = table(self, df, name, *a, **b)
        metas = [pq.read_metadata(f) for f in glob.glob(f"{self.root.removeprefix('file://')}/{name}/*.parquet")]
        groups.extend((name, m.row_group(i)) for m in metas for i in range(m.num_row_groups))
        return out

    monkeypatch.setattr(S.Scratch, "table", seen)
    rng = random.Random(8)
    rows = [(" ".join(str(rng.randrange(2000)) for _ in range(500)), "en") for _ in range(300)]
    df = spark.createDataFrame(rows, "text string, lang string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")  # a shard for each ten texts
    try:
        got = sorted(map(tuple, C.collocations(df, 2, 3).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got and got == brute(rows, 2, 3)
    sizes = [g.total_byte_size for name, g in groups if name.startswith(("sent", "summed"))]
    assert sum(sizes) > 10 * S.GROUP_BYTES and max(sizes) < 2 * S.GROUP_BYTES


def test_numbers_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    levels = [spark.createDataFrame([(0, "en", "a", 9 * 10**11), (1, "en", "b", 8 * 10**11)], "state long, lang string, word string, f long"), spark.createDataFrame([(2, 0, 1, 7 * 10**11)], "state long, left long, right long, f long")]
    totals = spark.createDataFrame([("en", 5 * 10**13)], "lang string, n long")
    keep = C.transducer
    C.transducer = lambda *a: (levels, totals)
    try:
        row = C.collocations(spark.createDataFrame([], "text string, lang string"), 2).select(F.col("score")).first()
    finally:
        C.transducer = keep
    assert row.score == 1000 * 7 * 10**11 * 5 * 10**13 // (9 * 10**11 * 8 * 10**11)


def test_query_and_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted(map(tuple, C.op12_collocations(spark, sf).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert got == sorted(con.execute(C.OP12_SQL).fetchall())
    assert got == brute([(r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
