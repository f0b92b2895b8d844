"""Exact groups against plain Python: skewed ids, null ids, small histories."""

import hashlib
import random

import pytest

from corpuskit.llm import exact_dedup as E

DOCS = "doc_id long, text string"
WHITE = str.maketrans("", "", "\x20\x09\x0a\x0b\x0c\x0d")


def plain(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(hashlib.sha256((t or "").translate(WHITE).encode()).hexdigest(), []).append((-len(t or ""), i is None, i or 0))
    out = []
    for i, t in rows:
        sha = hashlib.sha256((t or "").translate(WHITE).encode()).hexdigest()
        _, unnamed, keep = min(groups[sha])
        keep = None if unnamed else keep
        out.append((i, keep, len(groups[sha]), None if i is None or keep is None else i == keep, sha))
    return sorted(out, key=str)


def texts(n, seed):
    r = random.Random(seed)
    return [r.choice(["", " ", "x"]) + f"t{r.randrange(n // 2)}" + " " * r.randrange(4) for _ in range(n)]


CASES = {
    "dense": [(i, t) for i, t in enumerate(texts(200, 1))],
    "low outlier": [(-(10**15), "t1"), *((10**15 + i, t) for i, t in enumerate(texts(200, 2)))],
    "null ids": [(None if i % 5 == 0 else 2**60 + i, t) for i, t in enumerate(texts(200, 3))],
    "all null": [(None, t) for t in texts(40, 4)],
    "null texts": [(1, None), (2, ""), (None, None), (3, "  ")],
}


@pytest.mark.parametrize("name", CASES)
def test_groups_equal_plain(spark, name):
    rows = CASES[name]
    docs = spark.createDataFrame(rows, DOCS)
    got = E.exact_dedup(*E.history_and_incoming(docs), bucket_keys=16).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)


def test_null_ids_in_history(spark):
    old, new = CASES["null ids"][:120], CASES["null ids"][120:]
    got = E.exact_dedup(spark.createDataFrame(old, DOCS), spark.createDataFrame(new, DOCS), bucket_keys=16).collect()
    assert sorted(map(tuple, got), key=str) == plain(old + new)


@pytest.mark.parametrize("n_old, n_new", [(1, 400), (0, 400), (400, 1)])
def test_buckets_of_either_side_are_bounded(spark, monkeypatch, n_old, n_new):
    seen = []
    monkeypatch.setattr(E, "lookup", lambda incoming, index, n, real=E.lookup: seen.append(n) or real(incoming, index, n))
    old = spark.createDataFrame([(i, f"a{i}") for i in range(n_old)], DOCS)
    new = spark.createDataFrame([(1000 + i, f"b{i}") for i in range(n_new)], DOCS)
    assert E.exact_dedup(old, new, bucket_keys=50).count() == n_old + n_new
    assert seen == [8]
