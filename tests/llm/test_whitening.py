"""Whitened vectors against a dense eigendecomposition."""

import math

import numpy as np

from corpuskit.llm import whitening as W

SCHEMA = "vec_id long, embedding array<double>, component string"


def brute(rows, components=4):
    sound = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dim = max((len(v) for _, v in sound), default=0)
    xs = {k: [math.floor(256 * c) for c in v] + [0] * (dim - len(v)) for k, (_, v) in enumerate(sound)}
    fit = np.array(sorted({tuple(x) for x in xs.values()}), float)
    n, sums = len(fit), [int(s) for s in fit.sum(axis=0)]
    centred = fit - fit.mean(axis=0)
    e, axes = np.linalg.eigh(centred.T @ centred / n)
    out = {}
    for k, (i, _) in enumerate(sound):
        deviation = sum((n * c - s) ** 2 for c, s in zip(xs[k], sums))
        for j in range(min(components, dim)):
            if e[-1 - j] > 1e-12 * e.sum():
                out.setdefault((i, j + 1), []).append((n, deviation, (np.array(xs[k]) - fit.mean(axis=0)) @ axes[:, -1 - j] / math.sqrt(e[-1 - j]), e[-1 - j] / e.sum()))
    return out


def check(spark, rows, components=4, near=1e-9):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)
    got, want = {}, brute(rows, components)
    for r in W.whiten(df, components).collect():
        got.setdefault((r.vec_id, r.component), []).append(r)
    assert got.keys() == want.keys()
    sign = {}
    for key in sorted(want, key=str):
        assert len(got[key]) == len(want[key])
        for r, (n, deviation, whitened, explained) in zip(sorted(got[key], key=lambda r: abs(r.whitened)), sorted(want[key], key=lambda w: abs(w[2]))):
            assert (r.n, int(r.deviation)) == (n, deviation)
            assert abs(r.explained - explained) < 1e-9 and r.identity_error < 1e-9
            if abs(whitened) > 1e-6:
                assert sign.setdefault(key[1], np.sign(r.whitened * whitened)) == np.sign(r.whitened * whitened)
            assert abs(abs(r.whitened) - abs(whitened)) < near
    return got


def test_random_vectors_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((300, 12)) * np.linspace(2, 0.5, 12) + 3)]
    rows += [(900 + i, rows[0][1]) for i in range(100)]  # copies count once
    rows += [(1, None), (2, [1.0, None] + [0.0] * 10), (3, [math.nan] + [0.0] * 11), (4, [math.inf] + [0.0] * 11), (None, rows[5][1]), (5, [1.0, 2.0]), (6, [])]
    check(spark, rows)


def test_few_dimensions_low_rank_and_empty(spark):
    assert check(spark, [(1, [0.5, 1.0]), (2, [0.0, 0.25]), (3, [1.0, 7.0])]).keys() == {(i, c) for i in (1, 2, 3) for c in (1, 2)}
    line = [(i, [i / 4, i / 2, 0.0, 1.0, 1.0]) for i in range(20)]
    assert {c for _, c in check(spark, line)} == {1}
    assert check(spark, [(1, [0.5, 1.0]), (2, [0.5, 1.0])]) == {}
    assert W.whiten(spark.createDataFrame([], SCHEMA)).count() == 0


def test_equal_deviations_are_all_found(spark):
    corners = [(i, [float(s * (k == d) * 4) for d in range(6)]) for i, (k, s) in enumerate((k, s) for k in range(5) for s in (-1, 1))]
    df = spark.createDataFrame([(i, v, "x") for i, v in corners], SCHEMA)
    found = W.whiten(df).collect()
    assert len(found) == 40 and all(abs(r.explained - 0.2) < 1e-12 and r.identity_error < 1e-12 for r in found)


def test_large_numbers_are_exact(spark):
    rows = [(i, [i * 1e13, -i * 3e12, 1.0]) for i in range(1, 6)]
    got = check(spark, rows, near=1e-6)
    assert max(int(r.deviation) for rs in got.values() for r in rs) > 2**63


def test_stops_early_where_it_may(spark):
    rng = np.random.default_rng(2)
    rows = rng.standard_normal((400, 40)) * 0.5 ** np.arange(40) * 50
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(rows)], SCHEMA)
    model, error = W.fit(W.whole_numbers(df, "vec_id", "embedding").select("x").distinct())
    assert model.steps < 40 and error < 1e-9


def test_query(spark):
    found = W.op13_whitening(spark, "/root/testdata/sf0.001")
    rows = [(r.vec_id, [float(c) for c in r.embedding]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    want = brute(rows)
    got = found.collect()
    assert dict(found.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    assert len(got) == sum(map(len, want.values()))
    for r in got:
        n, deviation, whitened, explained = want[r.vec_id, r.component][0]
        assert (r.n, r.deviation) == (n, deviation) and abs(abs(r.whitened) - abs(whitened)) < 1e-7 and abs(r.explained - explained) < 1e-9
