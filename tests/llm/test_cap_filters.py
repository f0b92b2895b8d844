"""Cap filters against all pairs."""

import math

import numpy as np
import pytest

from corpuskit.llm import cap_filters as C
from corpuskit.llm.cap_filters import _compare, near_vectors

ROWS = "vec_id long, embedding array<double>, label int, v int, m int"


def brute(ids, vectors, cosine=0.95):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    label = dict(zip(ids, ids))
    links = dict.fromkeys(ids, 0)
    for dim in {len(v) for v, o in zip(vectors, ok) if o}:
        mine = [(i, v) for i, v, o in zip(ids, vectors, ok) if o and len(v) == dim]
        x = np.array([v for _, v in mine], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near = x @ x.T >= cosine
        np.fill_diagonal(near, False)
        for (i, _), row in zip(mine, near):
            links[i] = int(row.sum())
        lows = np.array([i for i, _ in mine])
        while True:
            nxt = np.minimum(lows, np.where(near, lows[None, :], 10**9).min(axis=1, initial=10**9))
            if (nxt == lows).all():
                break
            lows = nxt
        label.update(zip([i for i, _ in mine], lows.tolist()))
    return {i: (links[i], label[i], label[i] == i) for i in ids}


def corpus(seed, n=500, dim=32):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((n // 4, dim))
    rows = [c + r.standard_normal(dim) * 0.12 for c in centres for _ in range(r.integers(1, 5))]
    rows += [centres[0] + r.standard_normal(dim) * 0.1 for _ in range(300)] + [centres[1]] * 40 + [2 * centres[1]]
    out = [x.tolist() for x in rows]
    out += [None, [], [0.0] * dim, [float("nan")] + [1.0] * (dim - 1), [float("inf")] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), [1.0, 2.0], [1.0, 2.01], [3.0]]
    ids = r.permutation(10 * len(out))[: len(out)].tolist()
    return ids, out


def test_recall_and_precision(spark):
    ids, vectors = corpus(1)
    df = spark.createDataFrame([(i, v, 0, 1, 2) for i, v in zip(ids, vectors)], ROWS).repartition(3)
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in near_vectors(df).collect()}
    want = brute(ids, vectors)
    assert got.keys() == want.keys()
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(x[0] for x in got.values()) >= 0.99 * sum(x[0] for x in want.values())
    assert sum(got[i][1] == want[i][1] for i in want) >= 0.99 * len(want)


def test_links_count_in_the_first_common_filter():
    v = np.array([[1.0, 0.0], [0.99, 0.01], [1.0, 0.02]])
    lists = [np.array([1, 5]), np.array([1, 5]), np.array([5])]
    side = np.zeros(3, bool)
    ids, mult = np.arange(3), np.array([1, 1, 1])
    assert _compare(ids, mult, v, lists, side, 5, 0.95)[0].tolist() == [1, 1, 2]
    assert _compare(ids[:2], mult[:2], v[:2], lists[:2], side[:2], 1, 0.95)[0].tolist() == [1, 1]


def test_empty_table(spark):
    assert near_vectors(spark.createDataFrame([], ROWS)).count() == 0


@pytest.mark.parametrize("n,dim", [(500, 64), (10**4, 64), (10**6, 64), (10**8, 64), (10**6, 256)])
def test_pairs_at_the_cosine_share_filters_in_tables_of_any_size(n, dim):
    rng = np.random.default_rng(n + dim)  # other pairs than those that the filters are fitted on
    a, b = rng.standard_normal((2, 300, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (b * a).sum(axis=1, keepdims=True) * a
    b = 0.951 * a + math.sqrt(1 - 0.951**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    words, level = C.parameters(n)
    codes, least = (C.code(dim, words, 0), C.code(dim, words, 1)), C.least_filters(words, level, dim, 0.95)
    found = [C.list_decode(v, codes, level * math.sqrt(2 / dim), least) for v in (a, b)]
    assert np.mean([len(np.intersect1d(x, y)) > 0 for x, y in zip(*found)]) >= 0.95


def test_very_small_and_very_large_entries(spark):
    rows = [(1, [1.0, 2.0, 3.0]), (2, [1e-200, 2e-200, 3e-200]), (3, [1e200, 2e200, 3e200]), (4, [5e-324, 0.0, 0.0]), (5, [1e308, 0.0, 0.0]), (6, [0.0, 0.0, 0.0]), (7, [-1.0, -2.0, -3.0])]
    df = spark.createDataFrame([(i, v, 0, 1, 2) for i, v in rows], ROWS)
    got = {x.vec_id: (x.n_links, x.component_id) for x in near_vectors(df).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4), 6: (0, 6), 7: (0, 7)}
