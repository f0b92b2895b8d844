"""The n-gram join against all pairs on small tables."""

import random
import re

import numpy as np

from corpuskit.llm import ngram_join
from corpuskit.llm.ngram_join import differences, jaccard_components

DOCS = "doc_id long, text string, shingle int, comp int, n int"


def brute(rows, n, num, den):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, families=25):
    r = random.Random(seed)
    vocab = [f"W{i}" for i in range(60)] + ["é", "Straße", "a"]
    word = lambda: r.choice(vocab)
    passage = [word() for _ in range(30)]
    texts = [None, "", " \n", "one", "one", "ONE two", "one  two", "x " * 500, "x " * 499]
    for _ in range(families):
        base = [word() for _ in range(r.choice([3, 6, 8, 12, 30, 60, 120]))]
        if r.random() < 0.4:
            base = base[:20] + passage + base[20:]
        for _ in range(r.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(r.randrange(3)):
                at = r.randrange(len(copy) + 1)
                copy[at : at + r.randrange(2)] = [word()] * r.randrange(2)
            texts.append(r.choice([" ", "\t", "  \n"]).join(copy))
    ids = r.sample(range(10_000), len(texts))
    return list(zip(ids, texts))


def test_equals_all_pairs(spark):
    for seed, n, num in ((1, 4, 85), (2, 5, 80)):
        rows = corpus(seed)
        docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], DOCS)
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_components(docs, n, num, 100).collect()}
        want = brute(rows, n, num, 100)
        assert got == want
        assert len({c for _, c in want.values()}) < len(want) - 10


def test_empty_table(spark):
    assert jaccard_components(spark.createDataFrame([], DOCS)).count() == 0


def test_families_in_blocks(spark, monkeypatch):
    """Copies around the threshold, most of them unlinked, in blocks of a few sets."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 7)
    monkeypatch.setattr(ngram_join, "SHORT_LIST", 3)
    r = random.Random(5)
    word = lambda: f"w{r.randrange(5000)}"
    rows = [(None, "no id at all"), (7000, "no id at all")]
    for size in (40, 90):
        base = [word() for _ in range(size)]
        for k in range(45):
            copy = base[: r.choice([size, size, size - 9])]
            for _ in range(r.choice([0, 1, 2, 2, 3])):
                copy[r.randrange(len(copy))] = word()
            rows.append((size * 50 + k, " ".join(copy)))
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows * 2], DOCS)
    out = jaccard_components(docs, 4, 85, 100).collect()
    want = brute(rows[1:], 4, 85, 100)
    assert len(out) == 2 * len(rows)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in out if x.doc_id is not None} == want
    assert {(x.n_shingles, x.component_id) for x in out if x.doc_id is None} == {(1, None)}
    assert 20 < len({c for _, c in want.values()}) < 80


def test_differences_equal_set_differences():
    r = random.Random(3)
    sets = [set(r.sample(range(40), r.randrange(1, 30))) for _ in range(25)]
    flat = np.array([x for s in sets for x in s])
    got = differences(flat, np.repeat(np.arange(25), [len(s) for s in sets]), np.array([len(s) for s in sets]))
    assert got.tolist() == [[len(a ^ b) for b in sets] for a in sets]
