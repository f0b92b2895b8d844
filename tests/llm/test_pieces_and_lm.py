"""Piece segmentation against brute force and the library; language-model scores against plain counts."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from corpuskit.llm import lm_scores
from corpuskit.llm import sentence_pieces as sp

pytest.importorskip("public_tokenizers")
BITS = ["hello", " ", "  ", "world", "\n", "▁", "é", "ß", "日本", "😀", "\x00", "ing", "the", "\t", "a", "1984", "..."]
DOCS = "doc_id long, text string, pieces int, decoded int, block int"


def random_texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(BITS) for _ in range(r.randrange(25))) for _ in range(n)]


def test_round_trip_of_any_text(spark):
    texts = [*random_texts(300, 1), None, "", " ", "x" * 30_000, "a b " * 5000]
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in enumerate(texts)], DOCS)
    got = {x.doc_id: x for x in sp.decode(sp.encode(docs)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i].decoded == (t or "") and bool(got[i].pieces) == bool(t)
    assert sp.encode(spark.createDataFrame([], DOCS)).count() == 0


def test_segmentation_is_the_best(spark):
    m = sp.PieceModel.of(sp.default_model())

    def brute(s):
        best = [0.0] + [-math.inf] * len(s)
        for e in range(1, len(s) + 1):
            best[e] = best[e - 1] + len(s[e - 1].encode()) * m.byte_score
            for a in range(e):
                if s[a:e] in m.score:
                    best[e] = max(best[e], best[a] + m.score[s[a:e]][1])
        return best[-1]

    scores = {i: s for i, s in m.score.values()}
    for t in random_texts(100, 2):
        for w in t.replace(sp.MARK, "").split(" "):
            ids = m.segment(sp.MARK + w)
            assert sum(scores.get(i, m.byte_score) for i in ids) == pytest.approx(brute(sp.MARK + w))


def test_agrees_with_the_library_on_unigram_scores():
    from tokenizers import Tokenizer, models

    m = sp.PieceModel.of(sp.default_model())
    vocab = [("<unk>", -100.0), *((p, s) for p, (_, s) in m.score.items())]
    tok = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=False))
    names = {i: p for p, (i, _) in m.score.items()}
    scores = dict(vocab)
    r = random.Random(3)
    for _ in range(200):
        w = sp.MARK + "".join(r.choice(["hel", "lo", "wor", "ld", "ing", "the", "a", "tion"]) for _ in range(r.randrange(1, 5)))
        mine = [names[i] for i in m.segment(w)]
        assert sum(map(scores.get, mine)) == pytest.approx(sum(map(scores.get, tok.encode(w).tokens)))


def test_packed_arrays():
    r = np.random.default_rng(2)
    for high in (2**63, 2**50, 1000):
        for n in (1, 2, 500):
            x = np.sort(r.integers(0, high, n).astype(np.uint64))
            assert (lm_scores.unpack_sorted(lm_scores.pack_sorted(x), n) == x).all()
    c = np.array([1, 254, 255, 256, 70_000, 3])
    assert (lm_scores.unpack_counts(lm_scores.pack_counts(c), 6) == c).all()


def brute_scores(texts, order):
    docs = [(t or "").lower().split() for t in texts]
    grams = lambda w, k: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    every = {k: Counter(g for w in docs for g in grams(w, k)) for k in range(1, order + 1)}
    n, out = sum(map(len, docs)), []
    for w in docs:
        own, total = {k: Counter(grams(w, k)) for k in every}, 0.0
        c = lambda g: every[len(g)][g] - own[len(g)][g]  # noqa: E731, B023

        def score(i, k):
            g = tuple(w[i - k + 1 : i + 1])  # noqa: B023
            if k == 1:
                return math.log10(max(c(g), 0.5) / max(n - len(w), 1))  # noqa: B023
            return math.log10(c(g) / c(g[:-1])) if c(g) > 0 else math.log10(0.4) + score(i, k - 1)  # noqa: B023

        for i in range(len(w)):
            total += score(i, min(order, i + 1))
        out.append((len(w), total))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_plain_counts(spark, order, monkeypatch):
    monkeypatch.setattr(lm_scores, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(lm_scores, "PARTITION_GRAMS", 300)
    r = random.Random(order)
    texts = [" ".join(r.choice(["a", "B", "c", "dd", "é", "f"]) for _ in range(r.randrange(30))) for _ in range(150)]
    texts += [None, "", " \n", texts[0], texts[0], "once", "a " * 2000]
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in enumerate(texts)], DOCS).repartition(3)
    got = {x.doc_id: x for x in lm_scores.score_documents(docs, order).collect()}
    for i, (n, total) in enumerate(brute_scores(texts, order)):
        assert got[i].n_words == n and got[i].log10_score == pytest.approx(total), texts[i]
    assert len(got) == len(texts)
    if order == 1:
        assert lm_scores.score_documents(spark.createDataFrame([], DOCS)).count() == 0
