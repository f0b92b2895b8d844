"""Language identification: held-out accuracy, and defined results for odd rows."""

import math
import random
from collections import Counter

import pytest

from corpuskit.llm import language_id as li

ROWS = "id long, text string, declared string, host string"
STEMS = {"en": ["the", "ing", "tion", "and", "er", "th"], "fr": ["eau", "que", "ère", "ou", "le", "ç"], "de": ["ung", "sch", "der", "ü", "ein", "keit"]}


def sentence(lang, r, n):
    return " ".join("".join(r.choice(STEMS[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n))


def corpus(spark, seed, n, words):
    r = random.Random(seed)
    rows = [(i, sentence(lang := r.choice(list(STEMS)), r, words), lang) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy_and_fusion(spark):
    _, train = corpus(spark, 1, 200, 40)
    model = li.fit(train, "text", "lang", "doc_id")
    assert model.languages == ("de", "en", "fr")
    rows, _ = corpus(spark, 2, 300, 12)
    df = spark.createDataFrame([(i, t, None, None) for i, t, _ in rows], ROWS)
    got = {x.id: x for x in li.identify(df, model).collect()}
    assert sum(got[i].language == lang for i, _, lang in rows) >= 0.97 * len(rows)

    # The host and the declaration decide where the text says little.
    r = random.Random(3)
    known = [(1000 + i, sentence("fr", r, 30), "fr", "www.eau.fr") for i in range(50)]
    odd = [(1, "erou", "fr-FR", "www.eau.fr"), (2, "erou", "EN", "b.com"), (3, None, "fr", "www.eau.fr"), (4, "", None, None), (7, "le", None, "www.eau.fr"), (5, "#### 0000 $$$$ 9999 @@@@ %%%% 1111", None, None), (6, sentence("en", r, 3000), "fr", "www.eau.fr"), (6, sentence("en", r, 3000), "xx", None)]
    got = {x.id: x for x in li.identify(spark.createDataFrame(known + odd, ROWS), model).collect()}
    assert (got[1].language, got[2].language, got[6].language) == ("fr", "en", "en")
    assert [got[i].language for i in (3, 4, 5)] == ["und"] * 3 and got[7].language == "fr" and got[7].kept and not any(got[i].kept for i in (3, 4, 5))
    assert all(got[i].kept for i, *_ in known)


def test_priors_equal_plain_counts(spark):
    """The fused posterior, computed again row by row."""
    import numpy as np

    _, train = corpus(spark, 1, 100, 40)
    model = li.fit(train, "text", "lang", "doc_id")
    r = random.Random(5)
    rows = [(i, sentence(r.choice(list(STEMS)), r, 2), r.choice(["en", "fr", None]), r.choice(["a.x.fr", "b.x.fr", "c.de", "local", None])) for i in range(80)]
    got = {x.id: x for x in li.identify(spark.createDataFrame(rows, ROWS), model).collect()}
    ev = {x.id: np.array(x.evidence) for x in li.text_evidence(spark.createDataFrame(rows, ROWS), model).collect()}
    names = list(model.languages)
    vote = {i: (k if (k := int(np.argmax(e + np.log([1, 1, 1, li.UNKNOWN_PRIOR])))) < len(names) else None) for i, e in ev.items()}
    pairs = [(vote[i], d) for i, _, d, _ in rows if vote[i] is not None and d]
    rel = (sum(names[v] == d for v, d in pairs) + 9) / (len(pairs) + 10)
    base = [sum(v == k for v in vote.values()) + 1 for k in range(3)]
    for i, _, said, host in rows:
        p = np.array([x / sum(base) for x in base])
        if host:
            parts = host.split(".")
            same = [lambda h, n=n: h is not None and (h.split(".")[-n:] == parts[-n:] if n else h == host) and (len(h.split(".")) > 1) == (len(parts) > 1) for n in (1, 2, 0)]
            for match in same:
                others = [vote[j] for j, _, _, h in rows if j != i and match(h) and vote[j] is not None] if len(parts) > 1 else [vote[j] for j, _, _, h in rows if j != i and h == host and vote[j] is not None]
                c = np.array([sum(v == k for v in others) for k in range(3)])
                p = (c + li.KAPPA * p) / (c.sum() + li.KAPPA)
        s = ev[i][:3] + np.log(p) + np.log(1 - li.UNKNOWN_PRIOR)
        s += [0 if not said else np.log(rel) if n == said else np.log((1 - rel) / 2) for n in names]
        s = np.append(s, ev[i][3] + np.log(li.UNKNOWN_PRIOR) + (np.log(1 / 3) if said else 0))
        want = np.exp(s - s.max()).max() / np.exp(s - s.max()).sum()
        assert abs(got[i].confidence - want) < 1e-4, (rows[i], got[i])


def grams(text):
    """The trigrams of a text, counted byte by byte, by bucket."""
    raw = [32 if 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()]
    letter, blank = (lambda c: c >= 128 or 97 <= c <= 122), (lambda c: c == 32)
    for x in zip(raw, raw[1:], raw[2:]):
        if all(letter(c) or blank(c) for c in x) and not all(blank(c) for c in x):
            yield ((x[0] << 16 | x[1] << 8 | x[2]) * 2654435761 % 2**32) >> 16


def test_evidence_equals_plain_counts(spark):
    rows, train = corpus(spark, 1, 60, 30)
    model = li.fit(train, "text", "lang", "doc_id")
    counts = {lang: Counter(g for _, t, k in rows if k == lang for g in grams(t)) for lang in STEMS}
    asked = [(1, "the keitère QUE"), (2, None), (3, "a 1 b-c\n\tx"), (4, rows[0][1] * 3), (5, "é")]
    got = {x.id: x.evidence for x in li.text_evidence(spark.createDataFrame([(i, t, None, None) for i, t in asked], ROWS), model).collect()}
    for i, text in asked:
        found = list(grams(text))
        weight = len(found) / (1 + len(found) / li.EVIDENCE) / max(1, len(found))
        p = lambda lang, g: (1 - li.UNIFORM) * counts[lang][g] / counts[lang].total() + li.UNIFORM / li.BUCKETS
        want = [weight * sum(math.log(p(lang, g)) for g in found) for lang in sorted(STEMS)] + [-weight * len(found) * math.log(li.BUCKETS)]
        assert got[i] == pytest.approx(want, rel=1e-4, abs=1e-4)


def test_labels_count_without_region_and_rare_ones_are_fitted(spark, monkeypatch):
    monkeypatch.setattr(li, "SAMPLE_ROWS", 20)
    r = random.Random(8)
    label = {"en": ["en-US", "EN_gb", "en"], "fr": ["fr-FR", "fr"]}
    rows = [(i, sentence(k, r, 40), r.choice(label[k])) for i in range(400) for k in [("fr" if i % 100 == 7 else "en")]]
    model = li.fit(spark.createDataFrame([*rows, (900, "x", ""), (901, None, "de")], "doc_id long, text string, lang string"), "text", "lang", "doc_id")
    assert model.languages == ("en", "fr")
    got = li.identify(spark.createDataFrame([(1, "eau que ère ou eauque", "fr-FR", "a.b")], ROWS), model).first()
    assert (got.language, got.kept) == ("fr", True)


def test_pages(spark):
    pages = spark.createDataFrame([(1, "https://me@www.Eau.FR:8080/x", '<html class="' + "a" * 3000 + '" lang="fr-CA"><script>var t="</p>"</script><p>eau</p>'), (2, None, None), (3, "x", "")], "page_id long, url string, html string")
    got = {x.id: x for x in li.pages_as_rows(pages).collect()}
    assert (got[1].declared, got[1].host, got[1].text.split()) == ("fr-CA", "www.Eau.FR", ["eau"])
    assert got[2].declared is None and got[2].host is None and got[2].text == ""


def test_empty_table(spark):
    _, train = corpus(spark, 1, 50, 40)
    assert li.identify(spark.createDataFrame([], ROWS), li.fit(train, "text", "lang", "doc_id")).count() == 0


def test_pages_are_read_in_one_pass():
    import time

    from corpuskit.llm.language_id import visible

    begun = time.time()
    for page in (b"<" * 2_000_000, b"<script>x" * 200_000, b"<!--" * 500_000, b"<style" * 300_000, b"<html lang" * 200_000):
        visible(page)
    assert time.time() - begun < 10
    assert visible(b"a<b>c<script>if (1 < 2) x</SCRIPT >d<!-- <p> -->e<style>p{}</style>f < g") == b"a c d e f < g"
    assert visible(b"a<script>b<i>c") == b"a b c" and visible(b"<!-- a <b>c") == b" c" and visible(b"") == b""
    assert visible(b'<a title="<script>">x</script>') == b' ">x '
