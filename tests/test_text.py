"""Query rewriting, names, chunks, abbreviations and stems."""

import uuid

import pytest
from pyspark.sql import functions as F

from corpuskit.functions import text as T
from corpuskit.operators import queries as Q
from corpuskit.operators.chunks import chunk_text, cut
from corpuskit.operators.keyword import Porter


def test_chunk_boundaries():
    assert [(a, b) for _, a, b in cut("A" * 250, 100, 20)] == [(0, 100), (80, 180), (160, 250)]
    first = next(iter(cut("First sentence ends here. " + "B" * 50, 60, 10)))
    assert first == ("First sentence ends here.", 0, 25)
    assert list(cut("   ", 50, 10)) == []
    text = "ABCDEFGHIJ" * 10
    got = list(cut(text, 50, 10))
    assert all(text[a:b] == c for c, a, b in got) and all(x[2] - y[1] == 10 for x, y in zip(got, got[1:]))


def test_chunk_table(spark):
    docs = spark.createDataFrame([(1, "word " * 100), (2, None), (3, "")], "doc_id long, text string")
    assert {x.doc_id for x in chunk_text(docs, 100, 20).collect()} == {1}
    with pytest.raises(ValueError):
        chunk_text(docs, 10, 10)


def one(spark, query, expansions=None):
    return Q.process_queries(spark.createDataFrame([(1, query)], "query_id long, query string"), expansions).first()


def test_process_queries(spark):
    r = one(spark, "  What is  the API of State-of-the-art docs?  ")
    assert r.normalised == "what is the api of state-of-the-art docs?"
    assert r.tokens == ["what", "is", "the", "api", "of", "state-of-the-art", "docs"]
    assert r.filtered == ["api", "state-of-the-art", "docs"]
    assert r.expanded == ["application programming interface", "documents", "documentation"]
    assert r.intent == "factual" and r.search_text.startswith("api state-of-the-art docs application")
    assert one(spark, "hello, world! how?").tokens == ["hello", "world", "how"]
    assert one(spark, "the of").search_text == "the of"
    assert one(spark, "compare x or y").intent == "comparison" and one(spark, "open budget").intent == "navigational" and one(spark, "sunset").intent == "exploratory"
    assert one(spark, "helllo").has_typo and one(spark, "tst").has_typo and not one(spark, "house").has_typo
    assert one(spark, "e\u0301te\u0301").normalised == "été"


def test_document_expansions_follow_fixed_ones(spark):
    told = spark.createDataFrame([("rrf", ["Reciprocal Rank Fusion", "rrf x"]), ("api", ["never"])], "abbreviation string, definitions array<string>")
    assert one(spark, "rrf api rrf", told).expanded == ["Reciprocal Rank Fusion", "rrf x", "application programming interface"]
    assert one(spark, "plain", told).expanded == []


def test_abbreviations(spark):
    docs = spark.createDataFrame([(1, "RRF (Reciprocal Rank Fusion) and Key Performance Indicator (KPI), ETA (Estimated Time of Arrival). KPI (Kilo Pi Int). OCR (Some Other Thing). ABC (wrong words here)"), (2, None)], "doc_id long, text string")
    got = {(x.abbreviation, x.definition) for x in Q.extract_abbreviations(docs).collect()}
    assert got == {("rrf", "Reciprocal Rank Fusion"), ("eta", "Estimated Time of Arrival"), ("kpi", "Kilo Pi Int")}


def test_small_talk_names_and_paths(spark):
    df = spark.createDataFrame([("Hello!", "  «Foo  Bar» ", "/ws/a/The_Depot-Charging 2024.v2.docx", "warehouse picking")], "q string, n string, p string, t string")
    r = df.select(
        T.is_small_talk(F.col("q")).alias("talk"), T.is_small_talk(F.lit("where is the budget")).alias("ask"), T.canonical_name(F.col("n")).alias("canon"), T.filename_words(F.col("p")).alias("words"), T.filename_bigrams(F.col("p")).alias("pairs"),
        T.expand_term(F.col("t")).alias("terms"), T.ancestors(F.col("p")).alias("above"), T.uuid5(F.lit("a:b")).alias("id"), T.deterministic_name(F.array(F.lit("foo_bar"), F.lit("x/y-z"))).alias("name"), T.sanitize_name(F.lit("word " * 20)).alias("cut"), T.deterministic_name(F.array().cast("array<string>")).alias("none"),
    ).first()
    assert r.talk and not r.ask and r.canon == "foo bar"
    assert r.words == ["depot", "charging"] and r.pairs == ["depot charging"] and set(r.terms) == {"warehouse picking", "warehouse", "picking"}
    assert r.above == ["/ws", "/ws/a"] and r.id == str(uuid.uuid5(uuid.NAMESPACE_OID, "a:b"))
    assert r.name == "Foo Bar Xy Z" and r.none == "New Folder" and len(r.cut) <= 60 and r.cut.endswith("word")


def test_porter():
    known = {"caresses": "caress", "ponies": "poni", "running": "run", "runs": "run", "hopping": "hop", "relational": "relat", "agreed": "agre", "happy": "happi", "sky": "sky", "generalization": "gener", "oscillators": "oscil", "adjustment": "adjust", "probate": "probat", "controll": "control", "été": "été"}
    assert {w: Porter.stem(w) for w in known} == known
