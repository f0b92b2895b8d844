"""The pipeline's decisions against plain ones on a small table."""

import re

import corpus_pipeline
from corpuskit.llm import language_id

SENTENCE = "the king and the thing of nation were here in the station when the other one came by with a letter for the man "


def test_stages_on_small_table(spark, tmp_path):
    base = [SENTENCE + " ".join(f"word{i}x{j}ing" for j in range(60)) for i in range(30)]
    texts = base + [base[3] + " ", base[3].replace(" ", "  "), base[4] + " tail", base[5] + " mail me at a.b@c.de now", None, "", "#### 0000 $$$$ 9999 @@@@ %%%% 1111 &&&&"]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_jaccard", "pii", "packing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"] and out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append({x.doc_id for x in docs.select("doc_id").collect()})
    assert kept[0] == set(range(34))
    groups = {}
    for i in kept[0]:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", texts[i]), []).append(i)
    assert kept[1] == {min(g, key=lambda i: (-len(texts[i]), i)) for g in groups.values()}
    assert kept[2] == kept[1] - {32, 33} and kept[3] == kept[2] and kept[4] == kept[2]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in packed} == kept[4] and sum(x.length for x in packed) == sum({x.doc_id: x.doc_tokens for x in packed}.values())
    assert language_id.UNKNOWN == "und"


def test_stages_on_empty_table(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
    bare = spark.createDataFrame([(1, "some text", None, None, None), (2, None, None, None, None)], schema)
    for _, stage in corpus_pipeline.STAGES:
        assert {x.doc_id for x in stage(spark, bare, str(tmp_path)).collect()} == {1, 2}
