"""Queries over texts: chunks, query rewriting, index, search, reranking, context."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskit.functions import constants as K
from corpuskit.operators import keyword, queries as Q, search, vectors as V
from corpuskit.plans import views as W
from corpuskit.plans.scratch import Scratch


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def chunk_documents(spark, d):
    return W.cut_documents(spark, d).select("doc_id", "chunk_index", "content", "char_start", "char_end")


def chunk_stats(spark, d):
    joined = W.cut_documents(spark, d).join(W.table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    n = F.length("content")
    return joined.groupBy("lang").agg(F.count("*").alias("n_chunks"), F.min(n).cast("long").alias("shortest"), F.max(n).cast("long").alias("longest"), F.sum(n).alias("chars"))


def _said(spark, d):
    said = W.table(spark, d, "conversations")
    return said.select("conv_id", "turn", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"), F.col("text").alias("query"))


def query_tokens(spark, d):
    done = Q.process_queries(_said(spark, d))
    return done.select("query_id", "normalised", F.array_join("tokens", "|").alias("tokens"), F.array_join("filtered", "|").alias("filtered"), F.array_join("expanded", "|").alias("expanded"), "search_text")


def query_intent(spark, d):
    return Q.process_queries(_said(spark, d)).select("query_id", "intent")


def typo_flags(spark, d):
    return Q.process_queries(_said(spark, d)).select("query_id", "has_typo")


_TOKENS = """, q AS (SELECT conv_id || ':' || turn AS query_id, trim(regexp_replace(lower(nfc_normalize(text)), '\\s+', ' ', 'g')) AS normalised FROM conversations),
t AS (SELECT *, list_filter(list_transform(string_split_regex(normalised, '[\\s,;:!?()\\[\\]{}<>"'']+'), lambda x: regexp_replace(x, '^-+|-+$', '', 'g')), lambda x: x <> '') AS tokens FROM q)
"""
_EXP = ", ".join(f"('{k}', {i}, '{x}')" for k, v in K.EXPANSIONS.items() for i, x in enumerate(v))


def abbreviation_texts(spark, d):
    """Texts made of part names: definition first, abbreviation first, or a wrong abbreviation."""
    p = W.table(spark, d, "part").withColumn("short", F.upper(F.array_join(F.transform(F.split("p_name", " "), lambda w: F.substring(w, 1, 1)), "")))
    k = F.col("p_partkey") % 3
    text = F.when(k == 0, F.concat(F.lit("made by Old "), F.initcap("p_name"), F.lit(" (O"), "short", F.lit(") today"))).when(k == 1, F.concat(F.lit("a note on "), "short", F.lit(" ("), "p_name", F.lit(") here"))).otherwise(F.concat(F.lit("but XQZ ("), "p_name", F.lit(") is wrong")))
    return p.select(F.col("p_partkey").alias("doc_id"), text.alias("text"))


def abbreviations(spark, d):
    return Q.extract_abbreviations(abbreviation_texts(spark, d))


def abbreviation_expansions(spark, d):
    return Q.abbreviation_expansions(abbreviations(spark, d)).select("abbreviation", F.array_join("definitions", "|").alias("definitions"))


_ABBR = """p AS (SELECT p_partkey, p_name, upper(array_to_string(list_transform(string_split(p_name, ' '), lambda w: w[1:1]), '')) AS short, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1:1]) || w[2:]), ' ') AS title FROM part),
a AS (SELECT p_partkey AS doc_id, 'o' || lower(short) AS abbreviation, 'Old ' || title AS definition FROM p WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, lower(short), p_name FROM p WHERE p_partkey % 3 = 1)
"""
_ABBR_KEEP = f"SELECT * FROM a WHERE NOT list_contains({_list(K.EXPANSIONS)}, abbreviation)"


def postings(spark, d):
    return keyword.build_postings(W.cut_documents(spark, d), stem=False).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf"))


def _keyword_hits(chunks, asked, k, stem=False):
    phrases = keyword.query_phrases(asked, stem)
    found, lengths = keyword.read_index(chunks, phrases, stem)
    return keyword.keyword_search(phrases, found, k, lengths=lengths)


def keyword_topk(spark, d):
    """The best ten chunks of each query by BM25, without stemming so that SQL can follow."""
    hits = _keyword_hits(W.chunks(spark, d), W.queries(spark, d), 10)
    return hits.select("query_id", "chunk_id", F.round("bm25", 6).alias("bm25"), F.round(keyword.keyword_score(F.col("bm25")), 6).alias("score"), "rank")


def keyword_topk_stemmed(spark, d):
    """The same with Porter stems, over a stemmed index."""
    hits = _keyword_hits(W.chunks(spark, d), W.queries(spark, d), 10, stem=True)
    return hits.select("query_id", "chunk_id", F.round("bm25", 6).alias("bm25"), "rank")


_KEYWORD = f"""
, qt AS (SELECT query_id, list_filter(string_split_regex(query, '\\s+'), lambda x: x <> '') AS ts FROM v_queries),
qc AS (SELECT query_id, CASE WHEN len(list_filter(ts, lambda x: NOT list_contains({_list(K.KEYWORD_STOP_WORDS)}, lower(x)))) > 0 THEN list_filter(ts, lambda x: NOT list_contains({_list(K.KEYWORD_STOP_WORDS)}, lower(x))) ELSE ts END AS ts FROM qt),
qp AS (SELECT query_id, unnest(range(len(ts))) AS phrase, unnest(list_transform(ts, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS tok FROM qc),
qq AS (SELECT query_id, phrase, regexp_extract_all(tok, '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+')[1] AS term FROM qp),
ln AS (SELECT chunk_id, sum(tf) AS len FROM v_postings GROUP BY 1), tot AS (SELECT count(*) AS docs, avg(len) AS al FROM ln),
df AS (SELECT term, count(*) AS df FROM v_postings GROUP BY 1),
sc AS (SELECT query_id, chunk_id, sum(greatest(ln((docs - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / al))) AS bm25
  FROM qq JOIN v_postings USING (term) JOIN df USING (term) JOIN ln USING (chunk_id), tot GROUP BY 1, 2),
kw AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, chunk_id) AS rank FROM sc)
"""


def vector_topk(spark, d):
    vectors = W.table(spark, d, "embeddings")
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return V.vector_topk(asked, vectors.withColumnRenamed("vec_id", "chunk_id"), 10).select("query_id", F.col("chunk_id").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


def _hybrid(spark, d, chunks=None):
    v = W.table(spark, d, "embeddings")
    asked = W.queries(spark, d)
    vectors = asked.join(v.select((F.col("vec_id") / 10).cast("long").alias("query_id"), "vec_id", "embedding").where("vec_id % 10 = 0"), "query_id")
    kw = _keyword_hits(W.chunks(spark, d) if chunks is None else chunks, asked, 30)
    sem = V.vector_topk(vectors, v.withColumnRenamed("vec_id", "chunk_id"), 30).withColumn("chunk_id", F.concat(F.col("chunk_id").cast("string"), F.lit(":0")))
    return search.rrf_merge(kw, sem, 0.3, 0.7)


def rrf_hybrid(spark, d):
    return _hybrid(spark, d).where("rank <= 20").select("query_id", "chunk_id", "keyword_rank", "semantic_rank", F.round("rrf_score", 9).alias("rrf_score"), "rank")


_HYBRID = (
    _KEYWORD
    + """, vq AS (SELECT vec_id // 10 AS query_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 10 = 0 AND vec_id // 10 IN (SELECT query_id FROM v_queries)),
vs AS (SELECT query_id, vec_id || ':0' AS chunk_id, vec_id, list_cosine_similarity(e, CAST(embedding AS DOUBLE[])) AS s FROM vq, embeddings),
sem AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS rank FROM vs),
rr AS (SELECT coalesce(k.query_id, s.query_id) AS query_id, coalesce(k.chunk_id, s.chunk_id) AS chunk_id, k.rank AS keyword_rank, s.rank AS semantic_rank,
  coalesce(CAST(0.3 AS DOUBLE) / (60 + k.rank), 0) + coalesce(CAST(0.7 AS DOUBLE) / (60 + s.rank), 0) AS rrf_score
  FROM (SELECT * FROM kw WHERE rank <= 30) k FULL JOIN (SELECT * FROM sem WHERE rank <= 30) s USING (query_id, chunk_id)),
hy AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 12) DESC, keyword_rank NULLS LAST, semantic_rank NULLS LAST, chunk_id) AS rank FROM rr)
"""
)


def _reranked(spark, d, chunks=None):
    chunks = W.chunks(spark, d) if chunks is None else chunks
    top = _hybrid(spark, d, chunks).where("rank <= 20").join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    scratch = Scratch(spark, "rerank")
    top = scratch.table(top, "candidates")
    held = scratch.table(chunks.join(top.select("chunk_id").distinct(), "chunk_id", "left_semi"), "chunks")
    return search.rerank(W.queries(spark, d), top, held)


def rerank_blend(spark, d):
    return _reranked(spark, d).select("query_id", "chunk_id", F.round("cos", 6).alias("cos"), F.round("rerank_score", 6).alias("rerank_score"), "rerank_rank")


_RERANK = (
    _HYBRID
    + """, cand AS (SELECT h.* FROM hy h JOIN v_chunks USING (chunk_id) WHERE rank <= 20),
src AS (SELECT 'q' AS k, CAST(query_id AS VARCHAR) AS id, query AS body FROM v_queries UNION ALL SELECT 'c', chunk_id, content FROM v_chunks WHERE chunk_id IN (SELECT chunk_id FROM cand)),
wd AS (SELECT k, id, unnest(regexp_extract_all(lower(body), '[\\p{L}\\p{N}\\p{M}_]+')) AS w FROM src),
gr AS (SELECT k, id, unnest(CASE WHEN length(w) < 2 THEN [w] ELSE list_transform(range(1, length(w)), lambda i: substr(w, i, 2)) END) AS gram FROM wd),
gc AS (SELECT k, id, gram, count(*) AS c FROM gr GROUP BY ALL), tf AS (SELECT k, id, gram, c / sum(c) OVER (PARTITION BY k, id) AS tf FROM gc),
nm AS (SELECT k, id, sqrt(sum(tf * tf)) AS n FROM tf GROUP BY ALL),
dt AS (SELECT cand.query_id, cand.chunk_id, sum(a.tf * b.tf) AS dot FROM cand JOIN tf a ON a.k = 'q' AND a.id = CAST(cand.query_id AS VARCHAR) JOIN tf b ON b.k = 'c' AND b.id = cand.chunk_id AND a.gram = b.gram GROUP BY 1, 2),
rk AS (SELECT c.query_id, c.chunk_id, c.rrf_score, coalesce(dot / (x.n * y.n), 0) AS cos, 0.7 * coalesce(dot / (x.n * y.n), 0) + 0.3 * c.rrf_score / max(c.rrf_score) OVER (PARTITION BY c.query_id) AS rerank_score
  FROM cand c LEFT JOIN dt USING (query_id, chunk_id) LEFT JOIN nm x ON x.k = 'q' AND x.id = CAST(c.query_id AS VARCHAR) LEFT JOIN nm y ON y.k = 'c' AND y.id = c.chunk_id),
rn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rerank_score, 9) DESC, chunk_id) AS rerank_rank FROM rk)
"""
)


def context_budget(spark, d):
    chunks = W.chunks(spark, d)
    full = _reranked(spark, d, chunks).join(chunks, "chunk_id")
    return search.filter_and_budget(full, most_chunks=5, most_chars=6000).select("query_id", "chunk_id", "position", "chars")


_BUDGET = """, bd AS (SELECT rn.*, length(content) AS n FROM rn JOIN v_chunks USING (chunk_id) WHERE rrf_score >= 0.004),
bs AS (SELECT query_id, chunk_id, row_number() OVER w AS position, sum(n) OVER w AS chars FROM bd WINDOW w AS (PARTITION BY query_id ORDER BY rerank_rank ROWS UNBOUNDED PRECEDING))
SELECT query_id, chunk_id, position, CAST(chars AS BIGINT) AS chars FROM bs WHERE position <= 5 AND chars <= 6000"""


def answer_sources(spark, d):
    chunks = W.chunks(spark, d)
    hits = search.hydrate(_hybrid(spark, d, chunks).where("rank <= 20"), chunks, W.documents(spark, d))
    return search.answer_sources(hits)


_SOURCES = """, hd AS (SELECT query_id, rank, file_path, content FROM hy JOIN v_chunks USING (chunk_id) JOIN v_docs USING (doc_id) WHERE rank <= 8),
fs AS (SELECT *, row_number() OVER (PARTITION BY query_id, file_path ORDER BY rank) AS n FROM hd),
ix AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS source_index FROM fs WHERE n = 1)
SELECT query_id, source_index, file_path, string_split(file_path, '/')[-1] AS name, array_to_string(string_split(file_path, '/')[-2:], '/') AS label, substr(content, 1, 480) AS snippet, source_index <= 5 AS in_context FROM ix"""


def context_blocks(spark, d):
    chunks = W.chunks(spark, d)
    kept = search.filter_and_budget(_reranked(spark, d, chunks).join(chunks, "chunk_id").join(W.documents(spark, d).select("doc_id", "file_path"), "doc_id"), most_chars=6000)
    return search.context_block(kept).select("query_id", F.sha2("block", 256).alias("block_hash"), F.length("block").cast("long").alias("n"))


QUERIES = {f.__name__: f for f in (chunk_documents, chunk_stats, query_tokens, query_intent, typo_flags, abbreviations, abbreviation_expansions, postings, keyword_topk, keyword_topk_stemmed, vector_topk, rrf_hybrid, rerank_blend, context_budget, answer_sources, context_blocks)}

ORACLES = {
    "chunk_documents": W.sql(" SELECT doc_id, chunk_index, content, char_start, char_end FROM v_chunks", "v_chunks"),
    "chunk_stats": W.sql(" SELECT lang, count(*) AS n_chunks, min(length(content)) AS shortest, max(length(content)) AS longest, CAST(sum(length(content)) AS BIGINT) AS chars FROM v_chunks JOIN documents USING (doc_id) GROUP BY 1", "v_chunks"),
    "query_tokens": "WITH z AS (SELECT 1)" + _TOKENS + f""", u AS (SELECT *, list_filter(tokens, lambda x: NOT list_contains({_list(K.STOP_WORDS)}, x)) AS f FROM t),
e(k, i, term) AS (VALUES {_EXP}), o AS (SELECT query_id, f, unnest(f) AS k, unnest(range(len(f))) AS pos FROM u),
m AS (SELECT query_id, term, min(pos * 100 + i) AS first FROM o JOIN e USING (k) WHERE NOT list_contains(f, term) GROUP BY ALL),
g AS (SELECT query_id, list(term ORDER BY first) AS x FROM m GROUP BY 1)
SELECT query_id, normalised, array_to_string(tokens, '|') AS tokens, array_to_string(f, '|') AS filtered, coalesce(array_to_string(x, '|'), '') AS expanded,
  CASE WHEN array_to_string(list_concat(f, coalesce(x, [])), ' ') = '' THEN normalised ELSE array_to_string(list_concat(f, coalesce(x, [])), ' ') END AS search_text FROM u LEFT JOIN g USING (query_id)""",
    "query_intent": "WITH z AS (SELECT 1)" + _TOKENS + f"SELECT query_id, CASE WHEN list_has_any(tokens, {_list(K.COMPARISON_WORDS)}) THEN 'comparison' WHEN list_has_any(tokens, {_list(K.FACTUAL_WORDS)}) THEN 'factual' WHEN list_has_any(tokens, {_list(K.NAVIGATIONAL_WORDS)}) THEN 'navigational' ELSE 'exploratory' END AS intent FROM t",
    "typo_flags": "WITH z AS (SELECT 1)" + _TOKENS + """SELECT query_id, len(list_filter(tokens, lambda x: len(list_filter(range(1, length(x) - 1), lambda i: substr(x, i, 1) = substr(x, i + 1, 1) AND substr(x, i, 1) = substr(x, i + 2, 1))) > 0
  OR (length(x) BETWEEN 3 AND 6 AND length(regexp_replace(x, '[^\\p{L}]|[aeiou]', '', 'g')) / length(x) > 0.7))) > 0 AS has_typo FROM t""",
    "abbreviations": "WITH " + _ABBR + _ABBR_KEEP,
    "abbreviation_expansions": "WITH " + _ABBR + f"SELECT abbreviation, array_to_string(list_sort(list_distinct(list(definition))), '|') AS definitions FROM ({_ABBR_KEEP}) GROUP BY 1",
    "postings": W.sql(" SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, max(tf) AS max_tf FROM v_postings GROUP BY 1", "v_postings"),
    "keyword_topk": W.sql(_KEYWORD + "SELECT query_id, chunk_id, round(bm25, 6) AS bm25, round(1 / (1 + abs(bm25)), 6) AS score, rank FROM kw WHERE rank <= 10", "v_queries", "v_postings"),
    "vector_topk": """WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10""",
    "rrf_hybrid": W.sql(_HYBRID + "SELECT query_id, chunk_id, keyword_rank, semantic_rank, round(rrf_score, 9) AS rrf_score, rank FROM hy WHERE rank <= 20", "v_queries", "v_postings"),
    "rerank_blend": W.sql(_RERANK + "SELECT query_id, chunk_id, round(cos, 6) AS cos, round(rerank_score, 6) AS rerank_score, rerank_rank FROM rn", "v_queries", "v_postings"),
    "context_budget": W.sql(_RERANK + _BUDGET, "v_queries", "v_postings"),
    "context_blocks": W.sql(_RERANK + _BUDGET.split("SELECT query_id, chunk_id, position, CAST")[0] + """, bk AS (SELECT query_id, string_agg('[' || position || '] Source: ' || file_path || ' (chunk ' || chunk_index || ')' || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY position) AS block
  FROM bs JOIN v_chunks USING (chunk_id) JOIN v_docs USING (doc_id) WHERE position <= 5 AND chars <= 6000 GROUP BY 1)
SELECT query_id, sha256(block) AS block_hash, length(block) AS n FROM bk""", "v_queries", "v_postings", "v_docs"),
    "answer_sources": W.sql(_HYBRID + _SOURCES, "v_queries", "v_postings", "v_docs"),
}
