"""Queries over recommendations, proposals, replies and placement by search."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskit.functions import constants as K, text as T
from corpuskit.operators import clusters as C, conversations as H, graph as G, ingest as A, keyword, placement as P, search, vectors as V
from corpuskit.plans import views as W
from corpuskit.plans.graph_queries import _GRAPH, _PAIRS, _SCORE, _folders, _pairs
from corpuskit.plans.scratch import Scratch
from corpuskit.plans.table_queries import _PATHS, eligible_documents
from corpuskit.plans.text_queries import _KEYWORD


def small_talk(spark, d):
    return W.table(spark, d, "conversations").select("conv_id", "turn", T.is_small_talk(F.col("text")).alias("small"))


def relationship_replies(spark, d):
    """Model replies made of parts, with relationships between known names, one name twice, and unknown names."""
    p = W.table(spark, d, "part")
    name = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    relation = lambda a, b, more="": F.concat(F.lit('{"source":'), name(a), F.lit(',"target":'), name(b), F.lit(f',"type":"DEPENDS_ON"{more}}}'))
    body = F.concat(F.lit('{"entities":[{"name":'), name(F.col("p_name")), F.lit('},{"name":'), name(F.col("p_brand")), F.lit('}],"relationships":['), F.concat_ws(",", relation(F.upper("p_name"), F.col("p_brand"), ',"confidence":0.5'), relation(F.col("p_name"), F.lower("p_brand")), relation(F.col("p_brand"), F.upper("p_brand")), relation(F.col("p_name"), F.lit("nobody"))), F.lit("]}"))
    reply = F.when(F.col("p_partkey") % 3 == 0, body).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("Here:\n"), body, F.lit("\nDone."))).otherwise("none")
    replies = p.select(F.col("p_partkey").alias("reply_id"), F.col("p_brand").alias("doc_id"), reply.alias("reply"))
    return G.parse_relationship_replies(replies, G.parse_entity_replies(replies)).select("reply_id", "source", "target", "relationship_type", "confidence")


def focal_subgraph(spark, d):
    """The 20 most confident nodes around each nation."""
    names = W.table(spark, d, "nation").select(F.lower("n_name").alias("name"))
    return G.focal_subgraph(names, W.entities(spark, d), W.edges(spark, d), 1, 20)[0].select("seed", "id")


def pair_scores(spark, d):
    """Single pairs; the factor keeps scores off the halves that engines round apart."""
    return _pairs(spark, d).select("doc_id", "folder", P.score_pair(F.col("graph"), F.col("rerank") * 0.9973).alias("score"))


def audit_progress(spark, d):
    able = eligible_documents(spark, d)
    return P.audit_progress(able, able.where("doc_id % 3 = 0"), able.where("doc_id % 9 = 0"))


def _recommended(spark, d):
    """One recommendation per document: its source's folder and one below another source's."""
    one = lambda folder, score: F.struct(folder.alias("folder"), score.alias("score"), F.lit("x").alias("label"))
    told = F.array(one(F.concat(F.lit("/ws/"), "source"), (F.col("doc_id") % 10) / 10), one(F.concat(F.lit("/ws/src1/"), "lang"), F.lit(0.1)))
    status = F.when(F.col("doc_id") % 4 == 0, "dismissed").otherwise("pending")
    return W.documents(spark, d).select(F.col("doc_id").alias("id"), F.col("file_path").alias("source_path"), status.alias("status"), told.alias("recommendations"), F.lit(None).cast("string").alias("accepted_folder"))


def decided_recommendations(spark, d):
    """Every third document's recommendation is accepted."""
    said = W.table(spark, d, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("id"), F.lit("accepted").alias("status"), F.concat(F.lit("/ws/"), "lang").alias("folder"))
    return P.decide(_recommended(spark, d), said).select("id", "status", "accepted_folder")


def valid_targets(spark, d):
    """After the folder of one source is gone."""
    return P.drop_invalid_targets(_recommended(spark, d), "/ws/src1/").select("id", "status", F.size("recommendations").cast("long").alias("n"))


def reconciled_recommendations(spark, d):
    """After every fifth file is gone."""
    docs = W.documents(spark, d)
    return P.reconcile(docs, _recommended(spark, d), docs.where("doc_id % 5 <> 0"))[1].select("id", "status")


def affinity_weights(spark, d):
    pairs = W.table(spark, d, "events").select(F.col("user_id").cast("string").alias("entity"), F.col("event_type").alias("folder")).distinct()
    known = W.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("entity"), F.lit("view").alias("folder"), (F.col("c_custkey") % 7 / 8).alias("weight"))
    return C.affinity_weights(pairs, known)


def folder_proposals(spark, d):
    """Folders for the documents of each label of their vectors; every third set is proposed already."""
    clusters = W.table(spark, d, "embeddings").select(F.col("label").alias("cluster"), F.col("vec_id").alias("id"))
    done = clusters.where("cluster % 3 = 0").groupBy("cluster").agg(F.collect_list("id").alias("document_ids"))
    found = C.discover_proposals(clusters, W.terms(spark, d), done.select("document_ids"))
    return found.select("cluster", F.array_join(F.transform("document_ids", lambda x: x.cast("string")), ",").alias("documents"), "proposed_folder_name")


def decided_proposals(spark, d):
    """Moves of accepted proposals: suppliers by nation, of which even nations are accepted and every fourth was before."""
    sets = W.table(spark, d, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("id")).agg(F.sort_array(F.collect_list("s_suppkey")).alias("document_ids"))
    held = sets.select("id", F.when(F.col("id") % 4 == 0, "accepted").otherwise("pending").alias("status"), F.concat(F.lit("Folder "), F.col("id").cast("string")).alias("proposed_folder_name"), "document_ids", F.lit(None).cast("string").alias("accepted_folder"))
    said = sets.where("id % 2 = 0").select("id", F.lit("accepted").alias("status"), F.when(F.col("id") % 3 == 0, "Mine").alias("folder"))
    return C.decide_proposals(held, said)[1]


def conversation_messages(spark, d):
    said = W.table(spark, d, "conversations")
    last = said.agg(F.max("conv_id")).first()[0]
    return H.load_conversation(said, last).select("conv_id", "turn", "role")


def _listing(spark, d):
    """Documents as office files whose names carry marks of versions."""
    k = F.col("doc_id")
    mark = F.when(k % 4 == 0, "_final").when(k % 4 == 1, "_v2.1").when(k % 4 == 2, " (3)").otherwise("")
    ext = F.when(k % 3 == 0, ".pdf").when(k % 3 == 1, ".docx").otherwise(".txt")
    name = F.concat(F.lit("/ws/"), "source", F.lit("/Plan"), (k % 50).cast("string"), mark, ext)
    return A.profile_listing(W.table(spark, d, "documents").select(name.alias("file_path"), F.lit(None).cast("timestamp").alias("modified_at")), "/ws")


def listing_versions(spark, d):
    return _listing(spark, d)["versions"]


def listing_folders(spark, d):
    return _listing(spark, d)["folders"].select("folder", "files", F.array_join("top_extensions", ",").alias("top_extensions"), "project_like")


def placement_by_search(spark, d):
    """Folders of every 50th document by shared terms and by one hybrid search with its first chunk."""
    return P.score_folders(searched_pairs(spark, d)[0]).drop("forced")


def searched_pairs(spark, d):
    """Graph and rerank scores of every 50th document against the known folders, and these documents."""
    scratch = Scratch(spark, "placement_by_search")
    docs, chunks = W.documents(spark, d), W.chunks(spark, d)
    asked = chunks.where("chunk_index = 0 and doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.array_join(keyword.terms(F.col("content")), " ").alias("query"))
    asked = scratch.table(asked, "asked")
    phrases = keyword.query_phrases(asked, False)
    words = _word_hits(chunks, phrases)
    v = W.table(spark, d, "embeddings")
    near = V.vector_topk(asked.join(v.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id"), v.withColumnRenamed("vec_id", "chunk_id"), 90)
    near = near.withColumn("chunk_id", F.concat(F.col("chunk_id").cast("string"), F.lit(":0")))
    hits = search.rrf_merge(words, near, 0.3, 0.7).where("rank <= 30").join(chunks.select("chunk_id", "doc_id"), "chunk_id").join(docs.select("doc_id", "file_path"), "doc_id")
    rerank = P.rerank_scores(hits.select(F.col("query_id").alias("doc_id"), "file_path", "rank", "rrf_score"))
    folders = _folders(spark, d).withColumn("folder", F.concat(F.lit("/ws/"), "folder"))
    mine = docs.join(asked.select(F.col("query_id").alias("doc_id")), "doc_id", "left_semi")
    graph = P.graph_scores(W.terms(spark, d).where("doc_id % 50 = 0").select("doc_id", "term").join(mine.select("doc_id"), "doc_id", "left_semi"), folders)
    return P.candidate_pairs(graph, rerank, mine, docs.select(F.col("workspace_path").alias("folder")).distinct()), mine


def _word_hits(chunks, phrases):
    found, lengths = keyword.read_index(chunks, phrases, False)
    return keyword.keyword_topk(phrases, found, 90, lengths=lengths)


_SEARCHED = (
    ", v_queries AS (SELECT doc_id AS query_id, array_to_string(regexp_extract_all(translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\\x{80}-\\x{10FFFF}]+'), ' ') AS query FROM v_chunks WHERE chunk_index = 0 AND doc_id % 50 = 0)"
    + _KEYWORD
    + """, vs AS (SELECT q.vec_id AS query_id, e.vec_id, e.vec_id || ':0' AS chunk_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS s FROM embeddings q, embeddings e WHERE q.vec_id IN (SELECT query_id FROM v_queries)),
sem AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS rank FROM vs),
rr AS (SELECT coalesce(k.query_id, s.query_id) AS query_id, coalesce(k.chunk_id, s.chunk_id) AS chunk_id, k.rank AS keyword_rank, s.rank AS semantic_rank, coalesce(CAST(0.3 AS DOUBLE) / (60 + k.rank), 0) + coalesce(CAST(0.7 AS DOUBLE) / (60 + s.rank), 0) AS rrf_score
  FROM (SELECT * FROM kw WHERE rank <= 90) k FULL JOIN (SELECT * FROM sem WHERE rank <= 90) s USING (query_id, chunk_id)),
hy AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 12) DESC, keyword_rank NULLS LAST, semantic_rank NULLS LAST, chunk_id) AS rank FROM rr),
hd AS (SELECT query_id, workspace_path AS folder, rrf_score, row_number() OVER (PARTITION BY query_id, workspace_path ORDER BY rank) AS n FROM hy JOIN v_chunks USING (chunk_id) JOIN v_docs USING (doc_id) WHERE rank <= 30),
rs AS (SELECT query_id AS doc_id, folder, avg(rrf_score) AS rerank FROM hd WHERE n <= 5 GROUP BY 1, 2)"""
    + _GRAPH
    + """, gm AS (SELECT doc_id, '/ws/' || folder AS folder, graph FROM gs WHERE doc_id IN (SELECT query_id FROM v_queries)),
pq AS (SELECT doc_id, folder, coalesce(graph, 0) AS graph, coalesce(rerank, 0) AS rerank FROM gm FULL JOIN rs USING (doc_id, folder) WHERE folder <> (SELECT workspace_path FROM v_docs WHERE v_docs.doc_id = coalesce(gm.doc_id, rs.doc_id)))"""
    + _SCORE.format(pairs="pq", gate="0.1")
)

QUERIES = {
    f.__name__: f
    for f in (
        small_talk, relationship_replies, focal_subgraph, pair_scores, audit_progress, decided_recommendations, valid_targets, reconciled_recommendations, affinity_weights, folder_proposals, decided_proposals, conversation_messages, listing_versions, listing_folders,
        placement_by_search,
    )
}

_TALK = K.SMALL_TALK.removeprefix("(?i)").replace("'", "''")
_RECOMMENDED = """WITH re AS (SELECT doc_id AS id, source, lang, CASE WHEN doc_id % 4 = 0 THEN 'dismissed' ELSE 'pending' END AS status FROM documents) """
ORACLES = {
    "small_talk": f"SELECT conv_id, turn, regexp_matches(text, '{_TALK}', 'i') OR len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) < 3 AS small FROM conversations",
    "relationship_replies": "SELECT p_partkey AS reply_id, upper(p_name) AS source, p_brand AS target, 'DEPENDS_ON' AS relationship_type, CAST(0.5 AS DOUBLE) AS confidence FROM part WHERE p_partkey % 3 < 2",
    "focal_subgraph": W.sql(", nb AS (SELECT 'n' || n_nationkey AS seed, 'n' || n_nationkey AS id FROM nation UNION SELECT 'n' || n_nationkey, nxt FROM nation JOIN v_both ON id = 'n' || n_nationkey) SELECT seed, id FROM (SELECT seed, id, row_number() OVER (PARTITION BY seed ORDER BY confidence DESC, id) AS n FROM nb JOIN v_entities USING (id)) WHERE n <= 20", "v_both", "v_entities"),
    "pair_scores": W.sql(_PAIRS + " SELECT doc_id, folder, CASE WHEN graph < 0.1 THEN 0 ELSE round(0.75 * graph + 0.25 * rerank * 0.9973, 4) END AS score FROM pr", "v_terms"),
    "audit_progress": _PATHS + "SELECT count_if(doc_id % 3 = 0)::BIGINT AS analysed, count(*) AS total, count_if(doc_id % 9 = 0)::BIGINT AS found FROM el",
    "decided_recommendations": _RECOMMENDED + "SELECT id, CASE WHEN id % 3 = 0 AND status = 'pending' THEN 'accepted' ELSE status END AS status, CASE WHEN id % 3 = 0 AND status = 'pending' THEN '/ws/' || lang END AS accepted_folder FROM re",
    "valid_targets": _RECOMMENDED + "SELECT id, CASE WHEN status = 'pending' AND source = 'src1' THEN 'dismissed' ELSE status END AS status, CASE WHEN status = 'pending' THEN CASE WHEN source = 'src1' THEN 0 ELSE 1 END ELSE 2 END::BIGINT AS n FROM re",
    "reconciled_recommendations": _RECOMMENDED + "SELECT id, CASE WHEN id % 5 = 0 OR id % 10 < 2 THEN 'dismissed' ELSE status END AS status FROM re",
    "affinity_weights": "WITH p AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS entity, event_type AS folder FROM events) SELECT entity, folder, coalesce(c_custkey % 7 / 8, CAST(1 AS DOUBLE)) AS weight FROM p LEFT JOIN customer ON CAST(c_custkey AS VARCHAR) = entity AND folder = 'view'",
    "folder_proposals": W.sql(""", tc AS (SELECT label AS cluster, term, count(DISTINCT doc_id) AS n FROM embeddings JOIN v_terms ON doc_id = vec_id WHERE label % 3 <> 0 GROUP BY 1, 2), tr AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, term) AS r FROM tc),
nm AS (SELECT cluster, string_agg(upper(term[1:1]) || term[2:], ' ' ORDER BY r) AS s FROM tr WHERE r <= 3 GROUP BY 1), ds AS (SELECT label AS cluster, string_agg(vec_id, ',' ORDER BY vec_id) AS documents FROM embeddings WHERE label % 3 <> 0 GROUP BY 1)
SELECT cluster, documents, CASE WHEN length(s) <= 60 THEN s ELSE regexp_extract(s[1:60], '^(.+) [^ ]*$', 1) END AS proposed_folder_name FROM ds JOIN nm USING (cluster)""", "v_terms"),
    "decided_proposals": "SELECT s_suppkey AS doc_id, CASE WHEN s_nationkey % 3 = 0 THEN 'Mine' ELSE 'Folder ' || s_nationkey END AS folder FROM supplier WHERE s_nationkey % 2 = 0 AND s_nationkey % 4 <> 0",
    "conversation_messages": "SELECT conv_id, turn, role FROM conversations WHERE conv_id = (SELECT max(conv_id) FROM conversations)",
    "listing_versions": "WITH l AS (SELECT source, doc_id % 50 AS s FROM documents) SELECT source AS folder, 'plan' || s AS stem, count(*) AS names FROM l GROUP BY 1, 2, source, s HAVING count(*) > 1",
    "listing_folders": """WITH l AS (SELECT source AS folder, CASE doc_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx' ELSE '.txt' END AS ext FROM documents), c AS (SELECT folder, ext, count(*) AS n FROM l GROUP BY 1, 2)
SELECT folder, CAST(sum(n) AS BIGINT) AS files, string_agg(ext, ',' ORDER BY n DESC, ext) AS top_extensions, coalesce(sum(n) FILTER (ext <> '.txt'), 0) >= 5 AS project_like FROM c GROUP BY 1""",
    "placement_by_search": W.sql(_SEARCHED, "v_docs", "v_chunks", "v_postings", "v_terms"),
}
