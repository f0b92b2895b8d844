"""Queries over the graph, folders and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskit.functions import constants as K, text as T
from corpuskit.operators import clusters as C, graph as G, placement as P, vectors as V
from corpuskit.operators.conversations import pending_counts
from corpuskit.plans import views as W
from corpuskit.plans.table_queries import _FLOATING, _PATHS, floating_documents
from corpuskit.plans.text_queries import _list


def entity_upsert(spark, d):
    """Parts as extracted twice, the second time with other confidence and spelling."""
    p = W.table(spark, d, "part").select(F.col("p_brand").alias("doc_id"), F.col("p_name").alias("name"), F.lit("Product").alias("entity_type"), (F.col("p_size") / 100).alias("confidence"), F.col("p_partkey").alias("seq"))
    return G.upsert_entities(p).select("id", "name", "source_document_id", F.round("confidence", 6).alias("confidence"), "canonical")


def relationship_upsert(spark, d):
    """Orders as relationships between nations, named in other case."""
    n = W.table(spark, d, "nation").select(F.lit(1).alias("doc_id"), F.col("n_name").alias("name"), F.lit("Location").alias("entity_type"), F.lit(1.0).alias("confidence"), F.col("n_nationkey").alias("seq"))
    entities = G.upsert_entities(n)
    o = W.table(spark, d, "orders").select(F.lit(1).alias("doc_id"), F.concat(F.lit("nation_"), (F.col("o_custkey") % 30).cast("string")).alias("source"), F.concat(F.lit("NATION_"), (F.col("o_orderkey") % 25).cast("string")).alias("target"), F.lit("RELATED_TO").alias("relationship_type"), (F.round("o_totalprice") % 100 / 100).alias("confidence"))
    return G.upsert_relationships(o, entities).select("id", "source_id", "target_id", F.round("confidence", 6).alias("confidence"))


def entity_replies(spark, d):
    """Model replies made of parts: good JSON, JSON in prose, and none."""
    p = W.table(spark, d, "part")
    body = F.concat(F.lit('{"entities":[{"name":" '), "p_name", F.lit('","type":"Product","confidence":'), (F.col("p_size") / 25).cast("string"), F.lit('},{"name":"'), F.upper("p_name"), F.lit('","type":"Product"},{"name":"'), "p_brand", F.lit('","type":"Brand"}]}'))
    reply = F.when(F.col("p_partkey") % 3 == 0, body).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise("no entities")
    return G.parse_entity_replies(p.select(F.col("p_partkey").alias("reply_id"), F.col("p_brand").alias("doc_id"), reply.alias("reply"))).select("reply_id", "name", "entity_type", F.round("confidence", 6).alias("confidence"))


def shared_entity_links(spark, d):
    return G.link_shared_entities(W.entities(spark, d)).select("source_id", "target_id", F.round("confidence", 6).alias("confidence"))


def merged_entities(spark, d):
    return G.merge_duplicates(W.entities(spark, d), W.edges(spark, d))[0].select("id", "name", "source_document_id", F.round("confidence", 6).alias("confidence"))


def _links(spark, d):
    """Edges from customers to parts, dealt over all of them, besides the others, so that merging moves ends."""
    parts = W.table(spark, d, "part").agg(F.count("*").alias("n"))
    o = W.table(spark, d, "orders").crossJoin(F.broadcast(parts)).select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("source_id"), F.concat(F.lit("p"), (F.col("o_orderkey") % F.col("n")).cast("string")).alias("target_id"), F.lit("OWNS").alias("relationship_type"), (F.round("o_totalprice") % 10 / 10).alias("confidence"))
    return o.unionByName(W.edges(spark, d))


def merged_edges(spark, d):
    return G.merge_duplicates(W.entities(spark, d), _links(spark, d))[1].select("source_id", "target_id", "relationship_type", F.round("confidence", 6).alias("confidence"))


_MERGE = """, mm AS (SELECT id, arg_max(id, {'c': confidence, 'i': id}) OVER (PARTITION BY entity_type, canonical) AS winner FROM v_entities)"""


def search_entities(spark, d):
    q = W.table(spark, d, "region").select(F.col("r_regionkey").alias("query_id"), F.concat(F.lit("_"), F.col("r_regionkey").cast("string")).alias("query"))
    return G.search_entities(q, W.entities(spark, d), 50).select("query_id", "id", "rank")


def k_hop_neighbourhood(spark, d):
    """Around every 50th supplier."""
    seeds = W.table(spark, d, "supplier").where("s_suppkey % 50 = 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"))
    return G.k_hop(seeds, W.edges(spark, d), 2).select("seed", "id", F.col("hops").cast("long").alias("hops"))


def entity_context_edges(spark, d):
    """Around all nations."""
    names = W.table(spark, d, "nation").select(F.lower("n_name").alias("name"))
    return G.entity_context(names, W.entities(spark, d), W.edges(spark, d), 1)[1].select("seed", "source_id", "target_id")


def connected_documents(spark, d):
    q = W.table(spark, d, "region").select(F.col("r_regionkey").alias("query_id"), F.lower("r_name").alias("query"))
    return G.connected_documents(q, W.entities(spark, d), W.edges(spark, d))


def shortest_paths(spark, d):
    """From four of every 50 suppliers; one of the four asks for a node without edges."""
    s = W.table(spark, d, "supplier").where("s_suppkey % 50 < 4")
    pairs = s.select(F.col("s_suppkey").alias("pair_id"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("source_id"), F.when(F.col("s_suppkey") % 4 == 3, "p1").otherwise(F.concat(F.lit("s"), (F.col("s_suppkey") + 7).cast("string"))).alias("target_id"))
    return G.shortest_paths(pairs, W.edges(spark, d)).select("pair_id", "found", "length", F.array_join("path", ">").alias("path"))


def graph_overview(spark, d):
    nodes, edges = G.graph_overview(W.entities(spark, d), W.edges(spark, d))
    n = edges.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("n_edges"))
    return nodes.select("id", "source_document_id").join(n, "id", "left")


def document_vectors(spark, d):
    means = V.document_vectors(W.vectors(spark, d))
    return means.select("document_id", F.round(F.col("embedding")[0], 6).alias("x0"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.size("embedding").cast("long").alias("dims"))


def wrong_dims(spark, d):
    return V.wrong_dims(W.vectors(spark, d), 64)


def _folders(spark, d):
    """Terms of folders: those that at least two of a source's documents hold."""
    t = W.terms(spark, d)
    return t.groupBy(F.col("source").alias("folder"), "term").agg(F.count("*").alias("n")).where("n >= 2").select("folder", "term")


_FOLDERS = ", ft AS (SELECT source AS folder, term FROM v_terms GROUP BY ALL HAVING count(*) >= 2), dt AS (SELECT doc_id, term FROM v_terms)"
_GENERIC = f"NOT list_contains({_list(K.GENERIC_TERMS)}, term)"
_GRAPH = (
    _FOLDERS
    + f", dg AS (SELECT * FROM dt WHERE {_GENERIC}), fg AS (SELECT * FROM ft WHERE {_GENERIC}), dn AS (SELECT doc_id, count(*) AS n FROM dg GROUP BY 1), fn AS (SELECT folder, count(*) AS n FROM fg GROUP BY 1),"
    + " gs AS (SELECT doc_id, folder, count(*) / least(any_value(dn.n), any_value(fn.n)) AS graph, count(*) AS shared FROM dg JOIN fg USING (term) JOIN dn USING (doc_id) JOIN fn USING (folder) GROUP BY 1, 2)"
)


def folder_overlap(spark, d):
    return P.graph_scores_of_sets(W.term_sets(spark, d), _folders(spark, d)).select("doc_id", "folder", F.round("graph", 6).alias("graph"))


def _pairs(spark, d):
    """Graph scores with rerank scores made of ids."""
    graph = P.graph_scores_of_sets(W.term_sets(spark, d), _folders(spark, d))
    rerank = F.pmod(F.col("doc_id") * 31 + F.substring("folder", 4, 9).cast("long") * 17, F.lit(40)) / 2000
    return graph.withColumn("rerank", rerank)


_PAIRS = _GRAPH + ", pr AS (SELECT doc_id, folder, graph, (doc_id * 31 + CAST(substr(folder, 4) AS BIGINT) * 17) % 40 / CAST(2000 AS DOUBLE) AS rerank FROM gs)"
_SCORE = """, s1 AS (SELECT *, max(rerank) OVER (PARTITION BY doc_id) AS best, row_number() OVER (PARTITION BY doc_id ORDER BY rerank DESC, folder) AS r2 FROM {pairs}),
s2 AS (SELECT *, coalesce(max(CASE WHEN r2 = 2 THEN rerank END) OVER (PARTITION BY doc_id), 0) AS second, round(CASE WHEN graph < {gate} THEN 0 ELSE 0.75 * graph + 0.25 * CASE WHEN best >= 0.006 THEN rerank / best ELSE 0 END END, 4) AS sc FROM s1),
s3 AS (SELECT *, max(CASE WHEN sc >= 0.2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) = 0 AND best >= 0.012 AND (second = 0 OR best / second >= 2.5) AS fb FROM s2),
s4 AS (SELECT *, CASE WHEN fb THEN round(0.25 * rerank / best, 4) ELSE sc END AS score FROM s3),
s5 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, folder) AS rank FROM s4 WHERE score >= CASE WHEN fb THEN 0.18 ELSE 0.2 END)
SELECT doc_id, folder, score, CASE WHEN score >= 0.6 THEN 'Strong match' WHEN score >= 0.3 THEN 'Good match' ELSE 'Possible match' END AS label, rank FROM s5 WHERE rank <= 3"""


def placement_top3(spark, d):
    return P.score_folders(_pairs(spark, d)).drop("forced")


def placement_fallback(spark, d):
    """Pairs whose graph scores say nothing: only a clear winner by rerank counts."""
    pairs = _pairs(spark, d).withColumn("graph", F.lit(0.0)).where("doc_id % 4 <> 0 or folder < 'src1'").withColumn("rerank", F.when(F.col("rerank") > 0.0185, F.col("rerank")).otherwise(F.col("rerank") / 4))
    return P.score_folders(pairs).drop("forced")


def recommendations(spark, d):
    docs = W.documents(spark, d)
    made = P.recommend_new_files(P.score_folders(_pairs(spark, d)).select("doc_id", "folder", F.lit(0.9).alias("graph"), F.lit(0.01).alias("rerank")), docs)
    return pending_counts(made)


def audit_moves(spark, d):
    """Documents in the folder of their source against the folders of all sources."""
    docs = W.documents(spark, d).withColumn("file_path", F.concat(F.lit("/w/"), "source", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt")))
    pairs = _pairs(spark, d).withColumn("folder", F.concat(F.lit("/w/"), "folder"))
    return P.audit_documents(pairs, docs)


_AUDIT = """, a1 AS (SELECT pr.*, folder = source AS own, max(rerank) OVER (PARTITION BY doc_id) AS best, row_number() OVER (PARTITION BY doc_id ORDER BY rerank DESC, folder) AS r2 FROM pr JOIN documents USING (doc_id)),
a2 AS (SELECT *, coalesce(max(CASE WHEN r2 = 2 THEN rerank END) OVER (PARTITION BY doc_id), 0) AS second, round(0.75 * graph + 0.25 * CASE WHEN best >= 0.006 THEN rerank / best ELSE 0 END, 4) AS sc FROM a1),
a3 AS (SELECT *, max(CASE WHEN sc >= 0.2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) = 0 AND best >= 0.012 AND (second = 0 OR best / second >= 2.5) AS fb FROM a2),
a4 AS (SELECT *, CASE WHEN fb THEN round(0.25 * rerank / best, 4) ELSE sc END AS score FROM a3),
a5 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, folder) AS rank FROM a4 WHERE own OR score >= CASE WHEN fb THEN 0.18 ELSE 0.2 END),
a6 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, folder) AS n FROM a5 WHERE rank <= 3 AND NOT own),
a7 AS (SELECT t.doc_id, '/w/' || d.source AS current_folder, coalesce(o.score, 0) AS current_score, '/w/' || t.folder AS folder, t.score FROM a6 t JOIN documents d USING (doc_id) LEFT JOIN (SELECT doc_id, score FROM a5 WHERE own) o USING (doc_id) WHERE n = 1)
SELECT * FROM a7 WHERE score >= 0.22 AND round(score - current_score, 4) >= 0.5"""


def _stray(spark, d):
    """All floating documents."""
    return floating_documents(spark, d).select("doc_id")


def _vectors(spark, d):
    return W.table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding").where("doc_id % 9 <> 0")


def pair_distances(spark, d):
    return C.pair_distances(W.terms(spark, d), _vectors(spark, d), _stray(spark, d)).select("a", "b", F.round("distance", 6).alias("distance"))


_DIST = ", " + _PATHS.removeprefix("WITH ") + _FLOATING + """, st AS (SELECT DISTINCT doc_id, term FROM v_terms WHERE doc_id IN (SELECT doc_id FROM fd)), sz AS (SELECT doc_id, count(*) AS n FROM st GROUP BY 1),
sh AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM st x JOIN st y USING (term) WHERE x.doc_id < y.doc_id GROUP BY 1, 2),
ve AS (SELECT doc_id AS vec_id, CASE WHEN doc_id % 9 <> 0 THEN CAST(embedding AS DOUBLE[]) END AS e FROM fd LEFT JOIN embeddings ON vec_id = doc_id),
pd AS (SELECT x.vec_id AS a, y.vec_id AS b, greatest(0, 1 - (0.75 * coalesce(c / least(p.n, q.n), 0) + 0.25 * coalesce(list_cosine_similarity(x.e, y.e), 0))) AS distance
  FROM ve x JOIN ve y ON x.vec_id < y.vec_id LEFT JOIN sh ON sh.a = x.vec_id AND sh.b = y.vec_id LEFT JOIN sz p ON p.doc_id = x.vec_id LEFT JOIN sz q ON q.doc_id = y.vec_id)
"""


def cluster_components(spark, d):
    return C.near_components(W.terms(spark, d), _vectors(spark, d), _stray(spark, d))


def cluster_average_linkage(spark, d):
    return C.linked_components(cluster_components(spark, d), W.terms(spark, d), _vectors(spark, d))


def cluster_names(spark, d):
    """Names of the components by their documents' terms."""
    members = cluster_components(spark, d).select(F.col("component").alias("cluster"), F.col("node").alias("id"))
    return C.name_clusters(members, W.terms(spark, d))


def document_terms(spark, d):
    """Terms of nations as documents: their entities, neighbours and names."""
    docs = W.table(spark, d, "nation").select(F.concat(F.lit("nation_"), F.col("n_nationkey").cast("string")).alias("doc_id"), F.concat(F.lit("/ws/Travel-Plan "), "n_name", F.lit("_the 2024.v2.txt")).alias("file_path"))
    return G.document_terms(docs, W.entities(spark, d), W.edges(spark, d)).join(docs, "doc_id", "left_semi").groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.count_if(F.col("term").isin("travel", "plan", "travel plan")).alias("n_words"))


def folder_terms(spark, d):
    docs = W.documents(spark, d).select("doc_id", "file_path")
    return G.folder_terms(docs, W.terms(spark, d).select("doc_id", "term")).groupBy("folder").agg(F.count("*").alias("n_terms"))


def path_parts(spark, d):
    path = W.documents(spark, d).select("doc_id", F.concat(F.lit("/ws/Project_Plan-2024/the Depot charging v"), F.col("doc_id").cast("string"), F.lit(".final.pdf")).alias("p"))
    return path.select("doc_id", F.array_join(T.filename_words(F.col("p")), "|").alias("words"), F.array_join(T.filename_bigrams(F.col("p")), "|").alias("bigrams"), T.extension(F.col("p")).alias("ext"), F.array_join(T.ancestors(F.col("p")), "|").alias("above"))


QUERIES = {
    f.__name__: f
    for f in (
        entity_upsert, relationship_upsert, entity_replies, shared_entity_links, merged_entities, merged_edges, search_entities, k_hop_neighbourhood, entity_context_edges, connected_documents, shortest_paths, graph_overview, document_vectors, wrong_dims,
        folder_overlap, placement_top3, placement_fallback, recommendations, audit_moves, pair_distances, cluster_components, cluster_average_linkage, cluster_names, document_terms, folder_terms, path_parts,
    )
}

_UUID = "lower(h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', CAST(('0x' || h[17:17]) AS INTEGER) % 4 + 1, 1) || h[18:20] || '-' || h[21:32])"
_SHA = "sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode({}))"
ORACLES = {
    "entity_upsert": f"""WITH g AS (SELECT p_brand, p_name, max(p_size / 100) AS c FROM part GROUP BY 1, 2), h AS (SELECT *, {_SHA.format("p_brand || ':' || p_name")} AS h FROM g)
SELECT {_UUID} AS id, p_name AS name, p_brand AS source_document_id, round(c, 6) AS confidence, lower(p_name) AS canonical FROM h""",
    "relationship_upsert": f"""WITH e AS (SELECT n_nationkey AS k, {_SHA.format("'1:' || n_name")} AS h FROM nation), i AS (SELECT k, {_UUID} AS id FROM e),
r AS (SELECT s.id AS source_id, t.id AS target_id, max(round(o_totalprice) % 100 / 100) AS c FROM orders JOIN i s ON s.k = o_custkey % 30 JOIN i t ON t.k = o_orderkey % 25 WHERE s.k <> t.k GROUP BY 1, 2),
x AS (SELECT *, {_SHA.format("source_id || ':' || target_id || ':RELATED_TO'")} AS h FROM r) SELECT {_UUID} AS id, source_id, target_id, round(c, 6) AS confidence FROM x""",
    "entity_replies": "SELECT p_partkey AS reply_id, unnest([p_name, p_brand]) AS name, unnest(['Product', 'Concept']) AS entity_type, round(unnest([least(p_size / 25, 1.0), 1.0]), 6) AS confidence FROM part WHERE p_partkey % 3 < 2",
    "shared_entity_links": W.sql(""", sh AS (SELECT canonical FROM v_entities GROUP BY 1 HAVING count(DISTINCT source_document_id) BETWEEN 2 AND 20)
SELECT a.id AS source_id, b.id AS target_id, round(least(a.confidence, b.confidence), 6) AS confidence FROM v_entities a JOIN v_entities b ON a.canonical = b.canonical AND a.id < b.id WHERE a.canonical IN (SELECT canonical FROM sh)""", "v_entities"),
    "merged_entities": W.sql(_MERGE + " SELECT id, name, source_document_id, round(confidence, 6) AS confidence FROM v_entities JOIN mm USING (id) WHERE id = winner", "v_entities"),
    "merged_edges": W.sql(_MERGE + """, lk AS (SELECT 'c' || o_custkey AS source_id, 'p' || (o_orderkey % (SELECT count(*) FROM part)) AS target_id, 'OWNS' AS relationship_type, round(o_totalprice) % 10 / 10 AS confidence FROM orders UNION ALL SELECT * FROM v_edges),
mv AS (SELECT coalesce(x.winner, source_id) AS source_id, coalesce(y.winner, target_id) AS target_id, relationship_type, confidence FROM lk LEFT JOIN mm x ON x.id = source_id LEFT JOIN mm y ON y.id = target_id)
SELECT source_id, target_id, relationship_type, round(max(confidence), 6) AS confidence FROM mv WHERE source_id <> target_id GROUP BY ALL""", "v_entities", "v_edges"),
    "search_entities": W.sql(" SELECT query_id, id, rank FROM (SELECT r_regionkey AS query_id, id, row_number() OVER (PARTITION BY r_regionkey ORDER BY confidence DESC, id) AS rank FROM v_entities JOIN region ON contains(lower(name), '_' || r_regionkey)) WHERE rank <= 50", "v_entities"),
    "k_hop_neighbourhood": W.sql(", kh(seed, id, hops) AS (SELECT 's' || s_suppkey, 's' || s_suppkey, 0 FROM supplier WHERE s_suppkey % 50 = 0 UNION SELECT seed, nxt, hops + 1 FROM kh JOIN v_both USING (id) WHERE hops < 2) SELECT seed, id, CAST(min(hops) AS BIGINT) AS hops FROM kh GROUP BY 1, 2", "v_both"),
    "entity_context_edges": W.sql(", nb AS (SELECT 'n' || n_nationkey AS seed, 'n' || n_nationkey AS id FROM nation UNION SELECT 'n' || n_nationkey, nxt FROM nation JOIN v_both ON id = 'n' || n_nationkey) SELECT a.seed, source_id, target_id FROM v_edges JOIN nb a ON a.id = source_id JOIN nb b ON b.id = target_id AND a.seed = b.seed", "v_both"),
    "connected_documents": W.sql(""", sd AS (SELECT r_regionkey AS query_id, id FROM region JOIN v_entities ON contains(lower(name), lower(r_name))), c1 AS (SELECT * FROM sd UNION SELECT query_id, nxt FROM sd JOIN v_both USING (id)), c2 AS (SELECT * FROM c1 UNION SELECT query_id, nxt FROM c1 JOIN v_both USING (id)),
dc AS (SELECT DISTINCT query_id, source_document_id AS doc_id FROM c2 JOIN v_entities USING (id)) SELECT query_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS n FROM dc) WHERE n <= 50""", "v_both", "v_entities"),
    "shortest_paths": W.sql(""", pr AS (SELECT s_suppkey AS pair_id, 's' || s_suppkey AS a, CASE WHEN s_suppkey % 4 = 3 THEN 'p1' ELSE 's' || (s_suppkey + 7) END AS b FROM supplier WHERE s_suppkey % 50 < 4),
n1 AS (SELECT pair_id, b, [a] AS p FROM pr), n2 AS (SELECT pair_id, b, list_append(p, nxt) AS p FROM n1 JOIN v_both ON id = p[-1]), n3 AS (SELECT pair_id, b, list_append(p, nxt) AS p FROM n2 JOIN v_both ON id = p[-1] WHERE NOT list_contains(p, nxt) AND p[-1] <> b),
n4 AS (SELECT pair_id, b, list_append(p, nxt) AS p FROM n3 JOIN v_both ON id = p[-1] WHERE NOT list_contains(p, nxt) AND p[-1] <> b AND nxt[1] <> 'c'), n5 AS (SELECT pair_id, b, list_append(p, nxt) AS p FROM n4 JOIN v_both ON id = p[-1] WHERE NOT list_contains(p, nxt) AND p[-1] <> b AND nxt[1] <> 'c'),
n6 AS (SELECT pair_id, b, list_append(p, nxt) AS p FROM n5 JOIN v_both ON id = p[-1] WHERE NOT list_contains(p, nxt) AND p[-1] <> b AND (nxt = b OR nxt[1] NOT IN ('c', 's'))), n7 AS (SELECT pair_id, b, list_append(p, nxt) AS p FROM n6 JOIN v_both ON id = p[-1] WHERE NOT list_contains(p, nxt) AND p[-1] <> b AND nxt = b),
al AS (SELECT * FROM n1 UNION ALL SELECT * FROM n2 UNION ALL SELECT * FROM n3 UNION ALL SELECT * FROM n4 UNION ALL SELECT * FROM n5 UNION ALL SELECT * FROM n6 UNION ALL SELECT * FROM n7),
ht AS (SELECT pair_id, arg_min(array_to_string(p, '>'), (len(p), p)) AS path, min(len(p)) - 1 AS length FROM al WHERE p[-1] = b GROUP BY 1)
SELECT pair_id, path IS NOT NULL AS found, length, path FROM pr LEFT JOIN ht USING (pair_id)""", "v_both"),
    "graph_overview": W.sql(""", tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_document_id ORDER BY confidence DESC, id) AS n FROM v_entities) WHERE n <= 5 ORDER BY confidence DESC, id LIMIT 150),
ed AS (SELECT target_id AS id, count(*) AS n_edges FROM v_edges WHERE source_id IN (SELECT id FROM tp) AND target_id IN (SELECT id FROM tp) GROUP BY 1) SELECT id, source_document_id, n_edges FROM tp LEFT JOIN ed USING (id)""", "v_entities", "v_edges"),
    "document_vectors": "WITH c AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS pos FROM embeddings), m AS (SELECT label, pos, avg(x) AS x FROM c GROUP BY 1, 2) SELECT label AS document_id, round(any_value(CASE WHEN pos = 0 THEN x END), 6) AS x0, round(sum(x), 6) AS total, count(*) AS dims FROM m GROUP BY 1",
    "wrong_dims": "SELECT CAST(count_if(len(embedding) <> 64) AS BIGINT) AS n_wrong FROM embeddings",
    "folder_overlap": W.sql(_GRAPH + " SELECT doc_id, folder, round(graph, 6) AS graph FROM gs", "v_terms"),
    "placement_top3": W.sql(_PAIRS + _SCORE.format(pairs="pr", gate="0.1"), "v_terms"),
    "placement_fallback": W.sql(_PAIRS + ", pf AS (SELECT doc_id, folder, CAST(0 AS DOUBLE) AS graph, CASE WHEN rerank > 0.0185 THEN rerank ELSE rerank / 4 END AS rerank FROM pr WHERE doc_id % 4 <> 0 OR folder < 'src1')" + _SCORE.format(pairs="pf", gate="0.1"), "v_terms"),
    "recommendations": W.sql(_PAIRS + ", rc AS (" + _SCORE.format(pairs="pr", gate="0.1").replace(", s1 AS", "WITH s1 AS", 1) + ") SELECT CASE WHEN doc_id IN (SELECT doc_id FROM rc) THEN 'pending' ELSE 'dismissed' END AS status, count(*) AS n FROM documents GROUP BY 1", "v_terms"),
    "audit_moves": W.sql(_PAIRS + _AUDIT, "v_terms"),
    "pair_distances": W.sql(_DIST + "SELECT a, b, round(distance, 6) AS distance FROM pd", "v_terms"),
    "cluster_components": W.sql(_DIST + ", nr AS (SELECT a, b FROM pd WHERE distance <= 0.45 UNION SELECT b, a FROM pd WHERE distance <= 0.45), cc(node, c) AS (SELECT DISTINCT a, a FROM nr UNION SELECT b, c FROM cc JOIN nr ON a = node) SELECT node, min(c) AS component FROM cc GROUP BY 1", "v_terms"),
    "cluster_names": W.sql(_DIST + """, nr AS (SELECT a, b FROM pd WHERE distance <= 0.45 UNION SELECT b, a FROM pd WHERE distance <= 0.45), cc(node, c) AS (SELECT DISTINCT a, a FROM nr UNION SELECT b, c FROM cc JOIN nr ON a = node), cm AS (SELECT node, min(c) AS cluster FROM cc GROUP BY 1),
tc AS (SELECT cluster, term, count(DISTINCT doc_id) AS n FROM cm JOIN v_terms ON doc_id = node GROUP BY 1, 2), tr AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, term) AS r FROM tc),
nm AS (SELECT cluster, string_agg(upper(term[1:1]) || term[2:], ' ' ORDER BY r) AS s FROM tr WHERE r <= 3 GROUP BY 1) SELECT cluster, CASE WHEN length(s) <= 60 THEN s ELSE regexp_extract(s[1:60], '^(.+) [^ ]*$', 1) END AS proposed_folder_name FROM nm""", "v_terms"),
    "document_terms": W.sql(""", ow AS (SELECT source_document_id AS doc_id, id, canonical FROM v_entities WHERE source_document_id LIKE 'nation%'), tm AS (SELECT doc_id, canonical AS term FROM ow UNION SELECT ow.doc_id, e.canonical FROM ow JOIN v_both b ON b.id = ow.id JOIN v_entities e ON e.id = b.nxt
  UNION SELECT 'nation_' || n_nationkey, unnest(['travel', 'plan', 'nation', 'travel plan', 'plan nation']) FROM nation) SELECT doc_id, count(*) AS n_terms, CAST(count_if(term IN ('travel', 'plan', 'travel plan')) AS BIGINT) AS n_words FROM tm GROUP BY 1""", "v_entities", "v_both"),
    "folder_terms": W.sql(", fo AS (SELECT doc_id, unnest(['/ws', workspace_path, workspace_path || '/' || lang]) AS folder FROM v_docs), ta AS (SELECT folder, term FROM fo JOIN v_terms USING (doc_id) UNION SELECT folder, string_split(folder, '/')[-1] FROM fo WHERE length(string_split(folder, '/')[-1]) > 2) SELECT folder, count(*) AS n_terms FROM ta GROUP BY 1", "v_terms", "v_docs"),
    "path_parts": "SELECT doc_id, 'depot|charging' || CASE WHEN length('v' || doc_id) > 2 THEN '|v' || doc_id ELSE '' END || '|final' AS words, 'depot charging' || CASE WHEN length('v' || doc_id) > 2 THEN '|charging v' || doc_id || '|v' || doc_id || ' final' ELSE '|charging final' END AS bigrams, '.pdf' AS ext, '/ws|/ws/Project_Plan-2024' AS above FROM documents",
}
