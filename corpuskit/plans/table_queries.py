"""Queries over the tables around documents: snapshots, listings, conversations, events, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskit.operators import clusters as C, conversations as H, documents as B, evaluate as J, ingest as A
from corpuskit.plans import views as W
from corpuskit.streaming import events as I
from corpuskit.streaming.lifetimes import lifetimes


def _incoming(spark, d):
    """The documents as a later scan finds them: some gone, some changed, some new, some blank."""
    docs = W.documents(spark, d)
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" changed"))).when(F.col("doc_id") % 11 == 0, F.lit(" ")).otherwise(F.col("text"))
    path = F.when(F.col("doc_id") % 13 == 0, F.concat("file_path", F.lit(".new.txt"))).otherwise(F.col("file_path"))
    return docs.where("doc_id % 5 <> 4").withColumn("text", text).withColumn("file_path", path).withColumn("doc_id", F.col("doc_id") + 1_000_000_000).withColumn("file_hash", F.sha2("text", 256))


_INCOMING = """, inc AS (SELECT doc_id + 1000000000 AS doc_id, CASE WHEN doc_id % 7 = 0 THEN text || ' changed' WHEN doc_id % 11 = 0 THEN ' ' ELSE text END AS text, lang, source, n_chars,
  CASE WHEN doc_id % 13 = 0 THEN file_path || '.new.txt' ELSE file_path END AS file_path, workspace_path FROM v_docs WHERE doc_id % 5 <> 4)
, dif AS (SELECT coalesce(i.file_path, o.file_path) AS file_path, o.doc_id, o.file_hash AS old_hash, sha256(i.text) AS new_hash,
  CASE WHEN i.file_path IS NULL THEN 'removed' WHEN trim(i.text) = '' THEN 'skipped' WHEN o.file_hash IS NULL THEN 'new' WHEN o.file_hash = sha256(i.text) THEN 'unchanged' ELSE 'changed' END AS status
  FROM inc i FULL JOIN v_docs o ON i.file_path = o.file_path)
"""


def snapshot_diff(spark, d):
    return A.diff_snapshot(_incoming(spark, d), W.documents(spark, d))


def index_summary(spark, d):
    return A.index_summary(snapshot_diff(spark, d))


def upsert_documents(spark, d):
    return A.upsert_documents(W.documents(spark, d), _incoming(spark, d)).select("doc_id", "file_path", "file_hash")


def pending_graph_builds(spark, d):
    docs = A.upsert_documents(W.documents(spark, d), _incoming(spark, d))
    return A.pending_graph_builds(docs, W.documents(spark, d)).select("doc_id", "file_path")


def rename_paths(spark, d):
    docs = W.documents(spark, d)
    moves = docs.where("lang = 'fr'").select(F.col("file_path").alias("old"), F.replace("file_path", F.lit("/fr/"), F.lit("/français/")).alias("new"))
    return A.rename_paths(docs, moves, workspace=True).select("doc_id", "file_path", "workspace_path")


def delete_cascade(spark, d):
    docs = W.documents(spark, d)
    gone = A.in_folder(docs, "/ws/src3").select("doc_id")
    left = A.delete_documents(gone, {"documents": docs, "chunks": W.cut_documents(spark, d)})
    n = left["chunks"].groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    return left["documents"].select("doc_id", "workspace_path").join(n, "doc_id", "left")


def delete_graph(spark, d):
    """Edges after the documents of some nations are deleted."""
    gone = W.table(spark, d, "nation").where("n_nationkey % 4 = 0").select(F.concat(F.lit("nation_"), F.col("n_nationkey").cast("string")).alias("doc_id"))
    return A.delete_documents(gone, {}, W.entities(spark, d), W.edges(spark, d))["edges"].groupBy("target_id", "relationship_type").agg(F.count("*").alias("n"))


def _errors(spark, d):
    """Events of type error as indexing errors: the user is the file."""
    ev = W.table(spark, d, "events").where("event_type = 'error'")
    return ev.select(F.col("event_id").alias("id"), F.concat(F.lit("/ws/u"), F.col("user_id").cast("string")).alias("file_path"), F.col("props").alias("error_message"), F.col("ts").alias("failed_at"))


def _indexed(spark, d):
    return W.table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.concat(F.lit("/ws/u"), F.col("c_custkey").cast("string")).alias("file_path"))


def latest_errors(spark, d):
    return A.latest_errors(_errors(spark, d), _indexed(spark, d), 500).select("id", "file_path", "error_message")


_ERRORS = """WITH er AS (SELECT event_id AS id, '/ws/u' || user_id AS file_path, props AS error_message, ts AS failed_at FROM events WHERE event_type = 'error'),
ok AS (SELECT '/ws/u' || c_custkey AS file_path FROM customer WHERE c_custkey % 3 = 0) """


def dashboard_stats(spark, d):
    errors = _errors(spark, d).join(_indexed(spark, d), "file_path", "left_anti")
    return H.dashboard_stats(W.documents(spark, d), W.cut_documents(spark, d), errors)


def recent_files(spark, d):
    ev = W.table(spark, d, "events").select(F.col("ts").alias("indexed_at"), F.col("event_id").alias("doc_id"), "user_id")
    return H.recent_files(ev).select("doc_id", "user_id")


def list_documents(spark, d):
    ev = W.table(spark, d, "events").select(F.col("ts").alias("indexed_at"), F.col("event_id").alias("doc_id"))
    return B.list_documents(ev, 25, 50).select("doc_id")


def list_by_workspace(spark, d):
    return B.list_by_workspace(B.exclude_system(W.documents(spark, d), ["/WS\\src1/FR"]), "/ws/src1").select("doc_id", "file_path")


def scrub_details(spark, d):
    """Event properties as audit details, with a sensitive key."""
    ev = W.table(spark, d, "events").where("event_type = 'signup'")
    details = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("API_Key_id"), F.col("props"))
    clean = ev.select("event_id", A.scrub_details(details).alias("m"))
    return clean.select("event_id", F.col("m")["user"].alias("user"), F.col("m")["API_Key_id"].alias("key"))


def recent_events(spark, d):
    ev = W.table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), "event_type")
    return A.recent_events(ev, 200).select("id", "event_type")


def listing_profile(spark, d):
    listing = W.documents(spark, d).select("file_path", F.lit(None).cast("timestamp").alias("modified_at"))
    folders = A.profile_listing(listing, "/ws")["folders"]
    return folders.select("folder", "files", "max_depth", F.array_join("top_extensions", ",").alias("top_extensions"), "download_like", "project_like")


def purge_orphans(spark, d):
    watched = W.table(spark, d, "region").select(F.concat(F.lit("/ws/src"), F.col("r_regionkey").cast("string")).alias("path"))
    return A.purge_orphans(W.documents(spark, d), watched).groupBy("workspace_path").agg(F.count("*").alias("n"))


def _paths(spark, d):
    """Documents in folders of all kinds."""
    k = F.col("doc_id")
    folder = F.when(k % 10 == 0, "/ws/Downloads").when(k % 10 == 1, "/ws/a/node_modules").when(k % 10 == 2, "/etc/x").when(k % 10 == 3, F.concat(F.lit("/ws/"), "source")).when(k % 10 == 4, F.concat(F.lit("/ws/"), "source", F.lit("/misc"))).otherwise(F.concat(F.lit("/ws/"), "source", F.lit("/"), "lang"))
    name = F.when(k % 7 == 0, F.concat(F.lit("My_Family-"), k.cast("string"))).when(k % 7 == 1, F.concat(F.lit("~$lock"), k.cast("string"))).otherwise(F.concat(F.lit("doc_"), k.cast("string")))
    return W.table(spark, d, "documents").select("doc_id", F.concat(folder, F.lit("/"), name, F.lit(".txt")).alias("file_path"), F.concat(F.lit("/ws/"), "source").alias("workspace_path"), F.sha2("text", 256).alias("file_hash"))


_PATHS = """WITH pa AS (SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN '/ws/Downloads' WHEN 1 THEN '/ws/a/node_modules' WHEN 2 THEN '/etc/x' WHEN 3 THEN '/ws/' || source WHEN 4 THEN '/ws/' || source || '/misc' ELSE '/ws/' || source || '/' || lang END AS folder,
  CASE doc_id % 7 WHEN 0 THEN 'My_Family-' || doc_id WHEN 1 THEN '~$lock' || doc_id ELSE 'doc_' || doc_id END || '.txt' AS name, '/ws/' || source AS root FROM documents),
el AS (SELECT *, folder || '/' || name AS file_path FROM pa WHERE doc_id % 10 > 2 AND doc_id % 7 > 1),
kf AS (SELECT folder, count(*) AS n FROM el GROUP BY 1 ORDER BY n DESC, folder LIMIT 150)
"""


_FLOATING = """, lf AS (SELECT folder FROM kf a WHERE NOT EXISTS (SELECT 1 FROM kf b WHERE starts_with(b.folder, a.folder || '/'))),
fd AS (SELECT doc_id, file_path FROM el WHERE folder IN (SELECT root FROM el) OR folder NOT IN (SELECT folder FROM lf) OR folder LIKE '%/misc')"""


def eligible_documents(spark, d):
    return B.eligible_documents(_paths(spark, d)).select("doc_id", "file_path")


def known_folders(spark, d):
    return B.known_folders(B.eligible_documents(_paths(spark, d)))


def floating_documents(spark, d):
    docs = B.eligible_documents(_paths(spark, d))
    return B.floating_documents(docs, docs.select(F.col("workspace_path").alias("path")), B.known_folders(docs).select(F.col("folder").alias("path"))).select("doc_id", "file_path")


def incremental_audit(spark, d):
    done = _paths(spark, d).where("doc_id % 3 = 0").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("file_hash")).otherwise("old").alias("file_hash"))
    return B.incremental_audit_set(B.eligible_documents(_paths(spark, d)), done).select("doc_id")


def conversation_list(spark, d):
    said = W.table(spark, d, "conversations")
    heads = said.select("conv_id").distinct().withColumn("created_at", F.col("conv_id") % 17)
    return H.list_conversations(heads, said.where("role <> 'system'")).select("conv_id", "n_messages")


def turn_counts(spark, d):
    return H.turn_counts(W.table(spark, d, "conversations")).select("conv_id", "turns")


def transcripts(spark, d):
    return H.summary_due(W.table(spark, d, "conversations"), every_n=2, oldest_n=4)


def messages_upserted(spark, d):
    said = W.table(spark, d, "conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "conv_id", "role", F.col("text").alias("content"), F.lit("streaming").alias("status"), F.col("turn").alias("created_at"), F.lit(1).alias("seq"))
    later = said.where("conv_id % 2 = 0").withColumn("content", F.concat(F.lit("now "), "content")).withColumn("status", F.lit("complete")).withColumn("created_at", F.col("created_at") + 100).withColumn("seq", F.lit(2))
    return H.upsert_messages(said, later).select("id", "content", "status", "created_at")


def debounced_events(spark, d):
    return I.debounce(W.file_events(spark, d), "30 minutes").select("path", F.date_format("first", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("first"), F.date_format("last", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last"), "n_events", "is_new")


def file_actions(spark, d):
    """All events as routed file events, renames leading on to other users' files."""
    ev = W.table(spark, d, "events")
    path = F.concat(F.lit("/ws/"), F.col("user_id").cast("string"), F.lit(".txt"))
    to = F.concat(F.lit("/ws/"), ((F.col("user_id") * 7 + F.col("event_id")) % 150).cast("string"), F.lit(".txt"))
    moved = F.col("event_type") == "view"
    action = F.when(moved, "rename").when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "error", "delete").otherwise("modify")
    return ev.select(F.col("event_id").alias("ts"), F.when(moved, to).otherwise(path).alias("path"), F.when(moved, path).alias("old_path"), action.alias("action"))


def file_lifetimes(spark, d):
    """All events as one batch: what becomes of each file."""
    found = lifetimes(file_actions(spark, d))
    return found.select(F.col("start").alias("start_path"), F.col("born_at.ts").alias("born_id"), "born_path", "touched", F.col("path").alias("end_path"), "ended")


def routed_events(spark, d):
    """Events as file events: logins move files in, out of and within the watched folder."""
    ev, user = W.table(spark, d, "events"), F.col("user_id").cast("string")
    kind = F.when(F.col("event_type") == "signup", "created").when(F.col("event_type") == "error", "deleted").when(F.col("event_type") == "view", "moved").otherwise("modified")
    path = F.concat(F.when(F.col("event_id") % 5 == 0, "/out/").otherwise("/ws/"), user, F.when(F.col("event_id") % 7 == 0, ".tmp").otherwise(".txt"))
    dest = F.when(kind == "moved", F.concat(F.when(F.col("event_id") % 3 == 0, "/out/").otherwise("/ws/new/"), user, F.lit(".txt")))
    rows = ev.select("event_id", F.col("event_id").alias("ts"), kind.alias("event_type"), path.alias("path"), dest.alias("dest_path"))
    watched = W.table(spark, d, "region").where("r_regionkey = 0").select(F.lit("/ws/").alias("path"))
    return I.route_events(rows, watched).select(F.col("ts").alias("event_id"), "path", "old_path", "action")


def affinity_ema(spark, d):
    ev = W.table(spark, d, "events").select(F.col("user_id").cast("string").alias("entity"), F.col("event_type").alias("folder"), F.col("event_id").alias("seq"), F.when(F.col("value") > 50, 1.0).otherwise(0.0).alias("signal"))
    start = W.table(spark, d, "customer").where("c_custkey < 20").select(F.col("c_custkey").cast("string").alias("entity"), F.lit("view").alias("folder"), F.lit(0.5).alias("weight"), F.lit(3).cast("long").alias("observations"))
    return C.update_affinity(start, ev).select("entity", "folder", F.round("weight", 6).alias("weight"), "observations")


def _truth(spark, d):
    p = W.table(spark, d, "part")
    kind = F.when(F.col("p_partkey") % 4 == 0, "unrelated").when(F.col("p_partkey") % 4 == 1, "ambiguous").otherwise("obvious")
    return p.select(F.col("p_partkey").alias("filename"), kind.alias("category"), F.array("p_brand").alias("expected"))


def _suggested(spark, d):
    one = W.table(spark, d, "part").select(F.col("p_partkey").alias("filename"), F.array_distinct(F.array("p_brand", F.concat(F.lit("Brand#"), (F.col("p_size") % 25).cast("string")))).alias("f"), "p_size")
    return one.where("p_size % 3 <> 0").select("filename", F.when(F.col("p_size") % 2 == 0, F.reverse("f")).otherwise(F.col("f")).alias("folders"))


def placement_points(spark, d):
    return J.score_placement(_truth(spark, d), _suggested(spark, d))


def placement_scorecard(spark, d):
    return J.scorecard(placement_points(spark, d))


_POINTS = """WITH tr AS (SELECT p_partkey AS filename, CASE p_partkey % 4 WHEN 0 THEN 'unrelated' WHEN 1 THEN 'ambiguous' ELSE 'obvious' END AS category, p_brand AS want,
  CASE WHEN p_size % 3 = 0 THEN [] WHEN p_brand = 'Brand#' || (p_size % 25) THEN [p_brand] WHEN p_size % 2 = 0 THEN ['Brand#' || (p_size % 25), p_brand] ELSE [p_brand, 'Brand#' || (p_size % 25)] END AS f FROM part),
pt AS (SELECT filename, category, CAST(CASE WHEN category = 'unrelated' THEN CASE WHEN len(f) = 0 THEN 2 ELSE 0 END WHEN category = 'ambiguous' THEN CASE WHEN len(f) = 0 OR list_contains(f, want) THEN 2 ELSE 0 END
  WHEN f[1] = want THEN 2 WHEN list_contains(f, want) THEN 1 ELSE 0 END AS BIGINT) AS points FROM tr) """


def audit_points(spark, d):
    p = W.table(spark, d, "part")
    truth = p.select(F.col("p_partkey").alias("filename"), F.col("p_brand").alias("correct_folder"), (F.col("p_size") % 2 == 0).alias("expect_flagged"))
    moves = p.where("p_size % 3 = 0").select(F.col("p_partkey").alias("filename"), F.concat(F.lit("Brand#"), (F.col("p_size") % 25).cast("string")).alias("folder"))
    return J.score_audit(truth, moves)


def truth_checks(spark, d):
    p = W.table(spark, d, "part")
    truth = p.select(F.col("p_name").alias("filename"), F.col("p_brand").alias("project"), F.when(F.col("p_size") % 3 == 0, "duplicate").otherwise("ambiguous").alias("category"), F.col("p_type").alias("scope"), F.when(F.col("p_size") % 2 == 0, F.array("p_brand")).otherwise(F.array("p_brand", "p_type")).alias("candidates"), F.concat("p_name", F.when(F.col("p_size") % 5 == 0, "?").otherwise("")).alias("counterpart"))
    least = p.select(F.col("p_brand").alias("project")).distinct().withColumn("documents", F.lit(80))
    return J.validate_truth(truth, least).groupBy("problem", "subject").agg(F.count("*").alias("n"))


def target_names(spark, d):
    """Files of few names that move into folders where some names and numbers are taken."""
    p = W.table(spark, d, "part")
    name = F.concat(F.lit("report v1."), (F.col("p_size") % 5).cast("string"))
    moves = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("doc_id"), F.col("p_brand").alias("folder"), F.concat(name, F.lit(".txt")).alias("name"))
    number = F.when(F.col("p_partkey") % 3 > 0, F.concat(F.lit(" ("), (F.col("p_partkey") % 7).cast("string"), F.lit(")"))).otherwise("")
    taken = p.where("p_partkey % 2 = 1 and p_size < 30").select(F.col("p_brand").alias("folder"), F.concat(name, number, F.lit(".txt")).alias("name"))
    return C.dedupe_target_names(moves, taken).select("doc_id", "folder", "target_name")


QUERIES = {
    f.__name__: f
    for f in (
        snapshot_diff, index_summary, upsert_documents, pending_graph_builds, rename_paths, delete_cascade, delete_graph, latest_errors, dashboard_stats, recent_files, list_documents, list_by_workspace, scrub_details, recent_events, listing_profile, purge_orphans,
        eligible_documents, known_folders, floating_documents, incremental_audit, conversation_list, turn_counts, transcripts, messages_upserted, debounced_events, routed_events, file_lifetimes, affinity_ema, placement_points, placement_scorecard, audit_points, truth_checks, target_names,
    )
}

_docs = "v_docs"
ORACLES = {
    "snapshot_diff": W.sql(_INCOMING + "SELECT * FROM dif", _docs),
    "index_summary": W.sql(_INCOMING + "SELECT CAST(count_if(status <> 'removed') AS BIGINT) AS found, CAST(count_if(status IN ('new', 'changed')) AS BIGINT) AS indexed, CAST(count_if(status IN ('unchanged', 'skipped')) AS BIGINT) AS skipped, CAST(0 AS BIGINT) AS errors, 'completed' AS status FROM dif", _docs),
    "upsert_documents": W.sql(_INCOMING + "SELECT coalesce(o.doc_id, i.doc_id) AS doc_id, i.file_path, sha256(i.text) AS file_hash FROM inc i LEFT JOIN v_docs o USING (file_path) UNION ALL SELECT doc_id, file_path, file_hash FROM v_docs WHERE file_path NOT IN (SELECT file_path FROM inc)", _docs),
    "pending_graph_builds": W.sql(_INCOMING + "SELECT coalesce(o.doc_id, i.doc_id) AS doc_id, i.file_path FROM inc i LEFT JOIN v_docs o USING (file_path) WHERE o.file_hash IS DISTINCT FROM sha256(i.text)", _docs),
    "rename_paths": W.sql(" SELECT doc_id, replace(file_path, '/fr/', '/français/') AS file_path, CASE WHEN lang = 'fr' THEN workspace_path || '/français' ELSE workspace_path END AS workspace_path FROM v_docs", _docs),
    "delete_cascade": W.sql(" SELECT d.doc_id, workspace_path, n_chunks FROM v_docs d LEFT JOIN (SELECT doc_id, count(*) AS n_chunks FROM v_chunks GROUP BY 1) USING (doc_id) WHERE source <> 'src3'", _docs, "v_chunks"),
    "delete_graph": W.sql(", gone AS (SELECT id FROM v_entities WHERE source_document_id IN (SELECT 'nation_' || n_nationkey FROM nation WHERE n_nationkey % 4 = 0)) SELECT target_id, relationship_type, count(*) AS n FROM v_edges WHERE source_id NOT IN (SELECT id FROM gone) AND target_id NOT IN (SELECT id FROM gone) GROUP BY ALL", "v_entities", "v_edges"),
    "latest_errors": _ERRORS + "SELECT id, file_path, error_message FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY failed_at DESC, id DESC) AS n FROM er) WHERE n = 1 AND file_path NOT IN (SELECT file_path FROM ok) ORDER BY failed_at DESC, id LIMIT 500",
    "dashboard_stats": W.sql(" SELECT (SELECT count(*) FROM documents) AS documents, (SELECT CAST(sum(n_chars) AS BIGINT) FROM documents) AS characters, (SELECT count(*) FROM v_chunks) AS chunks, (SELECT count(DISTINCT user_id) FROM events WHERE event_type = 'error' AND user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)) AS live_errors", "v_chunks"),
    "file_lifetimes": """WITH RECURSIVE ev AS (
    SELECT event_id AS ts, event_type AS kind, '/ws/' || CASE WHEN event_type = 'view' THEN (user_id * 7 + event_id) % 150 ELSE user_id END || '.txt' AS path,
        CASE WHEN event_type = 'view' THEN '/ws/' || user_id || '.txt' END AS old
    FROM events
),
marks AS (
    SELECT path, ts, CASE kind WHEN 'error' THEN 'end' WHEN 'view' THEN 'arrive' ELSE 'touch' END AS k, old FROM ev WHERE old IS NULL OR old <> path
    UNION ALL SELECT old, ts, 'leave', NULL FROM ev WHERE old <> path
),
numbered AS (SELECT *, sum(CASE WHEN k = 'touch' THEN 0 ELSE 1 END) OVER (PARTITION BY path ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM marks),
held AS (
    SELECT path, n, max(bk) AS bk, max(bts) AS bts, max(bold) AS bold, min(touch) AS touch, max(ek) AS ek, max(ets) AS ets FROM (
        SELECT path, n, CASE WHEN k <> 'touch' THEN k END AS bk, CASE WHEN k <> 'touch' THEN ts END AS bts, old AS bold, CASE WHEN k = 'touch' THEN ts END AS touch, NULL AS ek, NULL AS ets FROM numbered
        UNION ALL SELECT path, n - 1, NULL, NULL, NULL, NULL, k, ts FROM numbered WHERE k <> 'touch'
    ) GROUP BY path, n
),
walk AS (
    SELECT path AS hp, n AS hn, path, n FROM held WHERE bk IS NULL OR bk <> 'arrive'
    UNION ALL SELECT hp, hn, t.path, t.n FROM walk w JOIN held s ON s.path = w.path AND s.n = w.n AND s.ek = 'leave' JOIN held t ON t.bk = 'arrive' AND t.bts = s.ets AND t.bold = s.path
),
parts AS (SELECT hp, hn, held.*, least(touch, CASE WHEN bk = 'arrive' THEN bts END) AS birth FROM walk JOIN held USING (path, n))
SELECT CASE WHEN hn = 0 THEN hp END AS start_path, min(birth) AS born_id, arg_min(path, birth) FILTER (birth IS NOT NULL) AS born_path, bool_or(touch IS NOT NULL) AS touched,
    max(path) FILTER (ek IS NULL OR ek <> 'leave') AS end_path, bool_or(ek IS NOT NULL) FILTER (ek IS NULL OR ek <> 'leave') AS ended
FROM parts GROUP BY hp, hn HAVING hn = 0 OR min(birth) IS NOT NULL""",
    "recent_files": "SELECT event_id AS doc_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 5",
    "list_documents": "SELECT event_id AS doc_id FROM events ORDER BY ts DESC, event_id LIMIT 25 OFFSET 50",
    "list_by_workspace": W.sql(" SELECT doc_id, file_path FROM v_docs WHERE source = 'src1' AND lang <> 'fr'", _docs),
    "scrub_details": "SELECT event_id, CAST(user_id AS VARCHAR) AS \"user\", '<redacted>' AS \"key\" FROM events WHERE event_type = 'signup'",
    "recent_events": "SELECT event_id AS id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 200",
    "listing_profile": "SELECT source AS folder, count(*) AS files, CAST(3 AS BIGINT) AS max_depth, '.txt' AS top_extensions, false AS download_like, false AS project_like FROM documents GROUP BY 1",
    "purge_orphans": W.sql(" SELECT workspace_path, count(*) AS n FROM v_docs WHERE source NOT IN (SELECT 'src' || r_regionkey FROM region) GROUP BY 1", _docs),
    "eligible_documents": _PATHS + "SELECT doc_id, file_path FROM el",
    "known_folders": _PATHS + "SELECT folder, n FROM kf a WHERE NOT EXISTS (SELECT 1 FROM kf b WHERE starts_with(b.folder, a.folder || '/'))",
    "floating_documents": _PATHS + _FLOATING + " SELECT * FROM fd",
    "incremental_audit": _PATHS + "SELECT doc_id FROM el WHERE NOT (doc_id % 3 = 0 AND doc_id % 2 = 0)",
    "conversation_list": "SELECT conv_id, CAST(count_if(role <> 'system') AS BIGINT) AS n_messages FROM conversations GROUP BY 1",
    "turn_counts": "SELECT conv_id, CAST(count_if(role = 'assistant') AS BIGINT) AS turns FROM conversations GROUP BY 1",
    "transcripts": """WITH du AS (SELECT conv_id, CAST(count_if(role = 'assistant') AS BIGINT) AS turns FROM conversations GROUP BY 1 HAVING turns > 0 AND turns % 2 = 0),
ol AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role IN ('user', 'assistant'))
SELECT conv_id, turns, string_agg(upper(role) || ': ' || text, chr(10) ORDER BY n) AS transcript FROM ol JOIN du USING (conv_id) WHERE n <= 4 GROUP BY 1, 2""",
    "messages_upserted": "SELECT conv_id || ':' || turn AS id, CASE WHEN conv_id % 2 = 0 THEN 'now ' || text ELSE text END AS content, CASE WHEN conv_id % 2 = 0 THEN 'complete' ELSE 'streaming' END AS status, turn AS created_at FROM conversations",
    "debounced_events": """WITH g AS (SELECT user_id AS path, ts, event_type = 'signup' AS c, CASE WHEN ts - lag(ts) OVER w > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(b) OVER (PARTITION BY path ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT path, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last, count(*) AS n_events, bool_or(c) AS is_new FROM s GROUP BY path, k""",
    "routed_events": """WITH e AS (SELECT event_id, CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted' WHEN 'view' THEN 'moved' ELSE 'modified' END AS t,
  CASE WHEN event_id % 5 = 0 THEN '/out/' ELSE '/ws/' END || user_id || CASE WHEN event_id % 7 = 0 THEN '.tmp' ELSE '.txt' END AS p, CASE WHEN event_id % 3 = 0 THEN '/out/' ELSE '/ws/new/' END || user_id || '.txt' AS q FROM events),
r AS (SELECT *, event_id % 5 <> 0 AND event_id % 7 <> 0 AS ok, event_id % 3 <> 0 AS dok FROM e),
a AS (SELECT *, CASE WHEN t = 'moved' AND ok AND dok THEN 'rename' WHEN t = 'moved' AND dok THEN 'create' WHEN t = 'moved' AND ok THEN 'delete' WHEN t <> 'moved' AND ok THEN CASE t WHEN 'deleted' THEN 'delete' WHEN 'created' THEN 'create' ELSE 'modify' END END AS action FROM r)
SELECT event_id, CASE WHEN t = 'moved' AND action <> 'delete' THEN q ELSE p END AS path, CASE WHEN action = 'rename' THEN p END AS old_path, action FROM a WHERE action IS NOT NULL""",
    "affinity_ema": """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS entity, event_type AS folder, CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END AS s, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) - 1 AS age FROM events),
g AS (SELECT entity, folder, sum(CAST(0.2 AS DOUBLE) * pow(0.8, age) * s) AS gain, count(*) AS n FROM e GROUP BY 1, 2), a AS (SELECT CAST(c_custkey AS VARCHAR) AS entity, 'view' AS folder, CAST(0.5 AS DOUBLE) AS w FROM customer WHERE c_custkey < 20)
SELECT entity, folder, round(coalesce(gain, 0) + pow(0.8, coalesce(n, 0)) * coalesce(w, 1.0), 6) AS weight, coalesce(n, 0) + CASE WHEN w IS NULL THEN 0 ELSE 3 END AS observations FROM g FULL JOIN a USING (entity, folder)""",
    "placement_points": _POINTS + "SELECT * FROM pt",
    "placement_scorecard": _POINTS + "SELECT category, CAST(sum(points) AS BIGINT) AS points, count(*) * 2 AS most FROM pt GROUP BY ROLLUP (category)",
    "audit_points": """SELECT p_partkey AS filename, CAST(CASE WHEN p_size % 2 = 0 THEN CASE WHEN p_size % 3 = 0 AND 'Brand#' || (p_size % 25) = p_brand THEN 2 WHEN p_size % 3 = 0 THEN 1 ELSE 0 END ELSE CASE WHEN p_size % 3 = 0 THEN 0 ELSE 2 END END AS BIGINT) AS points FROM part""",
    "truth_checks": """WITH x AS (SELECT 'too few documents' AS problem, p_brand AS subject FROM part GROUP BY 2 HAVING count(*) < 80 UNION ALL SELECT 'no counterpart', p_name FROM part WHERE p_size % 3 = 0 AND p_size % 5 = 0 UNION ALL SELECT 'one candidate', p_name FROM part WHERE p_size % 3 <> 0 AND p_size % 2 = 0)
SELECT problem, subject, count(*) AS n FROM x GROUP BY ALL""",
    "target_names": """WITH t AS (SELECT DISTINCT p_brand AS folder, 'report v1.' || (p_size % 5) AS name, CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 7 END AS k FROM part WHERE p_partkey % 2 = 1 AND p_size < 30),
l AS (SELECT folder, name, coalesce(list(k) FILTER (k IS NOT NULL), []) AS ks, count(*) FILTER (k IS NULL) AS held FROM t GROUP BY 1, 2),
m AS (SELECT p_partkey AS doc_id, p_brand AS folder, 'report v1.' || (p_size % 5) AS name, row_number() OVER (PARTITION BY p_brand, p_size % 5 ORDER BY p_partkey) - 1 AS r FROM part WHERE p_partkey % 2 = 0)
SELECT doc_id, folder, CASE WHEN r + coalesce(held, 0) = 0 THEN name || '.txt' ELSE name || ' (' || list_filter(range(1, 100000), lambda x: NOT list_contains(coalesce(ks, []), x))[r + coalesce(held, 0)] || ').txt' END AS target_name FROM m LEFT JOIN l USING (folder, name)""",
}
