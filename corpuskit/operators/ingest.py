"""Keeping the tables of documents, chunks and graph current: diffs, upserts, cascades, renames, errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuskit.functions import constants as K
from corpuskit.functions.text import extension, file_name


def diff_snapshot(incoming: DataFrame, documents: DataFrame) -> DataFrame:
    """``(file_path, doc_id, old_hash, new_hash, status)``: new, changed, unchanged, removed, or skipped for empty texts.

    The hash is SHA-256 of the text. ``doc_id`` is the stored one, if any.
    """
    new = incoming.select("file_path", F.sha2("text", 256).alias("new_hash"), (F.trim(F.coalesce("text", F.lit(""))) == "").alias("empty"))
    old = documents.select("file_path", "doc_id", F.col("file_hash").alias("old_hash"))
    status = F.when(F.col("empty").isNull(), "removed").when(F.col("empty"), "skipped").when(F.col("old_hash").isNull(), "new").when(F.col("old_hash") == F.col("new_hash"), "unchanged").otherwise("changed")
    return new.join(old, "file_path", "full_outer").withColumn("status", status).drop("empty")


def upsert_documents(documents: DataFrame, incoming: DataFrame) -> DataFrame:
    """Documents with incoming rows put in by ``file_path``; a known path keeps its id. Both have equal columns."""
    known = documents.select("file_path", F.col("doc_id").alias("old_id"))
    fresh = incoming.join(known, "file_path", "left").withColumn("doc_id", F.coalesce("old_id", "doc_id")).select(*documents.columns)
    return documents.join(incoming.select("file_path"), "file_path", "left_anti").select(*documents.columns).unionByName(fresh)


def replace_children(children: DataFrame, fresh: DataFrame, doc_ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Chunks, postings or vectors with the rows of some documents replaced."""
    return children.join(doc_ids.select(F.col("doc_id").alias(key)), key, "left_anti").select(*children.columns).unionByName(fresh.select(*children.columns))


def delete_documents(doc_ids: DataFrame, tables: dict[str, DataFrame], entities: DataFrame | None = None, edges: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables without the documents. Edges go if either end belonged to one."""
    gone = doc_ids.select("doc_id").distinct()
    out = {name: df.join(gone, "doc_id", "left_anti") for name, df in tables.items()}
    if entities is not None:
        lost = entities.join(gone.withColumnRenamed("doc_id", "source_document_id"), "source_document_id", "left_semi").select("id")
        out["entities"] = entities.join(lost, "id", "left_anti")
        if edges is not None:
            for end in ("source_id", "target_id"):
                edges = edges.join(lost.withColumnRenamed("id", end), end, "left_anti")
            out["edges"] = edges.select("id", "source_id", "target_id", "relationship_type", "confidence") if "id" in edges.columns else edges
    return out


def in_folder(documents: DataFrame, prefix: str) -> DataFrame:
    """Documents whose workspace is a folder or whose path lies below it: what a purge deletes."""
    folder = prefix.rstrip("/")
    return documents.where((F.col("workspace_path") == folder) | F.col("file_path").startswith(folder + "/"))


def rename_paths(documents: DataFrame, moves: DataFrame, workspace: bool = False) -> DataFrame:
    """Documents with paths replaced by ``moves (old, new)``; with ``workspace`` its folder follows the new path."""
    joined = documents.join(moves.select(F.col("old").alias("file_path"), F.col("new").alias("_new")), "file_path", "left")
    if workspace:
        joined = joined.withColumn("workspace_path", F.when(F.col("_new").isNotNull(), F.regexp_replace("_new", "/[^/]*$", "")).otherwise(F.col("workspace_path")))
    return joined.withColumn("file_path", F.coalesce("_new", "file_path")).select(*documents.columns)


def latest_errors(errors: DataFrame, documents: DataFrame, limit: int = 500) -> DataFrame:
    """The last error of each file that is still not indexed, newest first."""
    last = Window.partitionBy("file_path").orderBy(F.desc("failed_at"), F.desc("id"))
    live = errors.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    return live.join(documents.select("file_path"), "file_path", "left_anti").orderBy(F.desc("failed_at"), "id").limit(limit)


def index_summary(diff: DataFrame, errors: int | Column = 0) -> DataFrame:
    """Found, indexed, skipped and failed files of one run, and its status."""
    got = diff.agg(F.count_if(F.col("status") != "removed").alias("found"), F.count_if(F.col("status").isin("new", "changed")).alias("indexed"), F.count_if(F.col("status").isin("unchanged", "skipped")).alias("skipped"))
    return got.withColumn("errors", F.lit(errors).cast("long")).withColumn("status", F.when(F.col("errors") > 0, "completed_with_errors").otherwise("completed"))


def pending_graph_builds(documents: DataFrame, graph_state: DataFrame) -> DataFrame:
    """Documents whose graph was not built from their present text."""
    return documents.join(graph_state.select("doc_id", "file_hash"), ["doc_id", "file_hash"], "left_anti")


def scrub_details(details: Column) -> Column:
    """A map with the values of sensitive keys replaced."""
    return F.transform_values(details, lambda k, v: F.when(F.lower(k).rlike("|".join(K.SENSITIVE_KEYS)), F.lit("<redacted>")).otherwise(v))


def audit_event(rows: DataFrame, event_type: str, details: Column, actor: str = "system") -> DataFrame:
    """Rows for the audit log, to be appended."""
    return rows.select(F.uuid().alias("id"), F.lit(event_type).alias("event_type"), F.lit(actor).alias("actor"), scrub_details(details).alias("details"), F.current_timestamp().alias("created_at"))


def recent_events(events: DataFrame, limit: int = 100) -> DataFrame:
    """The newest events, at most 1000."""
    return events.orderBy(F.desc("created_at"), F.desc("id")).limit(min(limit, 1000))


def profile_listing(listing: DataFrame, root: str) -> dict[str, DataFrame]:
    """Profile of a listing ``(file_path, modified_at)``: per top folder, extensions, and names that look like versions of one.

    ``folders``: files, depth, last change, top four extensions, download-like
    and project-like. ``extensions``: the 20 most frequent. ``versions``: stems
    that several names share without version marks.
    """
    rel = F.substring(F.col("file_path"), len(root.rstrip("/")) + 2, 1 << 30)
    parts = F.split(rel, "/")
    rows = listing.withColumn("folder", F.when(F.size(parts) > 1, parts[0]).otherwise(F.lit("."))).withColumn("depth", F.size(parts)).withColumn("ext", extension(F.col("file_path")))
    by_ext = rows.groupBy("folder", "ext").agg(F.count("*").alias("n"))
    best = Window.partitionBy("folder").orderBy(F.desc("n"), "ext")
    top = by_ext.withColumn("r", F.row_number().over(best)).where("r <= 4").groupBy("folder").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "ext"))), lambda s: s["ext"]).alias("top_extensions"))
    office = F.count_if(F.col("ext").isin(".pdf", ".docx", ".xlsx", ".pptx"))
    folders = rows.groupBy("folder").agg(F.count("*").alias("files"), F.max("depth").cast("long").alias("max_depth"), F.max("modified_at").alias("last_modified"), office.alias("office"))
    folders = folders.withColumn("download_like", F.lower("folder").rlike("download|temp|inbox")).withColumn("project_like", F.col("office") >= 5)
    stem = F.regexp_replace(F.lower(F.regexp_replace(file_name(F.col("file_path")), r"\.[^.]+$", "")), r"[_\-\s]*(\(\d+\)|v\d+(\.\d+)*|final|draft|copy|rev\d*|\d{4}-\d{2}-\d{2})(?=$|[_\-\s])", "")
    versions = rows.groupBy("folder", stem.alias("stem")).agg(F.count("*").alias("names")).where("names > 1")
    extensions = rows.groupBy("ext").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ext").limit(20)
    return {"folders": folders.join(top, "folder", "left"), "extensions": extensions, "versions": versions}


def purge_orphans(documents: DataFrame, watched: DataFrame) -> DataFrame:
    """Documents whose workspace no watched folder covers: an equi-join on each folder above it."""
    from corpuskit.functions.text import ancestors

    above = documents.select("doc_id", F.explode(ancestors(F.col("workspace_path"), itself=True)).alias("path"))
    covered = above.join(watched.select("path").distinct(), "path", "left_semi").select("doc_id").distinct()
    return documents.join(covered, "doc_id", "left_anti")
