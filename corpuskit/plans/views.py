"""The driver's tables seen as documents, queries, a graph, terms and file events: in Spark, and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuskit.operators.chunks import chunk_text
from corpuskit.plans.scratch import TEXTS_AT_ONCE, Scratch


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def documents(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("/ws/"), "source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars", path.alias("file_path"), F.concat(F.lit("/ws/"), "source").alias("workspace_path"), F.sha2("text", 256).alias("file_hash"))


def cut_documents(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with ids ``document:index``."""
    cut = chunk_text(table(spark, d, "documents"))
    return cut.withColumn("chunk_id", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """The chunks as a written table, for queries that read them more than once."""
    return Scratch(spark, "chunks").table(cut_documents(spark, d), "chunks", batch=TEXTS_AT_ONCE)


def queries(spark: SparkSession, d: str) -> DataFrame:
    """The first five words of each benchmark text."""
    words = F.slice(F.split("text", r"\s+"), 1, 5)
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(words, " ").alias("query"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("document_id"), "embedding")


def entities(spark: SparkSession, d: str) -> DataFrame:
    """Parts, suppliers, customers, nations and regions as entities."""
    sized = (F.lit(0.5) + (F.col("p_size") % 50) / 100).alias("confidence")
    part = table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.concat_ws(" ", "p_name", (F.col("p_size") % 10).cast("string")).alias("name"), F.lit("Product").alias("entity_type"), F.col("p_brand").alias("source_document_id"), sized)
    one = F.lit(1.0).alias("confidence")

    def rows(name: str, prefix: str, key: str, label: str, kind: str, doc: str) -> DataFrame:
        return table(spark, d, name).select(F.concat(F.lit(prefix), F.col(key).cast("string")), F.col(label), F.lit(kind), F.concat(F.lit(doc), F.col(key).cast("string")) if name == "region" else F.concat(F.lit("nation_"), F.col({"supplier": "s_nationkey", "customer": "c_nationkey", "nation": "n_nationkey"}[name]).cast("string")), one)

    every = part.union(rows("supplier", "s", "s_suppkey", "s_name", "Organization", "")).union(rows("customer", "c", "c_custkey", "c_name", "Person", "")).union(rows("nation", "n", "n_nationkey", "n_name", "Location", "")).union(rows("region", "r", "r_regionkey", "r_name", "Location", "region_"))
    return every.withColumn("canonical", F.lower("name"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers and customers belong to nations, nations to regions."""

    def rows(name: str, a: str, ak: str, b: str, bk: str, kind: str, confidence: float) -> DataFrame:
        return table(spark, d, name).select(F.concat(F.lit(a), F.col(ak).cast("string")).alias("source_id"), F.concat(F.lit(b), F.col(bk).cast("string")).alias("target_id"), F.lit(kind).alias("relationship_type"), F.lit(confidence).alias("confidence"))

    return rows("supplier", "s", "s_suppkey", "n", "s_nationkey", "BELONGS_TO", 0.8).union(rows("customer", "c", "c_custkey", "n", "c_nationkey", "MEMBER_OF", 0.7)).union(rows("nation", "n", "n_nationkey", "r", "n_regionkey", "PART_OF", 1.0))


def term_sets(spark: SparkSession, d: str) -> DataFrame:
    """``(doc_id, source, terms)``: the distinct words of over three characters of each document's whole text."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z]{4,})"), F.lit(1)))
    return table(spark, d, "documents").select("doc_id", "source", words.alias("terms"))


def terms(spark: SparkSession, d: str) -> DataFrame:
    """``(doc_id, source, term)``: a row for each term of :func:`term_sets`."""
    return term_sets(spark, d).select("doc_id", "source", F.explode("terms").alias("term"))


def file_events(spark: SparkSession, d: str) -> DataFrame:
    """``(ts, path, is_create)``: sign-ups create, others modify; the user is the path."""
    return table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("path"), (F.col("event_type") == "signup").alias("is_create"))


# The same views in DuckDB SQL, by name.
_END = """CASE WHEN {st} + 1500 < length(s) AND length(regexp_extract(substr(s, {st} + 1, 1500), '(?s)^(.*[.!?])\\s', 1)) > 200
  THEN {st} + length(regexp_extract(substr(s, {st} + 1, 1500), '(?s)^(.*[.!?])\\s', 1)) ELSE least({st} + 1500, length(s)) END"""
CTES = {
    "v_docs": "SELECT doc_id, text, lang, source, n_chars, '/ws/' || source || '/' || lang || '/doc_' || doc_id || '.txt' AS file_path, '/ws/' || source AS workspace_path, sha256(text) AS file_hash FROM documents",
    "v_cuts(doc_id, s, i, st, en)": f"""SELECT doc_id, s, 0, 0, {_END.format(st="0")} FROM (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS s FROM documents) WHERE s <> ''
  UNION ALL SELECT doc_id, s, i + 1, en - 200, {_END.format(st="(en - 200)")} FROM v_cuts WHERE en < length(s)""",
    "v_chunks": "SELECT doc_id, CAST(i AS BIGINT) AS chunk_index, regexp_replace(substr(s, st + 1, en - st), '^\\s+|\\s+$', '', 'g') AS content, CAST(st AS BIGINT) AS char_start, CAST(en AS BIGINT) AS char_end, doc_id || ':' || i AS chunk_id FROM v_cuts",
    "v_tokens": "SELECT chunk_id, unnest(regexp_extract_all(translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\\x{80}-\\x{10FFFF}]+')) AS term FROM v_chunks",
    "v_postings": "SELECT term, chunk_id, count(*) AS tf FROM v_tokens GROUP BY ALL",
    "v_queries": "SELECT item_id AS query_id, array_to_string(string_split_regex(text, '\\s+')[1:5], ' ') AS query FROM benchmark",
    "v_entities": """SELECT 'p' || p_partkey AS id, p_name || ' ' || (p_size % 10) AS name, 'Product' AS entity_type, p_brand AS source_document_id, CAST(0.5 AS DOUBLE) + (p_size % 50) / 100 AS confidence, lower(p_name || ' ' || (p_size % 10)) AS canonical FROM part
  UNION ALL SELECT 's' || s_suppkey, s_name, 'Organization', 'nation_' || s_nationkey, 1.0, lower(s_name) FROM supplier
  UNION ALL SELECT 'c' || c_custkey, c_name, 'Person', 'nation_' || c_nationkey, 1.0, lower(c_name) FROM customer
  UNION ALL SELECT 'n' || n_nationkey, n_name, 'Location', 'nation_' || n_nationkey, 1.0, lower(n_name) FROM nation
  UNION ALL SELECT 'r' || r_regionkey, r_name, 'Location', 'region_' || r_regionkey, 1.0, lower(r_name) FROM region""",
    "v_edges": """SELECT 's' || s_suppkey AS source_id, 'n' || s_nationkey AS target_id, 'BELONGS_TO' AS relationship_type, CAST(0.8 AS DOUBLE) AS confidence FROM supplier
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'MEMBER_OF', 0.7 FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'PART_OF', 1.0 FROM nation""",
    "v_both": "SELECT source_id AS id, target_id AS nxt FROM v_edges UNION SELECT target_id, source_id FROM v_edges",
    "v_terms": "SELECT DISTINCT doc_id, source, term FROM (SELECT doc_id, source, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents) WHERE length(term) > 3",
}
_NEEDS = {"v_chunks": ["v_cuts"], "v_tokens": ["v_cuts", "v_chunks"], "v_postings": ["v_cuts", "v_chunks", "v_tokens"], "v_both": ["v_edges"]}


def sql(body: str, *views: str) -> str:
    """A DuckDB query over the views it names; ``body`` may begin with further ones, each closed by a comma."""
    names = list(dict.fromkeys(n for v in views for n in [*_NEEDS.get(v, []), v]))
    full = {k.split("(")[0]: (k, q) for k, q in CTES.items()}
    return "WITH RECURSIVE " + ", ".join(f"{full[n][0]} AS ({full[n][1]})" for n in names) + body
