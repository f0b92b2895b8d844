"""Query rewriting and abbreviations found in documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuskit.functions import constants as K, text as T


def process_queries(queries: DataFrame, expansions: DataFrame | None = None, to_nfc: bool = True) -> DataFrame:
    """Adds normalised, tokens, filtered, expanded, intent, has_typo and search_text to ``(query_id, query)``.

    ``expansions`` has (abbreviation, definitions), for tokens that the fixed
    table doesn't know. New terms come in the order of their tokens, no term twice.
    """
    q = queries.withColumn("normalised", T.normalise_query(F.col("query"), to_nfc)).withColumn("tokens", T.tokenise(F.col("normalised")))
    q = q.withColumn("filtered", T.remove_stop_words(F.col("tokens"))).withColumn("expanded", T.static_expansions(F.col("filtered")))
    if expansions is not None:
        asked = q.select("query_id", "filtered", F.posexplode("filtered").alias("pos", "abbreviation")).where(~F.col("abbreviation").isin(list(K.EXPANSIONS)))
        told = asked.join(expansions, "abbreviation").select("query_id", "filtered", "pos", F.posexplode("definitions").alias("at", "term"))
        static = q.select("query_id", "filtered", F.posexplode("filtered").alias("pos", "t")).select("query_id", "filtered", "pos", F.posexplode(T.static_expansions(F.array("t"))).alias("at", "term"))
        every = told.unionByName(static).where(~F.array_contains("filtered", F.col("term")))
        first = every.groupBy("query_id", "term").agg(F.min(F.struct("pos", "at")).alias("p"))
        both = first.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "term"))), lambda s: s["term"]).alias("found"))
        q = q.join(both, "query_id", "left").withColumn("expanded", F.coalesce("found", F.array().cast("array<string>"))).drop("found")
    q = q.withColumn("intent", T.detect_intent(F.col("tokens"))).withColumn("has_typo", T.has_typo_candidate(F.col("tokens")))
    joined = F.array_join(F.concat("filtered", "expanded"), " ")
    return q.withColumn("search_text", F.when(joined == "", F.col("normalised")).otherwise(joined))


def _initials(definition: Column) -> Column:
    words = F.transform(F.split(F.trim(definition), r"\s+"), lambda w: F.regexp_replace(w, r"^[(),.\-;:]+|[(),.\-;:]+$", ""))
    kept = F.filter(words, lambda w: (w != "") & ~F.lower(w).isin(K.INITIAL_STOP_WORDS))
    return F.array_join(F.transform(kept, lambda w: F.upper(F.substring(w, 1, 1))), "")


def extract_abbreviations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, abbreviation, definition)``: bracketed definitions whose initials spell the abbreviation.

    Abbreviations of the fixed table are left out. The first of a document wins,
    an abbreviation before its definition before the other way round.
    """

    def scan(pattern: str, abbreviation: int, definition: int, order: int) -> DataFrame:
        groups = [F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(g)) for g in (abbreviation, definition)]
        pairs = docs.select(id_col, F.posexplode(F.arrays_zip(groups[0].alias("a"), groups[1].alias("d"))).alias("pos", "p"))
        return pairs.select(id_col, F.lit(order).alias("scan"), "pos", F.col("p.a").alias("a"), F.trim("p.d").alias("definition"))

    found = scan(K.ABBREVIATION_FIRST, 1, 2, 0).unionByName(scan(K.DEFINITION_FIRST, 2, 1, 1))
    found = found.where(~F.lower("a").isin(list(K.EXPANSIONS)) & (_initials(F.col("definition")) == F.upper("a")))
    first = F.row_number().over(Window.partitionBy(id_col, "abbreviation").orderBy("scan", "pos"))
    found = found.withColumn("abbreviation", F.lower("a")).withColumn("n", first).where("n = 1")
    return found.select(id_col, "abbreviation", "definition")


def abbreviation_expansions(abbreviations: DataFrame) -> DataFrame:
    """``(abbreviation, definitions)`` over all documents, definitions sorted."""
    return abbreviations.select("abbreviation", "definition").distinct().groupBy("abbreviation").agg(F.sort_array(F.collect_list("definition")).alias("definitions"))
