"""Names that hold a text, by an index of their trigrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuskit.plans.scratch import Scratch

#: Characters of a gram; shorter texts are looked up among grams of their own length.
GRAM = 3


def _grams(text: Column, n: int) -> Column:
    """The distinct runs of ``n`` characters of a text; the empty text is a run of none."""
    if n == 0:
        return F.array(F.lit(""))
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def substring_pairs(names: DataFrame, texts: DataFrame, name_col: str, text_col: str) -> DataFrame:
    """``(name_col, text_col)``: all pairs of a distinct name and a distinct text that it holds, as they are written.

    A text of three characters or more is looked up by that of its trigrams
    which the fewest names have, and compared with these names. A shorter text is
    a gram itself: the names that have it are its matches. Only grams that are
    asked for are kept of the names, so names never meet texts with which they
    have nothing in common; nulls match nothing, the empty text every name.
    """
    scratch = Scratch(names.sparkSession, "substrings")
    asked = texts.select(F.col(text_col).alias("t")).where("t is not null").distinct()
    asked = scratch.table(asked.withColumn("n", F.least(F.length("t"), F.lit(GRAM))), "asked")
    lengths = sorted(r["n"] for r in asked.select("n").distinct().collect())  # 0 to GRAM
    own = names.select(F.col(name_col).alias("name")).where("name is not null").distinct()
    if not lengths:
        return own.select(F.col("name").alias(name_col), F.col("name").alias(text_col)).limit(0)
    grams = F.flatten(F.array(*[F.when(F.col("n") == n, _grams(F.col("t"), n)).otherwise(F.array().cast("array<string>")) for n in lengths]))
    wanted = scratch.table(asked.select("t", F.explode(grams).alias("g")), "wanted")
    held = own.select("name", F.explode(F.flatten(F.array(*[_grams(F.col("name"), n) for n in lengths]))).alias("g"))
    held = scratch.table(held.join(wanted.select("g").distinct(), "g", "left_semi"), "held")
    sizes = held.groupBy("g").agg(F.count("*").alias("size"))
    sized = wanted.join(sizes, "g", "left")  # a gram that no name has: its text has no match
    best = sized.groupBy("t").agg(F.min(F.struct(F.coalesce("size", F.lit(0)).alias("size"), F.col("g"))).alias("x")).where("x.size > 0").select("t", F.col("x.g").alias("g"))
    met = held.join(best, "g").where(F.col("name").contains(F.col("t")))
    return met.select(F.col("name").alias(name_col), F.col("t").alias(text_col))


def name_hits(entities: DataFrame, queries: DataFrame, key: str = "query_id") -> DataFrame:
    """Entities joined with the queries ``(key, q, …)`` whose lower-case text ``q`` their name holds in any case."""
    named = entities.withColumn("_low", F.lower("name"))
    pairs = substring_pairs(named, queries, "_low", "q")
    asked = queries.join(pairs, "q")
    return named.join(asked, "_low").drop("_low")
