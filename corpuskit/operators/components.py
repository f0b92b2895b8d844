"""Connected components of an undirected edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpuskit.plans.scratch import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of an edge; the component is its smallest node.

    Alternating large-star and small-star steps (Kiveris et al. 2014): each round
    is two joins over the edges, the number of edges never grows and a path of n
    nodes takes O(log n) rounds. Self loops and repeated edges are allowed, null
    ends are ignored. A hub's rows are only joined with one row of minima, so a
    skewed node is a join that Spark splits.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "components")
    loops = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull())
    now = scratch.table(loops.select(F.col(src).alias("u"), F.col(dst).alias("v")).distinct(), "e0")
    work, seen = now.where("u <> v"), None
    for i in range(max_rounds):
        work = scratch.table(_small_star(_large_star(work)), f"e{i + 1}")
        state = work.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if i > 1:
            scratch.drop(f"e{i - 1}")
        if (state["n"], state["h"]) == seen:
            break
        seen = (state["n"], state["h"])
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    labels = work.select(F.col("u").alias("node"), F.col("v").alias("component"))
    nodes = now.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return nodes.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
