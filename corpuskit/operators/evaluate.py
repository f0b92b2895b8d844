"""Grading of results against answer keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpuskit.operators.clusters import average_linkage, block_linkage


def score_placement(truth: DataFrame, recommendations: DataFrame) -> DataFrame:
    """``(filename, category, points)``: 0 to 2 points for the folders of each file.

    ``truth`` has (filename, category, expected array), ``recommendations``
    (filename, folders array, best first). Unrelated files need no suggestion;
    ambiguous ones take none or a listed folder; else the first counts 2, one of the first three 1.
    """
    rows = truth.join(recommendations, "filename", "left").withColumn("folders", F.slice(F.coalesce("folders", F.array().cast("array<string>")), 1, 3))
    none, hit = F.size("folders") == 0, F.arrays_overlap("folders", F.coalesce("expected", F.array().cast("array<string>")))
    first = F.array_contains("expected", F.try_element_at("folders", F.lit(1)))
    points = F.when(F.col("category") == "unrelated", F.when(none, 2).otherwise(0)).when(F.col("category") == "ambiguous", F.when(none | hit, 2).otherwise(0)).when(first, 2).when(hit, 1).otherwise(0)
    return rows.select("filename", "category", F.coalesce(points, F.lit(0)).cast("long").alias("points"))


def score_audit(truth: DataFrame, moves: DataFrame) -> DataFrame:
    """``(filename, points)``: ``truth`` has (filename, correct_folder, expect_flagged), ``moves`` (filename, folder)."""
    rows = truth.join(moves, "filename", "left")
    flagged = F.col("folder").isNotNull()
    points = F.when(F.col("expect_flagged"), F.when(flagged & (F.col("folder") == F.col("correct_folder")), 2).when(flagged, 1).otherwise(0)).otherwise(F.when(flagged, 0).otherwise(2))
    return rows.select("filename", points.cast("long").alias("points"))


def scorecard(scored: DataFrame, full: int = 2) -> DataFrame:
    """Points and the most there are, by category and in total (null category)."""
    return scored.rollup("category").agg(F.sum("points").alias("points"), (F.count("*") * full).alias("most"))


def calibration_grid(scenarios: DataFrame, expected: DataFrame, thresholds: list[float], points: DataFrame | None = None) -> DataFrame:
    """``(scenario, threshold, passed)``: whether average linkage finds the expected numbers of clusters and members.

    ``scenarios`` has (scenario, a, b, distance), ``expected`` (scenario, clusters, members).
    With ``points`` (scenario, id, block), a and b are blocks of them, ``a = b`` too.
    """
    out = None
    for t in thresholds:
        linked = average_linkage(scenarios, t, group=["scenario"]) if points is None else block_linkage(points, scenarios, t, group=["scenario"])
        got = linked.groupBy("scenario").agg(F.countDistinct("cluster").alias("c"), F.count("*").alias("m"))
        one = expected.join(got, "scenario", "left").select("scenario", F.lit(t).alias("threshold"), ((F.coalesce("c", F.lit(0)) == F.col("clusters")) & (F.coalesce("m", F.lit(0)) == F.col("members"))).alias("passed"))
        out = one if out is None else out.unionByName(one)
    return out


def validate_truth(truth: DataFrame, least: DataFrame) -> DataFrame:
    """``(problem, subject)``: faults of an answer key.

    ``truth`` has (filename, project, category, scope, candidates array,
    counterpart), ``least`` (project, documents): too few documents of a
    project, duplicates without counterpart, ambiguous rows with one candidate.
    """
    few = least.join(truth.groupBy("project").agg(F.count("*").alias("n")), "project", "left").where(F.coalesce("n", F.lit(0)) < F.col("documents")).select(F.lit("too few documents").alias("problem"), F.col("project").alias("subject"))
    twins = truth.where("category = 'duplicate'").join(truth.select(F.col("filename").alias("counterpart")), "counterpart", "left_anti").select(F.lit("no counterpart").alias("problem"), F.col("filename").alias("subject"))
    vague = truth.where((F.col("category") == "ambiguous") & (F.coalesce(F.size("candidates"), F.lit(0)) < 2)).select(F.lit("one candidate").alias("problem"), F.col("filename").alias("subject"))
    return few.union(twins).union(vague)


def truth_counts(truth: DataFrame) -> DataFrame:
    return truth.groupBy("scope", "category").agg(F.count("*").alias("n"))
