"""Near-duplicate vectors by spherical-cap filters.

Filter directions are the products of two random codes, one per half of the
coordinates. A vector belongs to every direction with which its scalar product
exceeds a threshold; list decoding finds them without trying all products. Two
vectors at a high cosine share filters with high probability; vectors that
share one are compared in double precision.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuskit.llm._text import groups, read
from corpuskit.operators.components import connected_components
from corpuskit.plans.scratch import Scratch

#: Filters that a vector exceeds on average, and that it has at least (its best ones) before these are fitted to ``RECALL``.
MEAN_FILTERS, LEAST_FILTERS = 16, 8
#: Share of pairs just at the cosine that are to share a filter, on ``DRAWN`` random pairs.
RECALL, DRAWN = 0.98, 400
#: Vectors of unrelated directions that one filter holds on average.
PER_FILTER = 1.0
#: Rows of one block of a filter; larger filters are compared block by block.
BLOCK = 384
SEED = 20_160


def parameters(n: int) -> tuple[int, float]:
    """Codewords per half and the threshold, in standard deviations, for ``n`` vectors."""
    cap = min(0.02, PER_FILTER / max(n, 1))
    return max(8, math.ceil(math.sqrt(MEAN_FILTERS / cap))), NormalDist().inv_cdf(1 - cap)


def code(dim: int, words: int, half: int) -> np.ndarray:
    """Random unit codewords of one half of ``dim`` coordinates."""
    size = dim - dim // 2 if half else max(1, dim // 2)
    rows = np.random.default_rng([SEED, dim, half]).standard_normal((words, size))
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


@functools.lru_cache(maxsize=64)
def least_filters(words: int, level: float, dim: int, cosine: float) -> int:
    """How many of its best filters each vector needs, so that pairs at ``cosine`` share one with ``RECALL``.

    Measured on random pairs at just that cosine with the very codes: more
    vectors mean sharper filters, which such pairs share less often, so the
    number grows with the table. Closer pairs are found more often.
    """
    rng = np.random.default_rng([SEED, dim, words])
    one, other = rng.standard_normal((2, DRAWN, dim))
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    other -= (other * one).sum(axis=1, keepdims=True) * one
    other /= np.maximum(np.linalg.norm(other, axis=1, keepdims=True), 1e-300)
    other = cosine * one + math.sqrt(max(0.0, 1 - cosine * cosine)) * other
    other /= np.linalg.norm(other, axis=1, keepdims=True)  # of one dimension there are no such pairs
    codes, least = (code(dim, words, 0), code(dim, words, 1)), LEAST_FILTERS
    while True:
        a, b = (list_decode(v, codes, level * math.sqrt(2 / dim), least) for v in (one, other))
        if np.mean([len(np.intersect1d(x, y)) > 0 for x, y in zip(a, b)]) >= RECALL or least >= words * words:
            return least
        least = -(-least * 5 // 4)


def list_decode(unit: np.ndarray, codes: tuple[np.ndarray, np.ndarray], threshold: float, least: int = LEAST_FILTERS) -> list[np.ndarray]:
    """For each unit vector the numbers of all directions above the threshold, and at least its ``least`` best ones."""
    words, cut = len(codes[0]), max(1, unit.shape[1] // 2)
    left, right = unit[:, :cut] @ codes[0].T, unit[:, unit.shape[1] - codes[1].shape[1] :] @ codes[1].T
    order_l, order_r = np.argsort(-left, axis=1), np.argsort(-right, axis=1)
    out = []
    for a, b, i, j in zip(left, right, order_l, order_r):
        la, rb = a[i], b[j]
        top = min(words, least)
        best = np.sort((la[:top, None] + rb[None, :top]).ravel())
        level = min(threshold, best[-least] if len(best) >= least else best[0])
        p, q = np.searchsorted(-la, rb[0] - level, side="right"), np.searchsorted(-rb, la[0] - level, side="right")
        x, y = np.nonzero(la[:p, None] + rb[None, :q] >= level)
        out.append(np.sort(i[x] * words + j[y]))
    return out


def _rows(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def filters(vectors: DataFrame, words: int, level: float, cosine: float) -> DataFrame:
    """``(rep, dim, filters)``: the decoded filters of each distinct vector."""
    schema = pa.schema([("rep", pa.int64()), ("dim", pa.int32()), ("filters", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = {}
        for whole in batches:
            dims = whole.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = whole.filter(pa.array(dims == dim))
                if dim not in codes:
                    codes[dim] = (code(dim, words, 0), code(dim, words, 1))
                for a in range(0, part.num_rows, 500):
                    batch = part.slice(a, 500)
                    v = _rows(batch, "v")
                    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
                    found = list_decode(unit, codes[dim], level * math.sqrt(2 / dim), least_filters(words, level, dim, cosine))
                    yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("dim"), pa.array(found, pa.list_(pa.int64()))], schema=schema)

    return vectors.select("rep", "dim", "v").mapInArrow(run, "rep long, dim int, filters array<long>")


def _compare(ids: np.ndarray, mult: np.ndarray, v: np.ndarray, lists: list[np.ndarray], side: np.ndarray, here: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of one block pair that no smaller common filter has: summed multiplicities, and a local component each."""
    n = len(ids)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = unit @ unit.T >= cosine
    near[np.arange(n), np.arange(n)] = False
    if side.any() and not side.all():
        near &= side[:, None] != side[None, :]
    low = ids.copy()
    while True:
        least = np.where(near, low[None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
        nxt = np.minimum(low, least)
        if (nxt == low).all():
            break
        low = nxt
    earlier = [x[x < here] for x in lists]
    codes, flat = np.unique(np.concatenate(earlier), return_inverse=True)
    if len(codes) and near.any():
        has = np.zeros((n, len(codes)), np.float32)
        has[np.repeat(np.arange(n), [len(x) for x in earlier]), flat] = 1
        near &= has @ has.T == 0
    return near @ mult, low


def near_vectors(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(id_col, n_links, component_id, kept)`` of every row.

    Vectors of equal length link at a cosine of ``cosine`` or more. Null,
    empty and zero vectors and those with null or non-finite components link
    with nothing. Equal vectors are one row of the index and count with their
    number, so ``n_links`` counts rows. Filters grow with the rows: their count
    and threshold follow from the number of distinct vectors. A filter of any
    size is compared in pairs of blocks; a link is counted in the first filter
    that both ends share, and no pairs leave a task. Ids are unique longs; an
    empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "cap_filters")
    held = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(held).alias("v"))
    sound = F.expr("v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)")
    rows = rows.withColumn("ok", F.coalesce(sound, F.lit(False)))
    if held == "array<double>":  # squares of very small and very large entries leave the range of doubles
        square = "aggregate(v, 0D, (a, x) -> a + x * x)"
        rows = rows.withColumn("v", F.expr(f"case when ok and not ({square} between 1e-250 and 1e250) then transform(v, x -> x / array_max(transform(v, y -> abs(y)))) else v end"))
    rows = rows.withColumn("key", F.when(F.col("ok"), F.sha2(F.to_json("v"), 256)))
    keyed = scratch.table(rows.select("id", "key"), "keyed")
    equal = rows.where("ok").groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("m"), F.first("v").alias("v"))
    equal = scratch.table(equal.withColumn("dim", F.size("v")), "distinct")
    words, level = parameters(equal.count())

    decoded = scratch.table(filters(equal, words, level, cosine), "decoded")
    entries = decoded.select("rep", "dim", F.explode("filters").alias("f"))
    sizes = entries.groupBy("dim", "f").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    # Of a vector's filters only those that hold others too, and at each filter those before it, tell where a pair was met.
    shared = scratch.table(entries.select("rep", "dim", "f").join(sizes.select("dim", "f", "blocks"), ["dim", "f"]), "shared")
    listed = shared.groupBy("rep").agg(F.collect_list(F.struct("dim", "f", "blocks")).alias("at"))  # some MEAN_FILTERS entries
    listed = listed.join(equal.select("rep", "m", "v"), "rep").withColumn("filters", F.col("at.f")).select("rep", "m", "v", "filters", F.inline("at"))
    placed = listed.withColumn("filters", F.expr("filter(filters, x -> x < f)"))
    placed = placed.withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumn("b1", F.least("mine", "other")).withColumn("b2", F.greatest("mine", "other"))
    placed = placed.select("dim", "f", "b1", "b2", "mine", "rep", "m", "v", "filters").repartition("dim", "f", "b1", "b2").sortWithinPartitions("dim", "f", "b1", "b2")
    schema = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("low", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in groups(batches, ("dim", "f", "b1", "b2")):
            if batch.num_rows > 1:
                ids, side = batch.column("rep").to_numpy(), batch.column("mine").to_numpy() != batch.column("b1").to_numpy()
                lists = [np.asarray(x, np.int64) for x in batch.column("filters").to_numpy(zero_copy_only=False)]
                links, low = _compare(ids, batch.column("m").to_numpy(), _rows(batch, "v"), lists, side, batch.column("f")[0].as_py(), cosine)
                some = (links > 0) | (low < ids)
                if some.any():
                    out.append((ids[some], links[some], low[some]))
            if len(out) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], schema=schema)

    found = scratch.table(placed.mapInArrow(run, "rep long, links long, low long"), "found")
    degree = found.groupBy("rep").agg(F.sum("links").alias("links"))
    labels = connected_components(found.where("low < rep").select("rep", "low").distinct(), "rep", "low").select(F.col("node").alias("rep"), "component")
    classes = equal.select("key", "rep", "m").join(degree, "rep", "left").join(labels, "rep", "left")
    classes = classes.select("key", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = keyed.join(classes, "key", "left").select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def op6_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings at a cosine of 0.95."""
    return near_vectors(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
