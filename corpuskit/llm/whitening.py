"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation.

The rows of the centred matrix X are the distinct vectors, spread over the
tasks. Each step needs one pass: tasks form their part of u = Xv and add up
Xᵀu, which the driver turns into the next v. Right vectors are as long as one
vector and stay on the driver; a left vector is as long as the table and is
never stored: it is X times a short vector, so tasks form all earlier ones anew
from their own rows, and a lost executor costs only its part of one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuskit.llm._text import read, small_batches
from corpuskit.plans.scratch import Scratch

#: Entries become whole numbers of this part of one.
GRID = 256
#: Residual of a component, relative to the largest deviation, at which it counts as found.
TOLERANCE = 1e-15
#: Rows of one matrix product inside a task.
ROWS = 1000
SEED = 65


@dataclass
class Whitening:
    """A fitted model: ``n`` distinct vectors with sums ``sums``; ``axes`` has a unit column for each of ``values``."""

    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    total: float
    steps: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([float(s) / self.n for s in self.sums])


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id_col, x)``: sound vectors in steps of 1 / ``GRID``; entries beyond the range of longs take its ends."""
    sound = F.expr("v is not null and forall(v, c -> c is not null and not isnan(c) and abs(c) < double('Infinity'))")
    rows = vectors.select(F.col(id_col), F.col(vector_col).cast("array<double>").alias("v")).where(F.coalesce(sound, F.lit(False)))
    return rows.select(id_col, F.expr(f"transform(v, c -> floor({GRID}D * c))").alias("x"))


def _matrices(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Blocks of rows with their vectors, short ones filled up with zeros."""
    for a in range(0, batch.num_rows, ROWS):
        part = batch.slice(a, ROWS)
        lists = part.column("x")
        flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
        if (sizes == dim).all():
            yield part, flat.reshape(-1, dim)
        else:
            x = np.zeros((part.num_rows, dim), np.int64)
            x[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
            yield part, x


def _exact_sums(rows: DataFrame, dim: int) -> list[int]:
    """Sum of each dimension, in whole numbers of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * dim
        for batch in batches:
            for _, x in _matrices(batch, dim):
                low, high = x & 0xFFFFFFFF, x >> 32  # halves of a block of ROWS rows cannot overflow
                total = [t + (int(h) << 32) + int(l) for t, h, l in zip(total, high.sum(axis=0), low.sum(axis=0))]
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([str(t) for t in total], pa.string())], names=["at", "s"])

    part = rows.mapInArrow(run, "at int, s string").groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found = {r["at"]: int(r["s"]) for r in part.collect()}
    return [found.get(i, 0) for i in range(dim)]


def _added(rows: DataFrame, dim: int, mean: np.ndarray, width: int, fn: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all blocks of centred rows of ``fn(block)``, an array of ``width`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            for _, x in _matrices(batch, dim):
                total += fn(x - mean)
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(total)], names=["at", "s"])

    found = rows.mapInArrow(run, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).collect()
    out = np.zeros(width)
    for r in found:
        out[r["at"]] = r["s"]
    return out


def _fresh(rng: np.random.Generator, basis: np.ndarray) -> np.ndarray:
    """A random unit vector at right angles to the columns of ``basis``."""
    v = rng.standard_normal(len(basis))
    for _ in range(2):
        v -= basis @ (basis.T @ v)
    return v / np.linalg.norm(v)


def bidiagonalise(rows: DataFrame, dim: int, mean: np.ndarray, total: float, components: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Largest singular values of the centred rows, their right vectors, and the number of steps.

    Both sides are orthogonalised against all earlier vectors. A step whose
    length vanishes starts anew in a random direction, so repeated values are
    found too. It ends when the wanted triplets have converged and what no right
    vector has met, ``total`` less the squares of the bidiagonal, is too little
    to hide a larger one; after ``dim`` steps the bidiagonal is complete.
    """
    rng = np.random.default_rng(SEED)
    right, left, image = np.zeros((dim, 0)), np.zeros((dim, 0)), np.zeros((dim, 0))  # v, u = X left, X'u
    alpha, beta = np.zeros(0), np.zeros(0)
    v, below = _fresh(rng, right), 0.0
    while True:
        k = len(alpha)
        q = v - below * left[:, -1] if k else v

        def step(x: np.ndarray, q: np.ndarray = q, left: np.ndarray = left) -> np.ndarray:
            w = x @ q
            return np.concatenate([x.T @ w, (x @ left).T @ w, [w @ w]])

        got = _added(rows, dim, mean, dim + k + 1, step)
        xw, c, ww = got[:dim], got[dim:-1], got[-1]
        a = np.sqrt(max(0.0, ww - c @ c))
        small = 1e-14 * np.sqrt(total)
        if a > small:
            p, xu = (q - left @ c) / a, (xw - image @ c) / a
        else:
            a, p, xu = 0.0, np.zeros(dim), np.zeros(dim)
        right, left, image, alpha = np.column_stack([right, v]), np.column_stack([left, p]), np.column_stack([image, xu]), np.append(alpha, a)
        z = xu - a * v
        for _ in range(2):
            z = z - right @ (right.T @ z)
        below = np.linalg.norm(z)
        u, s, wt = np.linalg.svd(np.diag(alpha) + np.diag(beta, 1))
        if k + 1 == dim:
            break
        wanted = min(components, k + 1)
        rest = total - alpha @ alpha - beta @ beta
        settled = (below * np.abs(u[-1, :wanted]) <= TOLERANCE * s[0]).all()
        if k + 1 >= components and settled and rest < s[wanted - 1] ** 2 * (1 - 1e-9):
            break
        if below > small:
            v = z / below
        else:
            v, below = _fresh(rng, right), 0.0
        beta = np.append(beta, below)
    axes = right @ wt.T[:, :components]
    return s[:components], axes / np.linalg.norm(axes, axis=0), k + 1


def fit(rows: DataFrame, components: int = 4) -> tuple[Whitening, float]:
    """The model of a table of distinct vectors ``x``, and how far the whitened ones' covariance is from the identity."""
    n, dim = rows.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    if not n or not dim:
        return Whitening(n, [0] * dim, np.zeros((dim, 0)), np.zeros(0), 0.0, 0), 0.0
    model = Whitening(n, _exact_sums(rows, dim), np.zeros((dim, 0)), np.zeros(0), 0.0, 0)
    mean = model.mean
    total = float(_added(rows, dim, mean, 1, lambda x: np.array([np.sum(x * x)]))[0])
    if total > 0:
        s, axes, model.steps = bidiagonalise(rows, dim, mean, total, min(components, dim))
        held = s**2 > dim * 1e-15 * total  # directions without deviation cannot be scaled to one
        model.axes, model.values, model.total = axes[:, held], s[held] ** 2 / n, total / n
    scaled, many = model.axes / np.sqrt(model.values), len(model.values)
    if not many:
        return model, 0.0
    middle = _added(rows, dim, mean, many, lambda x: (x @ scaled).sum(axis=0)) / n

    def products(x: np.ndarray) -> np.ndarray:
        y = x @ scaled - middle
        return (y.T @ y).ravel()

    apart = _added(rows, dim, mean, many * many, products).reshape(many, many) / n - np.eye(many)
    return model, float(np.abs(apart).max())


def apply(rows: DataFrame, model: Whitening, id_col: str) -> DataFrame:
    """``(id_col, component, deviation, whitened)`` of each row of ``(id_col, x)``; the deviation is exact."""
    dim, n, many = len(model.sums), model.n, len(model.values)
    mean, scaled, sums = model.mean, model.axes / np.sqrt(model.values), model.sums
    kind = rows.schema[id_col].dataType.simpleString()
    most = max((abs(s) for s in sums), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in _matrices(batch, dim):
                reach = n * int(max(x.max(), -x.min())) + most
                if dim * reach * reach < 2**63:
                    away = ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1)
                else:
                    away = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x.tolist()]
                far = pa.array([str(d) for d in away], pa.string())
                back = pa.array(np.repeat(np.arange(part.num_rows), many))
                y = (x - mean) @ scaled
                number = pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), part.num_rows))
                yield pa.RecordBatch.from_arrays([part.column(id_col).take(back), number, far.take(back), pa.array(y.ravel())], names=["id", "component", "deviation", "whitened"])

    found = rows.select(id_col, "x").mapInArrow(run, f"id {kind}, component int, deviation string, whitened double")
    return found.select(F.col("id").alias(id_col), "component", F.expr("try_cast(deviation as decimal(38,0))").alias("deviation"), "whitened")


def whiten(vectors: DataFrame, components: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(id_col, component, n, deviation, whitened, explained, identity_error)`` of each sound row and component.

    Rows whose vector is null or holds null, NaN or infinite entries are left
    out. Equal vectors count once in the fit and each have their rows; ids may
    be null or repeat. Shorter vectors count as if filled up with zeros. There
    are as many components as asked, at most one a dimension, and none for a
    direction in which the vectors don't differ: one vector, or no vectors, give
    no rows. ``deviation`` is decimal, null beyond 38 digits. Other columns are
    not read.
    """
    scratch = Scratch(vectors.sparkSession, "whitening")
    rows = whole_numbers(vectors, id_col, vector_col)
    with small_batches(vectors.sparkSession):
        distinct = scratch.table(rows.select("x").distinct(), "distinct")
        model, error = fit(distinct, components)
    # Every component's share is a driver-side number: a small map column, no join.
    shares = [float(v / model.total) for v in model.values] if model.total else []
    share = F.element_at(F.array(*[F.lit(s) for s in shares]) if shares else F.lit(None).cast("array<double>"), F.col("component"))
    found = apply(rows, model, id_col)
    return found.select(id_col, "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four components of all embeddings; a deviation beyond the range of longs is null."""
    found = whiten(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))
