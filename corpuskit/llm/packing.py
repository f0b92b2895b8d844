"""Packing of documents into windows by best-fit decreasing.

Pieces of equal length are alike to best-fit, so the packing is decided on the
histogram of lengths, which has at most as many rows as a window has tokens,
whatever the corpus. Its plan says which ranks of each length go to which
windows at which offset; tasks then look their pieces up in it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from corpuskit.llm._text import read, small_batches, tidy
from corpuskit.llm.tokens import coded, default_tokenizer
from corpuskit.plans.scratch import Scratch

WINDOW = 1024
END_ID = 0
#: Pieces that one sort group of a length holds on average when ranks are dealt.
RANK_GROUP = 1000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut(docs: DataFrame, tokenizer: str, window: int, id_col: str = "doc_id", text_col: str = "text", **memory: int) -> DataFrame:
    """The documents' ids with the end id, cut into full windows and a rest; one row per piece. ``memory`` goes to the encoder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in coded(batches, tokenizer, **memory):
            ids, start = texts.expand(END_ID)
            raw = memoryview(ids.astype("<u4").tobytes())
            total = np.diff(start)
            n = -(-total // window)
            row = np.repeat(np.arange(len(total)), n)
            at = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * window
            size = np.minimum(window, total[row] - at)
            lo = (start[:-1][row] + at) * 4
            crc = [zlib.crc32(raw[a : a + 4 * k]) for a, k in zip(lo.tolist(), size.tolist())]
            columns = [batch.column("doc_id").take(pa.array(row)), pa.array(at, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64()), pa.array(total[row], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), PIECES)


class CapacityTree:
    """A segment tree over remaining capacities 0 to n: which of them have open windows."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.any = [False] * (2 * self.size)

    def set(self, capacity: int, value: bool) -> None:
        i = capacity + self.size
        self.any[i] = value
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, least: int) -> int:
        """The smallest capacity from ``least`` on with an open window, or -1."""
        i = least + self.size
        if self.any[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                break
            i //= 2
        else:
            return -1
        while i < self.size:
            i = 2 * i if self.any[2 * i] else 2 * i + 1
        return i - self.size


def best_fit_decreasing(histogram: dict[int, int], window: int) -> list[tuple[int, int, int, int, int]]:
    """The plan ``(length, first rank, first window, offset, pieces per window)``.

    A row holds until the next one of its length. A window that is the tightest
    stays so while it has room for another piece of the length, so it takes as
    many as fit. Runs of windows with equal contents are kept together: the
    steps depend on the number of different lengths, not of pieces.
    """
    open_runs: list[list[tuple[int, int]]] = [[] for _ in range(window + 1)]
    tree, plan, windows = CapacityTree(window), [], 0

    def put(capacity: int, first: int, count: int) -> None:
        if capacity and count:
            open_runs[capacity].append((first, count))
            tree.set(capacity, True)

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            capacity = tree.tightest(length)
            if capacity < 0:
                capacity, first = window, windows
                per = min(left, capacity // length)
                count = used = left // per
                windows += used
            else:
                first, count = open_runs[capacity].pop()
                per = min(left, capacity // length)
                used = min(count, left // per)
                put(capacity, first + used, count - used)
                if not open_runs[capacity]:
                    tree.set(capacity, False)
            plan.append((length, rank, first, window - capacity, per))
            put(capacity - per * length, first, used)
            rank, left = rank + used * per, left - used * per
    return plan


def place(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces of at most ``window`` tokens.

    Ranks within a length are dealt in hashed sort groups of bounded size, so a
    length that a third of all pieces share is spread like any other.
    """
    counts = {x["length"]: x["n"] for x in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = best_fit_decreasing(counts, window)
    groups = max(1, sum(counts.values()) // RANK_GROUP)
    dealt = pieces.withColumn("g", F.pmod(F.xxhash64("doc_id", "start"), F.lit(groups)))
    before = lambda *c: Window.partitionBy(*c[:-1]).orderBy(c[-1]).rowsBetween(Window.unboundedPreceding, -1)
    # Sums over ranges of groups first, so that no window runs over all groups of a common length.
    sizes = dealt.groupBy("length", "g").agg(F.count("*").alias("n")).withColumn("range", F.floor(F.sqrt("g")))
    wide = sizes.groupBy("length", "range").agg(F.sum("n").alias("n")).select("length", "range", F.coalesce(F.sum("n").over(before("length", "range")), F.lit(0)).alias("wide"))
    offsets = sizes.withColumn("inner", F.coalesce(F.sum("n").over(before("length", "range", "g")), F.lit(0))).join(wide, ["length", "range"])
    offsets = offsets.select("length", "g", (F.col("wide") + F.col("inner")).alias("base"))
    ranked = dealt.withColumn("r", F.row_number().over(Window.partitionBy("length", "g").orderBy("doc_id", "start", "ids_crc32")) - 1)
    ranked = ranked.join(offsets, ["length", "g"]).withColumn("rank", F.col("base") + F.col("r")).drop("g", "r", "base")
    shift = 1 << 44
    key = np.array([p[0] * shift + p[1] for p in plan], np.int64)
    order = np.argsort(key)
    key, first, offset, per = key[order], *(np.array([p[i] for p in plan], np.int64)[order] for i in (2, 3, 4))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            mine = length * shift + batch.column("rank").to_numpy()
            at = np.searchsorted(key, mine, side="right") - 1
            names = [c for c in batch.schema.names if c != "rank"]
            columns = [batch.column(c) for c in names] + [pa.array(first[at] + (mine - key[at]) // per[at]), pa.array(offset[at] + (mine - key[at]) % per[at] * length)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"{c} {t}" for c, t in ranked.dtypes if c != "rank")
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", **memory: int) -> DataFrame:
    """Packs all documents; one row per piece.

    Columns: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset``. A null text is empty and has the end id alone; repeated rows are
    packed each; an empty table gives no rows; other columns are not read.
    ``memory`` may lower the encoder's ``slice_bytes`` and ``remembered`` words,
    for workers that have less of it; that costs time.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    with small_batches(docs.sparkSession):
        pieces = scratch.table(cut(docs, tokenizer or default_tokenizer(), window, id_col, text_col, **memory), "pieces")
    return place(pieces, window).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 ids."""
    return pack(read(spark, sf_dir, "documents").select("doc_id", "text"))
