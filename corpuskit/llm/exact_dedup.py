"""Exact deduplication against a minimal perfect hash of historical digests.

The digests of the rows seen earlier are cut into buckets by their leading bits.
For each bucket a minimal perfect hash is built (levels of bit sets, as in
BBHash): a digest's slot is its rank among the set bits. Slots hold the whole
digest and the locator of the row that stays, so a lookup costs one probe and
one comparison of 32 bytes and never takes a stranger for a member. Incoming
digests that are no members are grouped among themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuskit.llm._text import read, slices, small_batches, texts, tidy
from corpuskit.plans.scratch import Scratch

#: Distinct digests of either side that one bucket holds on average, at most.
BUCKET_KEYS = 40_000
#: Bits per remaining key of a level, and levels before the rest is stored as a list.
GAMMA, LEVELS = 2.0, 24
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, digest binary, n_points)``: SHA-256 of the text without white space; null is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            column = texts(batch)
            raw = column.cast(pa.binary()).to_pylist()
            found = [hashlib.sha256(x.translate(None, WHITE)).digest() for x in raw]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(found, pa.binary()), pc.utf8_length(column).cast(pa.int64())], names=["id", "digest", "n_points"]
            )

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), f"id {kind}, digest binary, n_points long")


def _best(df: DataFrame, key: str = "digest") -> DataFrame:
    """One row per digest: how many rows it has and the row that stays."""
    order = F.struct(F.col("n_points").alias("p"), (-F.col("id")).alias("i"))
    return df.groupBy(key).agg(F.count("*").alias("n"), F.max(order).alias("w")).select(key, "n", F.col("w.p").alias("n_points"), (-F.col("w.i")).alias("id"))


def _seeded(keys: np.ndarray, level: int) -> np.ndarray:
    h = keys + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _keys(digest: np.ndarray) -> np.ndarray:
    """Bytes 8 to 16 of each digest; the first bytes choose the bucket."""
    return np.ascontiguousarray(digest[:, 8:16]).view("<u8").ravel()


class PerfectHash:
    """A minimal perfect hash over the rows of an (n, 32) digest array."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        sizes = [int(x.sum()) for x in levels]
        self.base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.ranks = [np.cumsum(x) - 1 for x in levels]

    @staticmethod
    def build(digest: np.ndarray) -> PerfectHash:
        left, keys, levels = np.arange(len(digest)), _keys(digest), []
        while len(left) and len(levels) < LEVELS:
            m = max(64, int(GAMMA * len(left)))
            at = (_seeded(keys[left], len(levels)) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return PerfectHash(levels, digest[left])

    def slots(self, digest: np.ndarray) -> np.ndarray:
        """The slot of each digest; -1 where no level claims it. Non-members may get any slot."""
        out, todo, keys = np.full(len(digest), -1, np.int64), np.arange(len(digest)), _keys(digest)
        for k, bits in enumerate(self.levels):
            at = (_seeded(keys[todo], k) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[todo[hit]] = self.base[k] + self.ranks[k][at[hit]]
            todo = todo[~hit]
        if len(self.rest):
            place = {bytes(x): i for i, x in enumerate(self.rest)}
            for i in todo:
                out[i] = place.get(bytes(digest[i]), -1 - int(self.base[-1])) + int(self.base[-1])
        return out

    def pack(self) -> dict:
        return {"bits": [np.packbits(x).tobytes() for x in self.levels], "sizes": [len(x) for x in self.levels], "rest": self.rest.tobytes()}

    @staticmethod
    def unpack(bits: list[bytes], sizes: list[int], rest: bytes) -> PerfectHash:
        levels = [np.unpackbits(np.frombuffer(b, np.uint8), count=int(n)).astype(bool) for b, n in zip(bits, sizes)]
        return PerfectHash(levels, np.frombuffer(rest, np.uint8).reshape(-1, 32))


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, 32)


def _bucket(n_buckets: int):
    """The bucket from the digest's first 7 bytes."""
    return F.pmod(F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long"), F.lit(n_buckets)).cast("int")


def _named(df: DataFrame) -> DataFrame:
    """Null ids as 0 and a flag: pandas would turn a column of longs with nulls into doubles."""
    return df.withColumn("named", F.col("id").isNotNull()).withColumn("id", F.coalesce("id", F.lit(0).cast("long")))


INDEX = "bucket int, bits array<binary>, sizes array<int>, rest binary, digests binary, ids binary, named binary, points binary, counts binary"


def build_index(history: DataFrame, n_buckets: int) -> DataFrame:
    """The index of ``(digest, n, n_points, id)`` rows, one row per bucket; slots are arrays in rank order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        digest = _matrix(pdf["digest"])
        ph = PerfectHash.build(digest)
        order = np.argsort(ph.slots(digest))
        take = lambda c: pdf[c].to_numpy(np.int64)[order].astype("<i8").tobytes()
        return pd.DataFrame([{"bucket": pdf["bucket"].iloc[0], **ph.pack(), "digests": digest[order].tobytes(), "ids": take("id"), "named": take("named"), "points": take("n_points"), "counts": take("n")}])

    return _named(history).withColumn("bucket", _bucket(n_buckets)).groupBy("bucket").applyInPandas(run, INDEX)


def lookup(incoming: DataFrame, index: DataFrame, n_buckets: int) -> DataFrame:
    """Distinct incoming digests with the slot's contents; nulls where the digest is no member, which ``h_n`` tells."""

    def run(new: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        out = new[["digest", "n", "n_points", "id", "named"]].copy()
        for c in ("h_n", "h_points", "h_id", "h_named"):
            out[c] = pd.array([None] * len(out), dtype="Int64")
        if len(index) and len(out):
            row = index.iloc[0]
            digest, held = _matrix(out["digest"]), np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
            slot = PerfectHash.unpack(list(row["bits"]), list(row["sizes"]), row["rest"]).slots(digest)
            member = slot >= 0
            member[member] = (held[slot[member]] == digest[member]).all(axis=1)
            for c, name in (("h_n", "counts"), ("h_points", "points"), ("h_id", "ids"), ("h_named", "named")):
                value = np.zeros(len(out), np.int64)
                value[member] = np.frombuffer(row[name], "<i8")[slot[member]]
                out[c] = pd.arrays.IntegerArray(value, ~member)
        return out

    left = _named(incoming).withColumn("bucket", _bucket(n_buckets)).groupBy("bucket")
    found = left.cogroup(index.groupBy("bucket")).applyInPandas(run, "digest binary, n long, n_points long, id long, named boolean, h_n long, h_points long, h_id long, h_named long")
    return found.withColumn("id", F.when(F.col("named"), F.col("id"))).withColumn("h_id", F.when(F.col("h_named") == 1, F.col("h_id"))).drop("named", "h_named")


def exact_dedup(history: DataFrame, incoming: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """Groups of texts that are equal without ``[\\x20\\x09-\\x0D]``, over both tables.

    Returns one row per input row: ``id_col, keep_id, group_size, kept,
    text_sha256``. The row with the most code points stays, then the smallest
    id, null ids last. Null texts are empty texts; two empty texts are equal. Ids
    must be unique longs over both tables or null, and a comparison with a null
    id makes ``kept`` null; an empty table gives no rows; other columns are not
    read. A group of any size is only counted by partial aggregation
    and joined, never gathered.
    """
    spark = history.sparkSession
    scratch = Scratch(spark, "exact_dedup")
    with small_batches(spark):
        old = scratch.table(digests(history, id_col, text_col), "old")
        new = scratch.table(digests(incoming, id_col, text_col), "new")
    seen = scratch.table(_best(old), "seen")
    arrived = scratch.table(_best(new), "arrived")
    n_buckets = max(1, -(-max(seen.count(), arrived.count()) // bucket_keys))
    index = scratch.table(build_index(seen, n_buckets), "index")
    found = scratch.table(lookup(arrived, index, n_buckets), "found")
    rows = lambda n, p, i: F.struct(F.col(n).alias("n"), F.col(p).alias("n_points"), F.col(i).alias("id"))
    members = found.where("h_n is not null").select("digest", F.explode(F.array(rows("n", "n_points", "id"), rows("h_n", "h_points", "h_id"))).alias("r"))
    alone = found.where("h_n is null").select("digest", rows("n", "n_points", "id").alias("r"))
    quiet = seen.join(found.where("h_n is not null").select("digest"), "digest", "left_anti").select("digest", rows("n", "n_points", "id").alias("r"))
    merged = members.union(alone).union(quiet).select("digest", "r.*")
    order = F.struct(F.col("n_points").alias("p"), (-F.col("id")).alias("i"))
    winner = scratch.table(merged.groupBy("digest").agg(F.sum("n").alias("group_size"), F.max(order).alias("w")).select("digest", "group_size", (-F.col("w.i")).alias("keep_id")), "winner")
    return old.union(new).join(winner, "digest").select(
        F.col("id").alias(id_col), "keep_id", "group_size", (F.col("id") == F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def history_and_incoming(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The table as two loads: ids up to the middle of their range came first; rows without an id arrive."""
    ends = docs.agg(F.min(id_col).alias("a"), F.max(id_col).alias("b")).first()
    if ends["a"] is None:
        return docs, docs.limit(0)
    middle = (ends["a"] + ends["b"]) // 2
    return docs.where(F.col(id_col) <= middle), docs.where((F.col(id_col) > middle) | F.col(id_col).isNull())


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: the older half of the id range is the history, the rest arrives."""
    return exact_dedup(*history_and_incoming(read(spark, sf_dir, "documents").select("doc_id", "text")))


OP8_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS p,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY p DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY p DESC, doc_id) AS kept,
       text_sha256
FROM t
"""
