"""Stupid-backoff scores of documents under the n-gram counts of all other documents.

The join of exploded n-grams with their count tables, in blocks: a block of
documents sends its distinct n-grams, cut by hash, to the count table's
partitions; each partition sums the counts of all blocks and answers every
block in the order it asked; a block then adds up its documents' scores. An
n-gram costs eight bytes once per block, however often it occurs, so frequent
n-grams make no hot partition.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuskit.llm._text import gram_hashes, hash_words, read, slices, texts, words
from corpuskit.llm.token_files import decode, encode
from corpuskit.plans.scratch import Scratch

ORDER = 2
#: The factor of each step down to a shorter n-gram.
BACKOFF = 0.4
#: The count of a word that no other document holds.
UNSEEN = 0.5
#: Text bytes of one block, and n-grams that one partition of the count table gets.
BLOCK_BYTES, PARTITION_GRAMS = 8_000_000, 1_000_000


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending 64-bit values as the first one and steps of six bytes, or of eight where one needs them."""
    steps = np.diff(values)
    if len(steps) and int(steps.max()) >= 1 << 48:
        return values.astype("<u8").tobytes()
    low = np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
    return values[:1].astype("<u8").tobytes() + low.tobytes()


def unpack_sorted(raw: bytes, n: int) -> np.ndarray:
    if len(raw) == 8 * n:
        return np.frombuffer(raw, "<u8")
    steps = np.zeros((n, 8), np.uint8)
    steps[0] = np.frombuffer(raw[:8], np.uint8)
    steps[1:, :6] = np.frombuffer(raw[8:], np.uint8).reshape(-1, 6)
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def pack_counts(values: np.ndarray) -> bytes:
    """One byte per count; those from 255 on follow in four."""
    return np.minimum(values, 255).astype(np.uint8).tobytes() + values[values >= 255].astype("<u4").tobytes()


def unpack_counts(raw: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(raw[:n], np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(raw[n:], "<u4")
    return out


def blocks(docs: DataFrame) -> DataFrame:
    """Documents in blocks: word codes into the block's distinct words, of which the hashes are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("control", pa.binary()), ("code", pa.binary()), ("words", pa.binary())])
        for seq, batch in enumerate(slices(batches, limit=BLOCK_BYTES)):
            code, offsets, vocab = words(texts(batch))
            control, data = encode(code)
            row = {"block": part << 32 | seq, "ids": batch.column("id").to_pylist(), "sizes": np.diff(offsets).tolist(), "control": control, "code": data, "words": hash_words(vocab).astype("<u8").tobytes()}
            yield pa.RecordBatch.from_pylist([row], schema)

    return docs.select("id", "text").mapInArrow(run, "block long, ids array<long>, sizes array<long>, control binary, code binary, words binary")


class Block:
    """One block's n-grams: for each order the distinct hashes, and for each word the n-gram that ends there."""

    def __init__(self, row: dict, order: int):
        size = np.asarray(row["sizes"], np.int64)
        hashed = np.frombuffer(row["words"], "<u8")[decode(row["control"], row["code"], int(size.sum()))]
        self.doc = np.repeat(np.arange(len(size)), size)
        self.pos = np.arange(len(self.doc)) - np.repeat(np.cumsum(size) - size, size)
        self.grams, self.at, self.counts = {}, {}, {}
        for k in range(1, order + 1):
            ends = np.flatnonzero(self.pos >= k - 1)
            h = gram_hashes(hashed, k)[ends - (k - 1)] if len(ends) else np.empty(0, np.uint64)
            self.grams[k], inverse, self.counts[k] = np.unique(h, return_inverse=True, return_counts=True)
            at = np.full(len(self.doc), -1, np.int64)
            at[ends] = inverse
            self.at[k] = at

    def own(self, k: int) -> np.ndarray:
        """For each word how often its document holds the n-gram that ends there."""
        key = self.doc * (len(self.grams[k]) + 1) + self.at[k]
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        return count[inverse]

    def scores(self, totals: dict[int, np.ndarray], words_in_all: int, n_docs: int) -> np.ndarray:
        """The sum over each document's words of their log10 scores."""
        doc_words = np.bincount(self.doc, minlength=n_docs)
        count, score = None, None
        for k in sorted(totals):
            there = self.at[k] >= 0
            now = np.zeros(len(self.doc))
            now[there] = totals[k][self.at[k][there]]
            now -= np.where(there, self.own(k), 0)
            if k == 1:
                score = np.log10(np.maximum(now, UNSEEN) / np.maximum(words_in_all - doc_words[self.doc], 1))
            else:
                context = np.concatenate([[0.0], count[:-1]])
                found = there & (now > 0)
                with np.errstate(divide="ignore", invalid="ignore"):
                    score = np.where(found, np.log10(now / context), score + np.where(there, math.log10(BACKOFF), 0.0))
            count = now
        return np.bincount(self.doc, weights=score, minlength=n_docs)


def _shift(parts: int) -> np.uint64:
    return np.uint64(64 - (parts.bit_length() - 1))


def requests(table: DataFrame, order: int, parts: int) -> DataFrame:
    """``(part, k, block, n, grams, counts)``: each block's distinct n-grams by partition of the hash range."""
    schema = pa.schema([("part", pa.int32()), ("k", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                b = Block(row, order)
                for k, grams in b.grams.items():
                    part = (grams >> _shift(parts)).astype(np.int64) if parts > 1 else np.zeros(len(grams), np.int64)
                    cuts = np.searchsorted(part, np.arange(parts + 1))
                    some = [(p, x, y) for p, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])) if y > x]
                    rows = [{"part": p, "k": k, "block": row["block"], "n": y - x, "grams": pack_sorted(grams[x:y]), "counts": pack_counts(b.counts[k][x:y])} for p, x, y in some]
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return table.select("block", "sizes", "control", "code", "words").mapInArrow(run, "part int, k int, block long, n int, grams binary, counts binary")


def answers(asked: DataFrame) -> DataFrame:
    """``(block, k, part, n, totals)``: the counts over all blocks, in the order of each block's n-grams."""

    def run(table: pa.Table) -> pa.Table:
        sizes = table["n"].to_pylist()
        grams = [unpack_sorted(x, n) for x, n in zip(table["grams"].to_pylist(), sizes)]
        _, inverse = np.unique(np.concatenate(grams), return_inverse=True)
        counts = np.concatenate([unpack_counts(x, n) for x, n in zip(table["counts"].to_pylist(), sizes)])
        total = np.bincount(inverse, weights=counts)[inverse].astype(np.int64)
        out = [pack_counts(total[e - n : e]) for n, e in zip(sizes, np.cumsum(sizes))]
        return pa.table({"block": table["block"], "k": table["k"], "part": table["part"], "n": table["n"], "totals": pa.array(out, pa.binary())})

    return asked.groupBy("part", "k").applyInArrow(run, "block long, k int, part int, n int, totals binary")


def score_documents(docs: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_words, log10_score, mean_log10_score)`` of every row.

    Words lie between ASCII white space, A-Z lower-cased. A word's score is the
    relative frequency of the longest n-gram of up to ``order`` words that
    another document holds too, times BACKOFF for each shorter step; counts
    leave out the scored document. Null, empty and blank texts have no words,
    score 0 and mean null; repeated rows count as other documents; other
    columns are not read; an empty table gives no rows. Ids are longs, null or
    not; cast or number others before.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm_scores")
    table = scratch.table(blocks(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))), "blocks", "zstd")
    total = table.select(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).first()["n"] or 0
    parts = 1 << max(0, math.ceil(math.log2(max(1, total / PARTITION_GRAMS))))
    told = answers(requests(table, order, parts))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        b = Block(row, order)
        replies: dict[int, list] = {k: [] for k in range(1, order + 1)}
        for x in right.select(["k", "part", "n", "totals"]).to_pylist():
            replies[x["k"]].append((x["part"], unpack_counts(x["totals"], x["n"])))
        totals = {k: np.concatenate([t for _, t in sorted(v, key=lambda y: y[0])]) if v else np.empty(0, np.int64) for k, v in replies.items()}
        score = b.scores(totals, total, len(row["ids"]))
        return pa.table({"id": pa.array(row["ids"], pa.int64()), "n_words": pa.array(row["sizes"], pa.int64()), "log10_score": score})

    scored = table.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, "id long, n_words long, log10_score double")
    return scored.select(F.col("id").alias(id_col), "n_words", "log10_score", F.when(F.col("n_words") > 0, F.col("log10_score") / F.col("n_words")).alias("mean_log10_score"))


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bigram scores of all documents."""
    return score_documents(read(spark, sf_dir, "documents").select("doc_id", "text"))
