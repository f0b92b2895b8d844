"""Token files: ids ranked by frequency, one to four bytes each, lengths in control bytes of their own.

A set of files is a table of blocks in document order. A block holds the ids of
a run of documents as ranks: two bits per id in the control bytes, the rank's
low bytes in the data bytes. The ids by rank stand in a second table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from corpuskit.llm._text import read, tidy
from corpuskit.llm.tokens import Coded, coded, default_tokenizer
from corpuskit.plans.scratch import Scratch

END_ID = 0
#: Ids that a task encodes or decodes at a time.
STEP = 1_000_000
#: For each control byte the lengths of its four ids.
LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)
_BYTES = np.arange(4, dtype=np.uint8)


def encode(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    r = ranks.astype("<u4")
    extra = (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    padded = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    padded[: len(r)] = extra
    control = (padded.reshape(-1, 4) << (2 * _BYTES)).sum(axis=1, dtype=np.uint8)
    data = r.view(np.uint8).reshape(-1, 4)[_BYTES <= extra[:, None]]
    return control.tobytes(), data.tobytes()


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values of :func:`encode`, by table look-up."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    out = np.zeros((n, 4), np.uint8)
    out[_BYTES < size[:, None]] = np.frombuffer(data, np.uint8)
    return out.view("<u4").ravel()


BLOCKS = "part int, seq int, doc_ids array<long>, sizes array<long>, control array<binary>, data array<binary>"
_STAGED = "part int, seq int, doc_ids array<long>, codes binary, n_codes array<int>, number binary, flat binary, odd array<struct<row:int,ids:binary>>, ids array<long>, uses array<long>"


def _stage(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Documents in order of ids as blocks of piece codes, with each block's frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        schema = pa.schema(
            [("part", pa.int32()), ("seq", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("codes", pa.binary()), ("n_codes", pa.list_(pa.int32())), ("number", pa.binary()), ("flat", pa.binary()),
             ("odd", pa.list_(pa.struct([("row", pa.int32()), ("ids", pa.binary())]))), ("ids", pa.list_(pa.int64())), ("uses", pa.list_(pa.int64()))]
        )
        for seq, (batch, c) in enumerate(coded(batches, tokenizer)):
            found, uses = c.histogram()
            planes = c.code.astype("<u4").view(np.uint8).reshape(-1, 4).T  # like bytes together, for the codec
            row = {
                "part": part, "seq": seq, "doc_ids": batch.column("doc_id").to_pylist(), "codes": planes.tobytes(), "n_codes": np.diff(c.offsets).tolist(), "number": c.number.astype("<u4").tobytes(), "flat": c.flat.astype("<u4").tobytes(),
                "odd": [{"row": i, "ids": x.astype("<u4").tobytes()} for i, x in c.odd.items()], "ids": found.tolist(), "uses": uses.tolist(),
            }
            yield pa.RecordBatch.from_pylist([row], schema)

    return docs.mapInArrow(tidy(run), _STAGED)


def _ranked(staged: DataFrame, order: np.ndarray) -> DataFrame:
    """Staged blocks as file blocks; ``order`` has the ids by rank."""
    rank = np.zeros(int(order.max(initial=0)) + 1, np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("control", pa.list_(pa.binary())), ("data", pa.list_(pa.binary()))])
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                planes = np.frombuffer(row["codes"], np.uint8).reshape(4, -1)
                code = np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)
                odd = {x["row"]: np.frombuffer(x["ids"], "<u4") for x in row["odd"]}
                c = Coded(code, np.concatenate([[0], np.cumsum(row["n_codes"])]).astype(np.int64), np.frombuffer(row["number"], "<u4").astype(np.int64), np.frombuffer(row["flat"], "<u4"), odd)
                ids, start = c.expand(END_ID)
                parts = [encode(rank[ids[a : a + STEP]]) for a in range(0, len(ids), STEP)]
                out = {"part": row["part"], "seq": row["seq"], "doc_ids": row["doc_ids"], "sizes": np.diff(start).tolist(), "control": [p[0] for p in parts], "data": [p[1] for p in parts]}
                yield pa.RecordBatch.from_pylist([out], schema)

    return staged.drop("ids", "uses").mapInArrow(tidy(run), BLOCKS)


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``path/blocks`` and ``path/ids_by_rank``.

    Documents are ordered by id by a range partitioning of the texts. A null
    text is empty and has the end id alone; rows with a null id come first;
    repeated rows are written each, rows of equal ids in any order, so only their
    places together are defined; an empty table gives files without blocks.
    The ranks cover all documents; the table has a row per id in use.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "token_files")
    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    staged = scratch.table(_stage(ordered, tokenizer or default_tokenizer()), "staged", "zstd")
    pairs = staged.select(F.explode(F.arrays_zip("ids", "uses")).alias("x")).select("x.ids", "x.uses")
    ends = staged.select(F.lit(END_ID).cast("long").alias("ids"), F.size("doc_ids").cast("long").alias("uses"))
    ranks = pairs.union(ends).groupBy("ids").agg(F.sum("uses").alias("uses")).orderBy(F.desc("uses"), "ids").collect()  # one row per id of the vocabulary
    order = np.array([x["ids"] for x in ranks], np.int64)
    spark.createDataFrame([(i, int(x)) for i, x in enumerate(order)], "rank int, id long").coalesce(1).write.parquet(f"{path}/ids_by_rank")
    _ranked(staged, order).write.option("compression", "zstd").parquet(f"{path}/blocks")
    scratch.drop("staged")


def read_token_files(spark: SparkSession, path: str, fn, schema: str) -> DataFrame:
    """Decode the blocks; ``fn(doc_ids, sizes, ids)`` gives the columns of ``schema`` for one block.

    The columns ``part``, ``seq`` and ``start`` (ids before the document in its block) come first.
    """
    order = np.array([x["id"] for x in spark.read.parquet(f"{path}/ids_by_rank").orderBy("rank").collect()], np.uint32)  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                sizes, left, ids = np.array(row["sizes"], np.int64), sum(row["sizes"]), []
                for control, data in zip(row["control"], row["data"]):
                    ids.append(order[decode(control, data, min(STEP, left))])
                    left -= min(STEP, left)
                columns = fn(row["doc_ids"], sizes, np.concatenate(ids) if ids else np.empty(0, np.uint32))
                n = len(sizes)
                head = {"part": pa.array([row["part"]] * n, pa.int32()), "seq": pa.array([row["seq"]] * n, pa.int32()), "start": pa.array(np.cumsum(sizes) - sizes, pa.int64())}
                yield pa.RecordBatch.from_pydict(head | columns)

    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks").mapInArrow(run, f"part int, seq int, start long, {schema}")


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files."""

    def fn(doc_ids: list, sizes: np.ndarray, ids: np.ndarray) -> dict:
        raw, ends = memoryview(ids.astype("<u4").tobytes()), (4 * np.cumsum(sizes)).tolist()
        crc = [zlib.crc32(raw[b - 4 * k : b]) for b, k in zip(ends, sizes.tolist())]
        return {"doc_id": pa.array(doc_ids, pa.int64()), "n_tokens": pa.array(sizes, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}

    docs = Scratch(spark, "token_digests").table(read_token_files(spark, path, fn, "doc_id long, n_tokens long, ids_crc32 long"), "docs")
    blocks = docs.groupBy("part", "seq").agg(F.sum("n_tokens").alias("n"))
    upto = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = blocks.groupBy("part").agg(F.sum("n").alias("n")).select("part", upto(Window.orderBy("part")).alias("a"))  # one row per range partition
    inner = blocks.select("part", "seq", upto(Window.partitionBy("part").orderBy("seq")).alias("b"))
    base = parts.join(inner, "part").select("part", "seq", (F.col("a") + F.col("b")).alias("base"))
    return docs.join(base, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token files and read back."""
    path = Scratch(spark, "token_file_set").root
    write_token_files(read(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return document_digests(spark, path)
