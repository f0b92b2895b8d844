"""Arrow helpers for operators that read whole texts inside Spark tasks."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuskit.plans.scratch import Scratch

#: Bytes of text that a task holds decoded at a time; one longer text is held alone.
SLICE_BYTES = 6_000_000
#: Punctuation that may close a word, and words of several lines.
TAIL, LINES = ",.!?;:", r"^ ?[^\s\x0b]+(?:\n[^\s\x0b]+)+$"
#: Words whose ids one worker remembers between slices; some 60 bytes each.
REMEMBERED = 1_000_000


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of one slice stay below ``limit`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(size, dtype=np.int64) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def release() -> None:
    """Give memory that the allocators keep free back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(fn: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task function that gives freed memory back to the system at its end.

    Spark keeps Python workers for later tasks; idle ones would hold what the
    allocators of their last task keep beside the stages that follow.
    """

    def run(batches: Iterator) -> Iterator:
        yield from fn(batches)
        release()

    return run


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Batches of few rows for the tables that are written inside, from Parquet and to Python: texts are long, and JVM and Python each hold a batch."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")}
    for key, most in before.items():
        spark.conf.set(key, str(min(rows, int(most)) if int(most) > 0 else rows))
    try:
        yield
    finally:
        for key, most in before.items():
            spark.conf.set(key, most)


def texts(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The texts with null as the empty string."""
    return pc.fill_null(batch.column(column), "")


def words(array: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between ASCII white space: codes, row offsets of length n + 1, and the distinct words.

    ``lower`` lower-cases A-Z alone.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(array) if lower else array)
    flat = split.flatten()
    offsets = split.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        before = np.concatenate([[0], np.cumsum(full)])
        flat, offsets = flat.filter(pa.array(full)), before[offsets]
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), offsets, coded.dictionary


def byte_translated(array: pa.Array, table: bytes) -> pa.Array:
    """Strings without nulls, their bytes put through a table that leaves bytes beyond ASCII alone."""
    if not len(array) or array.buffers()[2] is None:
        return array
    at = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1]
    data = memoryview(array.buffers()[2])[at[0] : at[-1]].tobytes().translate(table)
    return pa.StringArray.from_buffers(len(array), pa.py_buffer((at - at[0]).astype(np.int32)), pa.py_buffer(data))


def hash_words(distinct: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word."""
    digest = xxhash.xxh3_64_intdigest
    data, at = b"" if distinct.buffers()[2] is None else distinct.buffers()[2].to_pybytes(), byte_offsets(distinct)
    return np.fromiter((digest(data[a:b]) for a, b in zip(at, at[1:])), np.uint64, len(distinct))


def byte_offsets(words: pa.Array) -> list[int]:
    """Where each string begins in the data buffer, and where the last one ends."""
    offsets = np.frombuffer(words.buffers()[1], np.int32) if words.buffers()[1] is not None else np.zeros(1, np.int32)
    return offsets[words.offset : words.offset + len(words) + 1].tolist()


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_hashes(word_hash: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words; row i holds the run that starts at word i."""
    count = len(word_hash) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = np.full(count, n, np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + word_hash[k : k + count])
    return out


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def read(spark, sf_dir: str, table: str):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """The runs of equal keys of batches sorted by them; a run may span batches."""
    held: list[pa.RecordBatch] = []

    def whole() -> pa.RecordBatch:
        out = held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        held.clear()
        return out

    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.column_stack([batch.column(c).to_numpy() for c in keys])
        cuts = (np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist()
        for a, b in zip([0, *cuts], [*cuts, len(key)]):
            if held and (a or any(held[0].column(c)[0].as_py() != k for c, k in zip(keys, key[0].tolist()))):
                yield whole()
            held.append(batch.slice(a, b - a))
    if held:
        yield whole()


#: Ids up to which a table of dropped rows is broadcast; a larger one is a shuffled join.
BROADCAST_IDS = 500_000


def without(rows: DataFrame, dropped: DataFrame, id_col: str) -> DataFrame:
    """The rows whose id is not among ``dropped``; rows with a null id stay."""
    table = Scratch(rows.sparkSession, "dropped").table(dropped.where(F.col(id_col).isNotNull()).distinct(), "ids")
    side = F.broadcast(table) if table.count() <= BROADCAST_IDS else table
    return rows.join(side, id_col, "left_anti").select(*rows.columns)


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Concatenation of ``flat[s : s + n]`` for each place."""
    shift = np.repeat(start - np.concatenate([[0], np.cumsum(size)])[:-1], size)
    return flat[shift + np.arange(len(shift))]


def word_parts(items: pa.Array, lines: bool) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """What items are cut into: codes item by item, how many each has, and the distinct parts.

    Punctuation that closes a word is a part of its own; with ``lines`` so is a
    single newline between visible characters.
    """
    many = pc.match_substring_regex(items, LINES).to_numpy(zero_copy_only=False) & lines
    split = pc.split_pattern(items.filter(pa.array(many)), "\n")
    n = np.diff(split.offsets.to_numpy())
    item = np.concatenate([np.flatnonzero(~many), np.repeat(np.flatnonzero(many), n)])
    later = np.ones(len(item), bool)
    later[: len(items) - len(n)] = False
    later[len(items) - len(n) + np.cumsum(n) - n] = False
    line = pa.concat_arrays([items.filter(pa.array(~many)), split.flatten()])
    trimmed = pc.utf8_rtrim(line, characters=TAIL)
    word = pc.match_substring_regex(trimmed, r"[\p{L}\p{N}]$")
    head = pc.if_else(word, trimmed, line)
    tail = pc.if_else(word, pc.replace_substring_regex(line, r"(?s)^.*[^" + TAIL + "]", ""), "")
    parts = pa.concat_arrays([pa.array(["\n"]), head, tail]).dictionary_encode()
    code = parts.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    filled = pc.greater(pc.binary_length(pa.concat_arrays([head, tail])), 0).to_numpy(zero_copy_only=False)
    slot = np.column_stack([np.zeros(len(item), np.int64), code[1 : len(item) + 1], code[len(item) + 1 :]])
    held = np.column_stack([later, filled[: len(item)], filled[len(item) :]])
    order = np.argsort(item, kind="stable")
    return slot[order][held[order]], np.bincount(item, weights=held.sum(axis=1), minlength=len(items)).astype(np.int64), parts.dictionary


class Remembered:
    """Ids of distinct strings as one flat array with places, kept between the slices and tasks of a worker.

    Strings are looked up by hash and compared, so a collision costs only time.
    """

    def __init__(self, kind: type, limit: int = REMEMBERED):
        self.kind, self.limit = kind, limit
        self.forget()

    def forget(self) -> None:
        self.hashes, self.row = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.vocab = pa.array([], pa.string())
        self.start, self.size, self.flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, self.kind)

    def fresh(self, items: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of new strings in one array, how many each has, and the strings' order in the array."""
        raise NotImplementedError

    def places(self, items: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Start and number of the ids of each distinct string in ``self.flat``."""
        if len(self.vocab) > self.limit:
            self.forget()
        hashed = hash_words(items)
        row = np.full(len(items), -1)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashed), len(self.hashes) - 1)
            at = self.row[at]
            same = pc.equal(self.vocab.take(pa.array(at)), items).to_numpy(zero_copy_only=False)
            row[same] = at[same]
        new = np.flatnonzero(row < 0)
        if len(new):
            missing = items.take(pa.array(new))
            flat, size, order = self.fresh(missing)
            start = np.empty(len(new), np.int64)
            start[order] = len(self.flat) + np.concatenate([[0], np.cumsum(size[order])])[:-1]
            row[new] = len(self.vocab) + np.arange(len(new))
            self.vocab = pa.concat_arrays([self.vocab, missing])
            self.start, self.size = np.r_[self.start, start], np.r_[self.size, size]
            self.flat = np.r_[self.flat, flat]
            by = np.argsort(hashed[new])
            into = np.searchsorted(self.hashes, hashed[new][by])
            self.hashes, self.row = np.insert(self.hashes, into, hashed[new][by]), np.insert(self.row, into, row[new][by])
        return self.start[row], self.size[row]
