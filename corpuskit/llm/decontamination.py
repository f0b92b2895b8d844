"""Where benchmark texts stand in documents, by a positional inverted index.

The index is a table with one row for each shard, some megabytes of documents:
its terms and the places of each term among the shard's words. Queries are runs
of words. A query starts from the list of its rarest term in the shard, moved by
that term's offset, and is intersected with the lists of its other terms, moved
by theirs, from the rarest on. Benchmark texts come to the shards in blocks of
bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpuskit.llm._text import byte_translated, gather, list_array, read, slices, small_batches, texts, words
from corpuskit.plans.scratch import Scratch

#: Words of a window.
WINDOW = 10
#: Bytes of text of one shard; one longer text is a shard of its own.
SHARD_BYTES = 3_000_000
#: Bytes of benchmark words that are broadcast at a time, and windows of one piece of an item.
BLOCK_BYTES, PIECE = 4_000_000, 50_000
#: Candidate places that a task holds at a time; the places of one window are held together.
CANDIDATES = 2_000_000
#: Lower case for A-Z; digits, a-z and all beyond ASCII as they are; the rest separates words.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def plain_words(array: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Codes of the words of all texts, row offsets, and the distinct words."""
    return words(byte_translated(array, _TABLE), lower=False)


def positional_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a shard: its documents' ids and numbers of words, its terms, how often each occurs and where.

    ``places`` has the places of the first term in rising order, then those of
    the second, counted over all words of the shard. Null texts have no words.
    Ids may be null or repeat: a document is known by its shard and its place
    there. Write the table before it is read more than once.
    """
    ids = to_arrow_type(docs.schema[id_col].dataType)
    schema = pa.schema([("shard", pa.int64()), ("ids", pa.list_(ids)), ("sizes", pa.list_(pa.int32())), ("terms", pa.list_(pa.string())), ("counts", pa.list_(pa.int32())), ("places", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for part in slices(batches, limit=SHARD_BYTES):
            codes, offsets, terms = plain_words(texts(part))
            places = np.argsort(codes.astype(np.int32), kind="stable")
            row = [part.column("id"), np.diff(offsets), terms, np.bincount(codes, minlength=len(terms)), places]
            columns = [pa.array([shard])]
            for values, field in zip(row, list(schema)[1:]):
                kind = field.type.value_type
                values = values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)
                columns.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values))
            yield pa.RecordBatch.from_arrays(columns, schema=schema)
            shard += 1

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"shard long, ids array<{kind}>, sizes array<int>, terms array<string>, counts array<int>, places array<int>")


def item_pieces(items: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item, piece, words)``: at most ``PIECE`` windows of an item each; pieces of an item overlap by a window less a word."""
    kind = items.schema[id_col].dataType
    schema = pa.schema([("item", to_arrow_type(kind)), ("piece", pa.int64()), ("words", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=SHARD_BYTES):
            codes, offsets, terms = plain_words(texts(part))
            rows, starts, ends = [], [], []
            for i, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
                for k in range(a, max(b - window + 1, min(a + 1, b)), PIECE):
                    rows.append(i), starts.append(k), ends.append(min(b, k + PIECE + window - 1))
            start, size = np.array(starts, np.int64), np.array(ends, np.int64) - np.array(starts, np.int64)
            held = terms.take(pa.array(gather(codes, start, size))) if len(start) else terms.slice(0, 0)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), held)
            yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(rows, pa.int64())), pa.array((start - offsets[rows]) // PIECE if rows else [], pa.int64()), lists], schema=schema)

    found = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return found.mapInArrow(run, f"item {kind.simpleString()}, piece long, words array<string>")


class Windows:
    """The distinct windows of one block of pieces: words as numbers of ``terms``, and who has each window."""

    def __init__(self, pieces: pa.Table, window: int):
        lists = pieces.column("words").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        coded = lists.flatten().dictionary_encode()
        self.terms, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        items = pieces.column("item").combine_chunks()
        items = items.chunk(0) if isinstance(items, pa.ChunkedArray) else items
        self.items = items
        #: By length: the windows, and of each the pieces that have it, from ``first[w]`` to ``first[w + 1]``.
        self.by_length: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for length in np.unique(np.minimum(sizes, window)).tolist():
            mine = np.flatnonzero(np.minimum(sizes, window) == length)
            many = sizes[mine] - length + 1
            owner = np.repeat(mine, many)
            begin = gather(np.arange(len(codes) + 1), starts[mine], many)
            rows, which = np.unique(codes[begin[:, None] + np.arange(length)], axis=0, return_inverse=True)
            pair = np.unique(np.column_stack([which.ravel(), owner]), axis=0)
            self.by_length.append((rows, np.searchsorted(pair[:, 0], np.arange(len(rows) + 1)), pair[:, 1]))


class Shard:
    """One row of the index, ready to be asked."""

    def __init__(self, row: pa.RecordBatch):
        flat = {c: row.column(c).flatten() for c in ("sizes", "terms", "counts", "places")}
        self.terms = flat["terms"]
        self.counts, self.places = flat["counts"].to_numpy().astype(np.int64), flat["places"].to_numpy().astype(np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        self.sizes = flat["sizes"].to_numpy().astype(np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.term_at = np.empty(len(self.places), np.int64)  # in whose list each place is
        self.term_at[self.places] = np.repeat(np.arange(len(self.counts)), self.counts)
        self.keys = None

    def occurrences(self, windows: Windows, slop: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Number of a length in ``windows``, windows of it, and the places of their first words and after their last ones."""
        mine = pc.fill_null(pc.index_in(windows.terms, value_set=self.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        for number, (rows, _, _) in enumerate(windows.by_length):
            terms = mine[rows]
            alive = np.flatnonzero((terms >= 0).all(axis=1))
            terms = terms[alive]
            order = np.argsort(self.counts[terms], axis=1, kind="stable")
            rarest = np.take_along_axis(terms, order[:, :1], axis=1)[:, 0]
            group = np.cumsum(self.counts[rarest]) // CANDIDATES
            for block in np.split(np.arange(len(alive)), np.flatnonzero(np.diff(group)) + 1):
                if len(block):
                    which = np.repeat(block, self.counts[rarest[block]])
                    at = gather(self.places, self.starts[rarest[block]], self.counts[rarest[block]])
                    which, a, b = (self._near if slop else self._exact)(terms, order, which, at, slop)
                    yield number, alive[which], a, b

    def _exact(self, terms: np.ndarray, order: np.ndarray, which: np.ndarray, at: np.ndarray, slop: int):
        length = terms.shape[1]
        at = at - order[which, 0]
        ok = (at >= 0) & (at + length <= len(self.places))
        which, at = which[ok], at[ok]
        for j in range(1, length):
            offset = order[which, j]
            ok = self.term_at[at + offset] == terms[which, offset]
            which, at = which[ok], at[ok]
        ok = self.doc[at] == self.doc[at + length - 1]
        return which[ok], at[ok], at[ok] + length

    def _near(self, terms: np.ndarray, order: np.ndarray, which: np.ndarray, at: np.ndarray, slop: int):
        """From the rarest term to both sides always the next place of the next term: the tightest match around it."""
        length, total = terms.shape[1], len(self.places)
        if self.keys is None:
            self.keys = np.repeat(np.arange(len(self.counts)), self.counts) * total + self.places
        low, high, rarest = at.copy(), at.copy(), order[which, 0]
        for step in (1, -1):
            for j in range(length) if step > 0 else range(length - 1, -1, -1):
                if not len(which):
                    break
                due = j > rarest if step > 0 else j < rarest
                key = terms[which, j] * total + (high if step > 0 else low)
                found = np.searchsorted(self.keys, key, "right") if step > 0 else np.searchsorted(self.keys, key, "left") - 1
                inside = np.clip(found, 0, total - 1)
                place = self.keys[inside] - terms[which, j] * total
                ok = (found == inside) & (place >= 0) & (place < total)
                if step > 0:
                    high = np.where(due, place, high)
                else:
                    low = np.where(due, place, low)
                ok = ~due | ok & (high - low < length + slop)
                which, low, high, rarest = which[ok], low[ok], high[ok], rarest[ok]
        ok = self.doc[low] == self.doc[high] if len(low) else np.zeros(0, bool)
        return which[ok], low[ok], high[ok] + 1


def _merged(key: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of equal keys that touch or overlap as one."""
    order = np.lexsort((start, key))
    key, start, end = key[order], start[order], end[order]
    if not len(key):
        return key, start, end
    shift = key * (int(end.max()) + 1)  # the largest end so far, anew for each key
    reach = np.maximum.accumulate(end + shift) - shift
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (start[1:] > reach[:-1])])
    begin = np.flatnonzero(new)
    return key[begin], start[begin], np.maximum.reduceat(end, begin)


def _blocks(items: DataFrame, window: int, id_col: str, text_col: str, scratch: Scratch) -> Iterator[pa.Table]:
    pieces = scratch.table(item_pieces(items, window, id_col, text_col).where("size(words) > 0"), "pieces")
    size = pieces.agg(F.coalesce(F.sum(F.expr("aggregate(words, 0L, (n, w) -> n + octet_length(w) + 4)")), F.lit(0)).alias("n")).first()["n"]
    many = -(-size // BLOCK_BYTES)
    for i in range(many):
        yield pieces.where(F.pmod(F.xxhash64("item", "piece", "words"), F.lit(many)) == i).select("item", "words").toArrow()


def phrase_matches(index: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(shard, place, item_id, starts, ends)``: where windows of each item stand in each document.

    A window is ``window`` consecutive words of an item; an item of fewer words
    is one window, one without words has none. Without ``slop`` a window's words
    stand in the document as they are; with it they stand in their order within
    ``slop`` words more, one word of the document for each. Spans are word
    numbers in the document, ends exclusive; those of an item that touch or
    overlap are one. Items of one id are told apart only by their rows.
    ``index`` is a written table; each block of items reads it once.
    """
    spark = index.sparkSession
    kind = items.schema[id_col].dataType
    schema = pa.schema([("shard", pa.int64()), ("place", pa.int32()), (id_col, to_arrow_type(kind)), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])
    text = f"shard long, place int, {id_col} {kind.simpleString()}, starts array<int>, ends array<int>"
    out = spark.createDataFrame([], text)
    for block in _blocks(items, window, id_col, text_col, Scratch(spark, "benchmark")):
        if not block.num_rows:
            continue
        held = spark.sparkContext.broadcast(Windows(block, window))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            windows = held.value
            for batch in batches:
                for i in range(batch.num_rows):
                    shard = Shard(batch.slice(i, 1))
                    parts = []
                    for number, which, a, b in shard.occurrences(windows, slop):
                        _, first, owners = windows.by_length[number]
                        many = first[which + 1] - first[which]
                        parts.append((np.repeat(shard.doc[a], many), gather(owners, first[which], many), np.repeat(a, many), np.repeat(b, many)))
                    if not parts or not sum(len(p[0]) for p in parts):
                        continue
                    doc, piece, a, b = (np.concatenate(x) for x in zip(*parts))
                    key, a, b = _merged(doc * len(windows.items) + piece, a, b)
                    doc, piece = key // len(windows.items), key % len(windows.items)
                    cut = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
                    head = cut[:-1]
                    columns = [pa.array(np.full(len(head), batch.column("shard")[i].as_py())), pa.array(doc[head], pa.int32()), windows.items.take(pa.array(piece[head]))]
                    columns += [list_array(x - shard.first[doc], cut, pa.int32()) for x in (a, b)]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

        out = out.union(index.select("shard", "sizes", "terms", "counts", "places").mapInArrow(run, text))
    return out


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """``(id_col, n_words, spans, items)`` of every document: hit spans over all items, and the items, distinct.

    Rows are kept as they are: ids that are null or repeat have a row each. Null
    texts have no words. Items with a null id hit too, but aren't among
    ``items``. Empty tables give no rows, or documents without hits. Other
    columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "positional_index")
    with small_batches(spark):
        index = scratch.table(positional_index(docs, id_col, text_col), "index", "zstd", wide=True)
    with small_batches(spark, 2):  # rows of an index are megabytes
        found = scratch.table(phrase_matches(index, items, window, slop, item_col), "matches")
    hits = found.groupBy("shard", "place").agg(
        F.array_sort(F.flatten(F.collect_list(F.arrays_zip("starts", "ends")))).alias("spans"),
        F.array_sort(F.collect_set(item_col)).alias("items"),
    )
    rows = index.select("shard", F.posexplode(F.arrays_zip("ids", "sizes")).alias("place", "x")).select("shard", "place", F.col("x.ids").alias(id_col), F.col("x.sizes").alias("n_words"))
    rows = rows.join(hits, ["shard", "place"], "left")
    spans = F.coalesce("spans", F.expr("cast(array() as array<struct<starts: int, ends: int>>)"))
    none = F.expr(f"cast(array() as array<{items.schema[item_col].dataType.simpleString()}>)")
    return rows.select(id_col, F.col("n_words").cast("long").alias("n_words"), spans.alias("spans"), F.coalesce("items", none).alias("items"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of ten benchmark words in all documents."""
    found = contamination(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("item_id", "text"))
    met = "aggregate(spans, struct(0L as n, 0 as seen), (a, x) -> struct(a.n + greatest(0, x.ends - greatest(a.seen, x.starts)) as n, greatest(a.seen, x.ends) as seen), a -> a.n)"
    found = found.withColumn("n_hit", F.expr(met))
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (
    SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, list_slice(w, i, i + least(len(w), {WINDOW}) - 1) AS k
    FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - {WINDOW - 1}, 1))) AS i FROM b WHERE len(w) > 0)
),
lengths AS (SELECT DISTINCT n FROM windows),
ahead AS (
    SELECT doc_id, i, list(w) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS k
    FROM (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM d)
),
met AS (
    SELECT doc_id, i, n, item_id
    FROM (SELECT doc_id, i, n, list_slice(k, 1, n) AS k FROM ahead, lengths WHERE len(k) >= n) AS runs JOIN windows USING (n, k)
),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM met) GROUP BY doc_id),
named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM met WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""
