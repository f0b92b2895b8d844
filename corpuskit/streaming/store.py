"""An index that follows file events: documents, chunks and postings in append-only batches, compacted now and then."""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import batched

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpuskit.functions import text as T
from corpuskit.operators.chunks import chunk_text
from corpuskit.operators.keyword import build_postings
from corpuskit.plans.scratch import Scratch
from corpuskit.sources.files import read_text
from corpuskit.streaming.events import route_events
from corpuskit.streaming.lifetimes import lifetimes

SCHEMAS = {
    "documents": "doc_id string, file_path string, file_hash string, n_chars long, content long, pending boolean, deleted boolean, batch long",
    "chunks": "doc_id string, chunk_index long, content string, char_start long, char_end long, chunk_id string, batch long",
    "postings": "doc_id string, term string, chunk_id string, tf long, positions array<int>, batch long",
    "log": "run string, number long",
}
#: Paths that the driver holds at a time to have Spark read their files.
PATHS_AT_ONCE = 10_000


def load_files(paths: DataFrame) -> DataFrame:
    """``(file_path, text)`` of files; those that are gone by now are left out. Paths are taken in blocks."""
    spark = paths.sparkSession
    scratch, schema = Scratch(spark, "texts"), "file_path string, text string"
    scratch.table(spark.createDataFrame([], schema), "texts")
    rows = paths.select("file_path").distinct().toLocalIterator()
    for block in batched((x.file_path for x in rows), PATHS_AT_ONCE):
        found = [re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in _existing(spark, block)]
        if found:
            files = spark.read.format("binaryFile").option("ignoreMissingFiles", True).load(found)
            texts = read_text(files.select(F.regexp_replace("path", "^file:/*", "/").alias("file_path"), "content"))
            texts.select("file_path", "text").write.mode("append").parquet(f"{scratch.root}/texts")
    return spark.read.schema(schema).parquet(f"{scratch.root}/texts")


def _existing(spark: SparkSession, paths: tuple[str, ...]) -> list[str]:
    """The paths that are files now, by one listing of each of their folders."""
    found, wanted = [], {}
    for p in paths:
        wanted.setdefault(p.rsplit("/", 1)[0] or "/", set()).add(p.rsplit("/", 1)[1])
    for folder, names in wanted.items():
        path, fs = _at(spark, folder)
        if fs.exists(path):
            found += [f"{folder.rstrip('/')}/{s.getPath().getName()}" for s in fs.listStatus(path) if s.isFile() and s.getPath().getName() in names]
    return found


def _at(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class IndexStore:
    """Tables below a folder that each batch of events appends to.

    The store numbers its batches itself. A batch shows once its line in the log
    is written, which comes last; what a failed one left is overwritten by the
    next. A batch of a run that comes again after that is left out, so a stream
    may be started anew with a new checkpoint, or several streams may take turns.

    A document's row of the highest batch counts. Its chunks and postings are
    those of the batch named ``content``, so a rename writes no text. Only
    documents with text are listed; others keep their row, so their id stays.
    ``pending`` marks a document whose file was gone when it was to be read: it
    has moved on, and the event that says where comes in a later batch.

    A batch reads the narrow table of documents, not chunks or postings.
    ``compact`` writes what is current as one batch of a new generation; the
    generation before stays for those who read it, older ones go.
    """

    def __init__(self, spark: SparkSession, root: str, load: Callable[[DataFrame], DataFrame] = load_files):
        self.spark, self.root, self.load = spark, root.rstrip("/"), load

    def _generation(self) -> int:
        path, fs = _at(self.spark, f"{self.root}/ready")
        if not fs.exists(path):
            self._begin(0)
            return 0
        return max(int(s.getPath().getName()) for s in fs.listStatus(path))

    def _begin(self, generation: int) -> None:
        """Generation ``generation`` is whole from here on."""
        for name, schema in SCHEMAS.items():
            self._write(name, self.spark.createDataFrame([], schema), -1, generation)
        path, fs = _at(self.spark, f"{self.root}/ready/{generation}")
        fs.mkdirs(path)

    def _write(self, name: str, rows: DataFrame, number: int, generation: int) -> None:
        columns = [c.split()[0] for c in SCHEMAS[name].split(", ")]
        rows.select(*columns).write.mode("overwrite").parquet(f"{self.root}/generation={generation}/{name}/part={number}")

    def _log(self, generation: int) -> tuple[int, dict[str, int]]:
        """The number of the last batch, and of each run the last batch it gave."""
        path = f"{self.root}/generation={generation}/log"
        rows = self.spark.read.schema(f"{SCHEMAS['log']}, part long").option("basePath", path).parquet(path)
        found = rows.groupBy("run").agg(F.max("number").alias("number"), F.max("part").alias("part")).collect()
        return max((r["part"] for r in found), default=-1), {r["run"]: r["number"] for r in found}

    def _read(self, name: str, generation: int, last: int) -> DataFrame:
        path = f"{self.root}/generation={generation}/{name}"
        rows = self.spark.read.schema(f"{SCHEMAS[name]}, part long").option("basePath", path).parquet(path)
        return rows.where(F.col("part") <= last).drop("part")

    def _latest(self, rows: DataFrame) -> DataFrame:
        best = rows.groupBy("doc_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "doc_id"]), "batch").alias("x"))
        return best.select("doc_id", "x.*").where("not deleted")

    def _now(self) -> tuple[int, int]:
        generation = self._generation()
        return generation, self._log(generation)[0]

    def documents(self) -> DataFrame:
        """``(doc_id, file_path, file_hash, n_chars, content)`` of the documents that have text."""
        rows = self._latest(self._read("documents", *self._now()))
        return rows.where("n_chars > 0").drop("deleted", "batch", "pending")

    def _current(self, name: str, generation: int, last: int) -> DataFrame:
        live = self._latest(self._read("documents", generation, last)).where("n_chars > 0").select("doc_id", F.col("content").alias("batch"))
        return self._read(name, generation, last).join(live, ["doc_id", "batch"], "left_semi")

    def chunks(self) -> DataFrame:
        return self._current("chunks", *self._now()).drop("batch")

    def postings(self) -> DataFrame:
        return self._current("postings", *self._now()).drop("batch")

    def apply(self, events: DataFrame, number: int, run: str = "") -> None:
        """Take in batch ``number`` of a run: routed events ``(ts, path, old_path, action)``, with ``seq`` where times may be equal.

        Events count in the order of their times. Files are read once, where
        they are after the batch. A rename takes the document along and removes
        the one at its target; one whose file is not known brings a new document.
        A document keeps its id while its file lives, whatever the batches: it is
        made of the first event's path, time and number. Changed files whose text
        is as before keep their chunks; deletes of unknown files do nothing.
        """
        generation = self._generation()
        last, given = self._log(generation)
        if number <= given.get(run, -1):
            return
        this = last + 1
        scratch = Scratch(self.spark, "apply")
        files = scratch.table(lifetimes(scratch.table(events, "events")), "files")
        rows = self._read("documents", generation, last)
        met = rows.join(files.select(F.col("start").alias("file_path")), "file_path", "left_semi").select("doc_id").distinct()
        known = self._latest(rows.join(met, "doc_id", "left_semi")).drop("deleted", "batch").withColumnRenamed("file_path", "start")
        found = files.join(known, "start", "left")
        gone = found.where("ended and doc_id is not null")
        stays = found.where("not ended and (doc_id is not null or born_at is not null)").withColumn("old_id", F.col("doc_id"))
        stays = scratch.table(stays.withColumn("doc_id", F.coalesce("doc_id", T.uuid5(F.concat_ws(":", "born_path", _moment(stays), F.col("born_at.seq").cast("string"))))), "stays")
        read = stays.where("touched or old_id is null or pending")
        texts = self.load(read.select(F.col("path").alias("file_path"))).where("text is not null")
        texts = texts.select(F.col("file_path").alias("path"), "text", F.sha2("text", 256).alias("new_hash"))
        fresh = scratch.table(read.join(texts, "path", "left").select("doc_id", "text", "new_hash"), "fresh")
        seen = stays.join(fresh.drop("text").withColumn("read", F.lit(True)), "doc_id", "left")
        changed = F.col("new_hash").isNotNull() & (F.coalesce(F.col("file_hash") != F.col("new_hash"), F.lit(True)))
        length = fresh.select("doc_id", F.when(F.trim("text") == "", 0).otherwise(F.length("text")).cast("long").alias("length"))
        seen = scratch.table(seen.join(length, "doc_id", "left").withColumn("changed", changed), "seen")
        same = F.col("old_id").isNotNull() & (F.col("start") == F.col("path")) & ~F.col("changed") & (F.coalesce("pending", F.lit(False)) == (F.coalesce("read", F.lit(False)) & F.col("new_hash").isNull()))
        kept = seen.where(~F.coalesce(same, F.lit(False))).select(
            "doc_id", F.col("path").alias("file_path"),
            F.when(F.col("changed"), F.col("new_hash")).otherwise(F.col("file_hash")).alias("file_hash"),
            F.coalesce(F.when(F.col("changed"), F.col("length")).otherwise(F.col("n_chars")), F.lit(0)).cast("long").alias("n_chars"),
            F.when(F.col("changed"), F.lit(this)).otherwise(F.col("content")).cast("long").alias("content"),
            (F.coalesce("read", F.lit(False)) & F.col("new_hash").isNull()).alias("pending"), F.lit(False).alias("deleted"),
        )
        lost = gone.select("doc_id", F.col("start").alias("file_path"), "file_hash", "n_chars", "content", "pending", F.lit(True).alias("deleted"))
        new = fresh.join(seen.where("changed and length > 0").select("doc_id"), "doc_id", "left_semi").select("doc_id", "text")
        chunks = chunk_text(new).withColumn("chunk_id", F.concat_ws(":", "doc_id", F.col("chunk_index").cast("string")))
        chunks = scratch.table(chunks, "chunks").withColumn("batch", F.lit(this).cast("long"))
        postings = build_postings(chunks.drop("batch")).withColumn("doc_id", F.regexp_replace("chunk_id", ":[0-9]+$", ""))
        self._write("postings", postings.withColumn("batch", F.lit(this).cast("long")), this, generation)
        self._write("chunks", chunks, this, generation)
        self._write("documents", kept.unionByName(lost).withColumn("batch", F.lit(this).cast("long")), this, generation)
        self._write("log", self.spark.createDataFrame([(run, number)], SCHEMAS["log"]), this, generation)

    def compact(self) -> None:
        """Write what is current as one batch of a new generation. No batch may be applied meanwhile."""
        generation = self._generation()
        last, given = self._log(generation)
        if last < 0:
            return
        for name in ("chunks", "postings"):
            self._write(name, self._current(name, generation, last), last, generation + 1)
        rows = self._latest(self._read("documents", generation, last))
        self._write("documents", rows, last, generation + 1)
        self._write("log", self.spark.createDataFrame(list(given.items()), SCHEMAS["log"]), last, generation + 1)
        self._begin(generation + 1)
        path, fs = _at(self.spark, f"{self.root}/generation={generation - 1}")
        fs.delete(path, True)

    def follow(self, events: DataFrame, watched: DataFrame, checkpoint: str, compact_every: int = 0):
        """Start a query that keeps the tables current with a stream of file events, compacting after every so many batches."""

        def take(batch: DataFrame, number: int) -> None:
            self.apply(batch, number, checkpoint)
            if compact_every and number % compact_every == compact_every - 1:
                self.compact()

        return route_events(events, watched).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).start()


def _moment(rows: DataFrame) -> Column:
    """The time of the first event as text that no session setting changes."""
    at = F.col("born_at.ts")
    return (F.unix_micros(at) if rows.select(at).dtypes[0][1] == "timestamp" else at).cast("string")
