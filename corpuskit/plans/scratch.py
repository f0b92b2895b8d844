"""Intermediate tables in the folder that driver and executors share.

Iterative jobs and jobs that read a result twice write it as Parquet below the
folder named by ``spark.checkpoint.dir``: the lineage ends there, and a lost
executor costs a re-read instead of a recomputation.
"""

from __future__ import annotations

import logging
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger(__name__)

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a folder of our own only where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not _own_dir:
        log.warning("spark.checkpoint.dir is unset: intermediate tables go to a folder of this machine, which a cluster cannot share")
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="spark-"))
    return _own_dir[0]


#: Texts that a Python function gets at a time.
TEXTS_AT_ONCE = 1000
#: Bytes of one row group of a table whose rows are megabytes: Parquet's writer holds a group, and Spark reads a whole one at once.
GROUP_BYTES = 16_000_000


class Scratch:
    """A folder of intermediate tables for one run of an operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str, codec: str = "snappy", batch: int | None = None, wide: bool = False) -> DataFrame:
        """Write ``df`` and return the table that reads it back. ``batch`` is the most rows that a Python function in it gets at a time: of texts, JVM and Python each hold a batch.

        ``wide`` tells that rows may be megabytes: the size of a row group is then looked at after each row, by default after 100 of them.
        """
        path = f"{self.root}/{name}"
        before = {k: self.spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")}
        for key, most in before.items():
            if batch and not 0 < int(most) <= batch:
                self.spark.conf.set(key, str(batch))
        try:
            writer = df.write.option("compression", codec)
            if wide:
                writer = writer.option("parquet.block.size", GROUP_BYTES).option("parquet.page.size.row.check.min", 1)
            writer.parquet(path)
        finally:
            for key, most in before.items():
                self.spark.conf.set(key, most)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
