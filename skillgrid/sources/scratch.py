"""Written intermediate tables.

They go to the folder that the session names in ``spark.checkpoint.dir`` (a shared one on a
cluster), as Parquet, so that a lost executor never loses them.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a new one for a local session that names none, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="skillgrid-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


PER_TASK = 10_000  # rows that a task writes at least, beyond one task for each core


class Scratch:
    """Tables that are written, read back and dropped when no later step needs them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
        self.count = 0
        self.kept: dict[int, tuple[DataFrame, str]] = {}  # frames are held, so that no other gets the id of one

    def keep(self, df: DataFrame, about: int | None = None) -> DataFrame:
        """Write ``df`` and read it back: the lineage ends in shared files.

        ``about`` is a rough number of its rows, where one is known: then no more tasks write than there are cores or
        ten thousands of rows, so that a small table isn't scattered over a file for each shuffle partition.
        """
        path = f"{self.base}/{self.count}"
        self.count += 1
        if about is not None:
            df = df.coalesce(max(self.spark.sparkContext.defaultParallelism, -(-about // PER_TASK)))
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.kept[id(out)] = out, path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table of ``keep`` that no later step reads; other frames are left alone."""
        _, path = self.kept.pop(id(df), (None, None))
        if path:
            hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)

    def clear(self) -> None:
        """Delete all tables of ``keep``: their results are written elsewhere, and nothing reads them any more."""
        for df, _ in list(self.kept.values()):
            self.drop(df)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.clear()
