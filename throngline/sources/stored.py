"""Steps that are computed once and kept as Parquet in the shared folder of the session."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a temporary one on a local master, an error elsewhere."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp")))
    return sc.getCheckpointDir()


class Steps:
    """Tables of one operator call. Their size is known to the planner, and a lost executor costs a reread.

    `drop` deletes those that no later step reads, the others go when the session's JVM ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/steps-{uuid.uuid4().hex}"
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        place = self._path(self.folder)
        self._files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._files.deleteOnExit(place)

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            self._files.delete(self._path(f"{self.folder}/{name}"), True)
