"""Tables in the folder that executors share, which cut lineage between the stages of a plan."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver share: ``spark.checkpoint.dir``. Only where the session names none (tests, one machine) a temporary folder is made and set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        context = spark.sparkContext._jsc.sc()
        found = context.getCheckpointDir()
        if found.isDefined():
            at = found.get()
        else:
            own = tempfile.mkdtemp(prefix="millrace-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            at = f"file://{own}"
            spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


#: Spark drops the shuffle files of a plan when its action ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs no recomputation from the start.

    ``keep(df)`` writes and rereads; the shuffle files behind a table go as soon as it is written. ``drop()`` deletes tables whose last
    reader is done; all others are deleted when the application ends.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.at, self.n = spark, f"{shared_dir(spark)}/millrace/{what}-{uuid.uuid4().hex}", 0
        path, fs = self._files(self.at)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def _files(self, at: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.at}/{self.n}"
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path, fs = self._files(df._scratch)
            fs.delete(path, True)
