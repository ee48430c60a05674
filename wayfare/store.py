"""Written tables: what the iterative operators cut their lineage with, and versioned snapshots."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; one of this machine only in local mode without it (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_wayfare_store", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = spark._wayfare_store = f"file://{tempfile.mkdtemp(prefix='wayfare-')}"
    return at.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once and read it back. A lost executor costs a task, not the lineage of all rounds."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Snapshots:
    """Immutable versions of named tables in one folder; readers keep the version that they opened."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def publish(self, name: str, df: DataFrame) -> int:
        version = (self.latest(name) or 0) + 1
        df.write.parquet(f"{self.root}/{name}/v{version:012d}")
        return version

    def latest(self, name: str) -> int | None:
        """The greatest version whose write has ended."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        top = hadoop.Path(f"{self.root}/{name}")
        fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(top):
            return None
        done = [s.getPath() for s in fs.listStatus(top) if fs.exists(hadoop.Path(s.getPath(), "_SUCCESS"))]
        return max((int(p.getName()[1:]) for p in done), default=None)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        at = version or self.latest(name)
        if at is None:
            raise LookupError(f"no version of {name}")
        return self.spark.read.parquet(f"{self.root}/{name}/v{at:012d}")
