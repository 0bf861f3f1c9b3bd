"""The folder that the driver and all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` or the context's checkpoint folder.  Where none is set, a local master (tests) gets a
    temporary one; on a cluster that would scatter files over machines, so it is an error."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    kept = spark.sparkContext._jsc.sc().getCheckpointDir()
    if kept.isDefined():
        return kept.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder, wherever it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """Writes in the block free the shuffle files that they have read."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Scratch:
    """Tables that an operator needs only until its result is stored: their folder in the shared one goes when the block ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.n = spark, 0
        self.folder = f"{shared_dir(spark)}/palimpsest/scratch-{uuid.uuid4().hex}"

    def stored(self, df: DataFrame, what: str) -> DataFrame:
        """Write as Parquet and read back: lineage ends there."""
        self.n += 1
        path = f"{self.folder}/{self.n}-{what}"
        with freeing(self.spark):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        delete(self.spark, self.folder)


def stored(df: DataFrame, what: str) -> DataFrame:
    """As Scratch.stored, for a result that stays."""
    path = f"{shared_dir(df.sparkSession)}/palimpsest/{what}-{uuid.uuid4().hex}"
    with freeing(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
