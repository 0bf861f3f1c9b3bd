"""Tables and shared folders."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Session settings of a write: it frees the shuffle files that it has read, and hands
#: whole texts to Python by the thousand.
_SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder.  Where none is set, a local master (tests) gets a
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


def _written(df: DataFrame, path: str, compression: str = "snappy") -> DataFrame:
    spark = df.sparkSession
    before = {k: spark.conf.get(k, None) for k in _SETTINGS}
    try:
        for k, v in _SETTINGS.items():
            spark.conf.set(k, v)
        df.write.parquet(path, compression=compression)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, what: str, compression: str = "snappy") -> DataFrame:
    """Write to the shared folder as Parquet and read back: lineage ends there."""
    return _written(df, f"{shared_dir(df.sparkSession)}/palimpsest/{what}-{uuid.uuid4().hex}", compression)


class Scratch:
    """Tables that an operator needs only until its result is stored: they lie in a
    folder of their own in the shared folder, which goes when the block ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.n = spark, 0
        self.folder = f"{shared_dir(spark)}/palimpsest/scratch-{uuid.uuid4().hex}"

    def stored(self, df: DataFrame, what: str, compression: str = "snappy") -> DataFrame:
        self.n += 1
        return _written(df, f"{self.folder}/{self.n}-{what}", compression)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
