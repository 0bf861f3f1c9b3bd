"""A streaming source that follows a growing table by its ids, and a log that each batch is written to once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import DataStreamWriter

from palimpsest.sources.shared import delete


class _Part(InputPartition):
    def __init__(self, path: str, after: int, upto: int):
        self.path, self.after, self.upto = path, after, upto


class CursorSource(DataSource):
    """``spark.readStream.format("cursor").schema(...).option("path", folder)``: rows of the folder's Parquet files whose id is over the
    cursor, as files come in.  The offset is the largest id seen, so a restarted query goes on behind its last batch.

    Options: ``id`` (column, default event_id), ``since_id`` (start behind this id, default 0 as nothing;
    ids are positive, or start at ``since_id`` -1), ``where_<column>`` (equality filters).  A poll opens only the
    footers of files it has not seen; a batch reads only files and row groups that hold its ids, one task a file.
    Rows without an id, and rows that come with an id below the cursor, are not seen, as with any cursor by id."""

    @classmethod
    def name(cls) -> str:
        return "cursor"

    def schema(self) -> str:
        raise ValueError("the cursor source needs a schema")

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _CursorReader(schema, dict(self.options))


class _CursorReader(DataSourceStreamReader):
    def __init__(self, schema, options: dict):
        self.names, self.kinds = schema.names, schema
        self.path, self.id = options["path"], options.get("id", "event_id")
        self.start = int(options.get("since_id", 0))
        self.equal = {k[6:]: v for k, v in options.items() if k.startswith("where_")}
        self.seen: dict[str, tuple[int, int] | None] = {}  # file -> smallest and largest id

    def _files(self) -> dict[str, tuple[int, int] | None]:
        fs, root = pafs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (pafs.LocalFileSystem(), self.path)
        for f in fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)):
            if f.path in self.seen or not f.is_file or not f.path.endswith(".parquet") or any(p[:1] in "._" for p in f.path[len(root) :].split("/") if p):
                continue
            meta, ends = pq.read_metadata(f.path, filesystem=fs), []
            at = meta.schema.names.index(self.id)
            for g in range(meta.num_row_groups):
                s = meta.row_group(g).column(at).statistics
                if s is not None and s.has_min_max:
                    ends += [s.min, s.max]
                elif s is None or s.null_count != meta.row_group(g).num_rows:  # no statistics: the column itself
                    ids = pq.ParquetFile(f.path, filesystem=fs).read_row_group(g, [self.id]).column(0).drop_null()
                    ends += [min(ids.to_pylist()), max(ids.to_pylist())] if len(ids) else []
            self.seen[f.path] = (min(ends), max(ends)) if ends else None
        return self.seen

    def initialOffset(self) -> dict:  # noqa: N802
        return {"since_id": self.start}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"since_id": max((r[1] for r in self._files().values() if r), default=self.start)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        after, upto = start["since_id"], end["since_id"]
        return [_Part(p, after, upto) for p, r in sorted(self._files().items()) if r and r[1] > after and r[0] <= upto] or [_Part("", after, upto)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs = pafs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else pafs.LocalFileSystem()
        own = (ds.field(self.id) > partition.after) & (ds.field(self.id) <= partition.upto)
        data = ds.dataset(partition.path, filesystem=fs, format="parquet")
        for k, v in self.equal.items():
            own &= ds.field(k) == pa.scalar(v).cast(data.schema.field(k).type)
        from pyspark.sql.pandas.types import to_arrow_schema

        want = to_arrow_schema(self.kinds)
        for batch in data.to_batches(columns=self.names, filter=own, batch_size=8192):
            if batch.num_rows:
                columns = [c.cast(f.type) if not pa.types.is_timestamp(f.type) else _stamp(c, f.type) for c, f in zip(batch.columns, want)]
                yield pa.RecordBatch.from_arrays(columns, schema=want)


def _stamp(column: pa.Array, kind: pa.DataType) -> pa.Array:
    """Times without a zone are taken as UTC."""
    plain = column.cast(pa.timestamp("us", column.type.tz))
    return plain.cast(pa.int64()).cast(pa.timestamp("us")).cast(kind) if kind.tz is None else plain.cast(pa.int64()).cast(kind)


class EventLog:
    """Micro-batches written once each, whatever is replayed.

    A batch's rows go to a folder by its number, which a replay overwrites; the batch counts once its row stands in the
    ledger, which is written last.  Readers see counted batches only.  ``most`` bounds the rows of a file,
    ``seconds`` how long rows wait.  A log belongs to one checkpoint: another needs another folder."""

    def __init__(self, spark: SparkSession, folder: str, most: int = 100_000):
        self.spark, self.folder, self.most = spark, folder.rstrip("/"), most

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def write(self, batch: DataFrame, number: int) -> None:
        """For ``foreachBatch``; a batch that is in the ledger is left alone."""
        ledger = f"{self.folder}/ledger/batch={number}"
        if self._exists(f"{ledger}/_SUCCESS"):
            return
        rows = f"{self.folder}/rows/batch={number}"
        batch.write.mode("overwrite").option("maxRecordsPerFile", self.most).parquet(rows)
        n = self.spark.read.schema(batch.schema).parquet(rows).count()  # footers alone
        self.spark.createDataFrame([(n,)], "n_rows long").coalesce(1).write.mode("overwrite").parquet(ledger)

    def sink(self, stream: DataFrame, checkpoint: str, seconds: int = 5) -> DataStreamWriter:
        """A writer of the stream, to be started."""
        return stream.writeStream.foreachBatch(self.write).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds")

    def ledger(self) -> DataFrame:
        """(batch, n_rows) of the counted batches."""
        own = self.spark.read.schema("n_rows long, batch long")
        return own.parquet(f"{self.folder}/ledger") if self._exists(f"{self.folder}/ledger") else self.spark.createDataFrame([], "batch long, n_rows long")

    def read(self, schema) -> DataFrame:
        """The rows of all counted batches, with their batch."""
        if not self._exists(f"{self.folder}/rows"):
            return self.spark.createDataFrame([], schema).withColumn("batch", F.lit(0).cast("long"))
        kind = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        every = self.spark.read.schema(f"{kind}, batch long").parquet(f"{self.folder}/rows")
        return every.join(F.broadcast(self.ledger().select("batch")), "batch", "left_semi")  # a row per batch

    def drop(self) -> None:
        delete(self.spark, self.folder)
