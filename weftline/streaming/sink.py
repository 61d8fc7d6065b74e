"""A durable table that a stream writes batch by batch, and the end of a stream.

Each micro-batch goes into a folder of its number, replaced as a whole if the batch is
repeated after a failure, and a marker written last makes it count: whatever breaks off,
a reader sees each batch once. The stream's checkpoint stands beside the table, so a
restart goes on where the last one ended.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The event time of the row that ends a stream: later than any other, and than any watermark's delay.
END = datetime(9000, 1, 1, tzinfo=timezone.utc)


def _folder(spark: SparkSession, path: str):
    made = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return made.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), made


class TableSink:
    """A table under a folder, written by one stream.

    mode ``append``: a row is written once and stays (windows that the watermark has
    closed). ``update``: the latest row of each of ``keys`` counts. ``complete``: the last
    batch is the result.
    """

    def __init__(self, spark: SparkSession, root: str, mode: str = "append", keys: list[str] | None = None):
        if mode not in ("append", "update", "complete") or (mode == "update") != bool(keys):
            raise ValueError("append and complete have no keys, update asks for them")
        self.spark, self.root, self.mode, self.keys = spark, root.rstrip("/"), mode, keys or []

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """What ``foreachBatch`` calls; the same batch again replaces itself."""
        rows.write.mode("overwrite").parquet(f"{self.root}/rows/batch={batch_id}")
        self.spark.createDataFrame([(datetime.now(timezone.utc),)], "at timestamp").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/commits/batch={batch_id}")
        if self.mode == "complete" and batch_id:
            files, path = _folder(self.spark, f"{self.root}/rows/batch={batch_id - 2}")  # the one before may still be read
            files.delete(path, True)

    def run(self, stream: DataFrame) -> DataFrame:
        """Take in all that is there now, and give the table."""
        writer = stream.writeStream.foreachBatch(self.write).outputMode(self.mode).option("checkpointLocation", f"{self.root}/checkpoint")
        writer.trigger(availableNow=True).start().awaitTermination()
        return self.table(stream.schema)

    def table(self, schema: T.StructType) -> DataFrame:
        """The rows of all batches that were written to their end."""
        try:
            commits = self.spark.read.schema("at timestamp, batch bigint").parquet(f"{self.root}/commits").select("batch")
            held = self.spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{self.root}/rows")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], schema)
            raise
        if self.mode == "complete":
            commits = commits.agg(F.max("batch").alias("batch"))
        rows = held.join(commits, "batch", "left_semi")
        if self.mode == "update":
            others = [c for c in schema.names if c not in self.keys]
            rows = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*others), "batch").alias("_last")).select(*self.keys, "_last.*")
        return rows.select(*schema.names)


class Closing:
    """Lets a stream with a watermark end, so that what its state still holds comes out.

    ``of`` unites events with a folder that stays empty until ``close`` puts one row with
    the latest of times in it; the watermark passes everything and all windows, sessions
    and joins that wait are written. The row itself never comes out. A closed stream
    drops whatever comes later.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.path = spark, f"{root.rstrip('/')}/end"
        files, path = _folder(spark, self.path)
        files.mkdirs(path)

    def of(self, events: DataFrame, time_col: str) -> DataFrame:
        # state keeps its schema only if columns may be null with and without the row that ends the stream
        sure = {f.name for f in events.schema.fields if not f.nullable and f.name != time_col}
        events = events.select(*(F.when(F.col(time_col).isNotNull(), F.col(c)).alias(c) if c in sure else c for c in events.columns))
        end = self.spark.readStream.schema("at timestamp").parquet(self.path).select(F.col("at").alias(time_col))
        return events.unionByName(end, allowMissingColumns=True)

    def close(self) -> None:
        self.spark.createDataFrame([(END,)], "at timestamp").coalesce(1).write.mode("append").parquet(self.path)


def finished(spark: SparkSession, root: str, plan, keys: list[str] | None = None) -> DataFrame:
    """All rows of a stream over tables that don't grow any more: run, close, run to the end. plan: Closing -> stream."""
    closing, sink = Closing(spark, root), TableSink(spark, root)
    stream = plan(closing)
    sink.run(stream)
    closing.close()
    return sink.run(stream)
