"""Event-time windows and incremental telemetry with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.perf import RECORD
from weftline.session import shared_folder
from weftline.streaming.sink import END, TableSink


def event_stream(spark: SparkSession, path: str, schema: T.StructType, time_col: str = "ts") -> DataFrame:
    """A stream of Parquet files with a real timestamp as event time."""
    return spark.readStream.schema(schema).parquet(path).withColumn(time_col, F.col(time_col).cast("timestamp"))


def tumbling(events: DataFrame, length: str, keys: list[str], late: str = "1 hour", time_col: str = "ts", value_col: str = "value") -> DataFrame:
    """Counts and sums by fixed windows; later rows than the watermark allows are dropped in a stream."""
    return _windowed(events.withWatermark(time_col, late), F.window(time_col, length), keys, value_col)


def sliding(events: DataFrame, length: str, step: str, keys: list[str], late: str = "1 hour", time_col: str = "ts", value_col: str = "value") -> DataFrame:
    """As ``tumbling`` with windows that overlap."""
    return _windowed(events.withWatermark(time_col, late), F.window(time_col, length, step), keys, value_col)


def sessions(events: DataFrame, gap: str, keys: list[str], late: str = "1 hour", time_col: str = "ts", value_col: str = "value") -> DataFrame:
    """Windows that end after a gap without events of the same keys."""
    return _windowed(events.withWatermark(time_col, late), F.session_window(time_col, gap), keys, value_col)


def _windowed(events: DataFrame, window, keys: list[str], value_col: str) -> DataFrame:
    out = events.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value_col).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "total")


def step_totals_stream(spark: SparkSession, path: str) -> DataFrame:
    """Running totals of performance spans as log files arrive."""
    lines = spark.readStream.text(path).select(F.from_json("value", RECORD).alias("r")).where("r.type = 'span'").select("r.*")
    return step_totals_of(lines)


def step_totals_of(spans: DataFrame) -> DataFrame:
    """Time, number and first start of each step by run and source."""
    return spans.groupBy("run_id", "datasource_id", "name").agg(F.sum("duration_ms").alias("total_ms"), F.count("span_id").alias("span_count"), F.min("t_start_ms").alias("first_start_ms"))


def run_states(starts: DataFrame, ends: DataFrame, timeout: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """A row a run as soon as its end comes, or when none has come within ``timeout``; an end without a start too.

    starts: (run_id, start_dt, operation), ends: (run_id, end_dt, status, run_ms). Both
    sides wait in state until the watermark says that no match can come any more.
    """
    s = starts.withWatermark("start_dt", late)
    e = ends.withColumnRenamed("run_id", "_run").withWatermark("end_dt", late)
    within = F.expr(f"run_id = _run and end_dt >= start_dt and end_dt <= start_dt + interval {timeout}")
    closed = F.when(F.col("_run").isNull(), "timeout").when(F.col("run_id").isNull(), "no start").otherwise("end")
    unknown = lambda c: F.coalesce(c, F.lit("unknown")).alias(c)
    real = F.coalesce("start_dt", "end_dt") < F.lit(END)  # rows without a key come out at once, the end of the stream among them
    return s.join(e, within, "full_outer").where(real).select(F.coalesce("run_id", "_run").alias("run_id"), "start_dt", "end_dt", unknown("operation"), unknown("status"), "run_ms", closed.alias("closed_by"))


def run_available(stream: DataFrame, name: str, mode: str = "complete", checkpoint: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """Run a stream over all that is there now into a table of its own in the folder ``checkpoint`` (one in the shared folder by default), and return it."""
    spark = stream.sparkSession
    out = TableSink(spark, f"{checkpoint or shared_folder(spark)}/{name}", mode, keys).run(stream)
    out.createOrReplaceTempView(name)
    return out


def index_new(stream: DataFrame, index_batch, checkpoint: str):
    """Hand every micro-batch to ``index_batch(rows, batch_id)``; batches are repeated after a failure, so it must be idempotent (keyed by content hash)."""
    return stream.writeStream.foreachBatch(index_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
