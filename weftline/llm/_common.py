"""Helpers shared by the training-data operators: durable cuts, block iteration, sizing."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can read: the session's ``spark.checkpoint.dir``.

    Only where neither the setting nor a checkpoint directory exists a temporary folder
    of this machine is made and set, and that only in a local session: on a cluster no
    other machine could read it.
    """
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="weftline-"))
        folder = sc.getCheckpointDir()
    return folder


_made: ContextVar[list[tuple[str, DataFrame]] | None] = ContextVar("weftline_made", default=None)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Later stages start from the files, so a lost executor never makes an expensive
    step run again. The folder goes when the driver's Python ends, or with ``drop``.
    """
    return cut_at(df)[0]


def cut_at(df: DataFrame) -> tuple[DataFrame, str]:
    """``cut``, with the folder."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(drop, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    if (made := _made.get()) is not None:
        made.append((path, out))
    return out, path


def cut_alone(work: Callable[[], DataFrame]) -> DataFrame:
    """``cut`` of what ``work`` gives, unless that is a cut already; the tables that it has cut on its way go then, for only the result reads them."""
    made: list[tuple[str, DataFrame]] = []
    token = _made.set(made)
    try:
        out = work()
        own = next((path for path, df in made if df is out), None)
        if own is None:
            out, own = cut_at(out)
    finally:
        _made.reset(token)
    for path, _ in made:
        if path != own:
            drop(out.sparkSession, path)
    if (outer := _made.get()) is not None:
        outer.append((own, out))
    return out


def drop(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session may have ended first; then the folder is left to the cluster's cleaner
        pass


def partitions(df_or_spark) -> int:
    """Number of shuffle partitions of the session."""
    spark = df_or_spark if isinstance(df_or_spark, SparkSession) else df_or_spark.sparkSession
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hash01(seed: int, *cols) -> F.Column:
    """A seeded uniform value in [0, 1) from columns."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11)).cast("double") / F.lit(float(1 << 53))


def release() -> None:
    """Give freed memory back to the system, so that a worker which waits for its next task keeps little."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not that C library
        pass


def utf8(texts):
    """An Arrow array of strings or bytes as valid strings: bytes that aren't UTF-8 are replaced by U+FFFD, all else stays as it is."""
    import pyarrow as pa

    try:
        return texts.cast(pa.binary()).cast(pa.string())  # checks the bytes
    except pa.ArrowInvalid:
        return pa.array([None if t is None else t.decode(errors="replace") for t in texts.cast(pa.binary()).to_pylist()], pa.string())


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose rows reach Python in Arrow batches of about BATCH_BYTES, where the session names no limit of its own.

    A batch is held by the JVM and by the worker at once, so this bounds a task's memory
    on both sides; the limit is a setting of the session.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_LIMIT, "1").rstrip("b") == "1":  # what stands for unset must be a valid limit
        conf.set(BATCH_LIMIT, BATCH_BYTES)
    return df


def blocks(batch, column: str, limit: int):
    """Slices of an Arrow batch of at most about ``limit`` bytes of a binary or string column; one row at least."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.names.index(column))), 0).to_pylist()
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            release()  # a worker's memory doesn't add up over blocks
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)
    release()


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))
