"""Parquet footers as rows: the files' metadata only, never their data pages."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ROWS = "file_name string, row_group int, column_id int, column_name string, physical_type string, num_values bigint, stats_min string, stats_max string, null_count bigint"
FILES = 64  # of a task
#: Stores that Python's file systems open at any position, by scheme.
SEEKABLE = {"": "", "file": "", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "gcs": "gs", "hdfs": "hdfs"}


def described(name: str, source) -> Iterator[tuple]:
    """A row for each row group and column of one file; only its end is read."""
    import pyarrow.parquet as pq

    meta = pq.ParquetFile(source).metadata
    for g in range(meta.num_row_groups):
        for i in range(meta.num_columns):
            c = meta.row_group(g).column(i)
            s = c.statistics if c.is_stats_set else None
            low, high = (str(s.min), str(s.max)) if s is not None and s.has_min_max else (None, None)
            yield name, g, i, c.path_in_schema, c.physical_type, c.num_values, low, high, s.null_count if s is not None and s.has_null_count else None


def opened(path: str):
    """A file of a store that Python can seek in."""
    from pyarrow import fs

    parts = urlparse(path)
    scheme = SEEKABLE[parts.scheme]
    if not scheme:
        return fs.LocalFileSystem().open_input_file(parts.path)
    store, name = fs.FileSystem.from_uri(f"{scheme}://{parts.netloc}{parts.path}")
    return store.open_input_file(name)


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class FooterReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = json.loads(options["files"])

    def partitions(self) -> list[InputPartition]:
        return [Files(self.paths[k : k + FILES]) for k in range(0, len(self.paths), FILES)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            with opened(path) as source:
                yield from described(path.rsplit("/", 1)[-1], source)


class FooterSource(DataSource):
    """``parquet_footers``: the footers of the files that the option ``files`` lists as JSON, some files a task."""

    @classmethod
    def name(cls) -> str:
        return "parquet_footers"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> DataSourceReader:
        return FooterReader(self.options)


def row_groups(spark: SparkSession, path: str) -> DataFrame:
    """A row for each row group and column of the files under a path or glob.

    Spark lists the files; tasks seek to their ends, so their size doesn't matter. Only
    in a store that Python can't seek in are whole files loaded, up to 2 GB each.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    paths = sorted(r.path for r in files.select("path").collect())  # the listing, without any content
    if any(urlparse(p).scheme not in SEEKABLE for p in paths):
        return _whole(files)
    spark.dataSource.register(FooterSource)
    return spark.read.format("parquet_footers").option("files", json.dumps(paths)).load()


def _whole(files: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [r for name, content in zip(frame["name"], frame["content"], strict=True) for r in described(name, io.BytesIO(content))]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in ROWS.split(", ")])

    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").mapInPandas(run, ROWS)


def holding(groups: DataFrame, column: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """(file_name, row_group) of the row groups that may hold numbers of a column within bounds, by their zone maps.

    A group without statistics may hold anything; one of nulls only holds nothing.
    """
    least, most = F.col("stats_min").try_cast("double"), F.col("stats_max").try_cast("double")
    inside = (F.lit(True) if low is None else most >= low) & (F.lit(True) if high is None else least <= high)
    empty = F.coalesce(F.col("null_count") == F.col("num_values"), F.lit(False))
    return groups.where((F.col("column_name") == column) & ~empty & F.coalesce(inside, F.lit(True))).select("file_name", "row_group").distinct()


def ranges(groups: DataFrame) -> DataFrame:
    """True extremes of each numeric column over all files and row groups, with its values and nulls."""
    number = lambda c: F.col(c).try_cast("double")
    return groups.groupBy("column_name").agg(F.sum("num_values").alias("num_values"), F.sum("null_count").alias("null_count"), F.min(number("stats_min")).alias("least"), F.max(number("stats_max")).alias("most"))


def columns(groups: DataFrame) -> DataFrame:
    """A row for each file and column: values, row groups, the first group's statistics and the true null count."""
    first = lambda c: F.min_by(c, "row_group")
    return groups.groupBy("file_name", "column_id", "column_name", "physical_type").agg(
        F.sum("num_values").alias("num_values"),
        F.count("*").alias("row_groups"),
        first("stats_min").alias("first_stats_min"),
        first("stats_max").alias("first_stats_max"),
        F.sum("null_count").alias("null_count"),
    )
