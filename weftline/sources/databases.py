"""Databases: JDBC with partitioned reads, and SQLite files by a Python data source."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# JDBC url forms and default ports of the dialects.
URLS = {
    "postgresql": ("jdbc:postgresql://{host}:{port}/{database}", 5432),
    "mysql": ("jdbc:mysql://{host}:{port}/{database}", 3306),
    "mssql": ("jdbc:sqlserver://{host}:{port};databaseName={database}", 1433),
    "clickhouse": ("jdbc:clickhouse://{host}:{port}/{database}", 8123),
    "snowflake": ("jdbc:snowflake://{host}:{port}/?db={database}", 443),
    "bigquery": ("jdbc:bigquery://{host}:{port};ProjectId={database}", 443),
    "athena": ("jdbc:athena://{host}:{port};Catalog={database}", 443),
    "duckdb": ("jdbc:duckdb:{database}", 0),
    "sqlite": ("jdbc:sqlite:{database}", 0),
}


@dataclass
class Connection:
    """Where a database is and how to read it."""

    dialect: str
    host: str = "localhost"
    port: int | None = None
    database: str = ""
    options: dict[str, str] = field(default_factory=dict)

    def url(self) -> str:
        if self.dialect not in URLS:
            raise ValueError(f"unknown dialect {self.dialect}")
        form, port = URLS[self.dialect]
        return form.format(host=self.host, port=self.port or port, database=self.database)


def read_table(spark: SparkSession, connection: Connection, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 16) -> DataFrame:
    """A table over JDBC; with an integer key and its bounds it is read in parallel ranges. Columns are lower-cased."""
    reader = spark.read.format("jdbc").options(url=connection.url(), dbtable=table, fetchsize="10000", **connection.options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions))
    df = reader.load()
    return df.toDF(*[c.lower() for c in df.columns])


class RowRange(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, schema, options):
        self.schema, self.path, self.table, self.parts = schema, options["path"], options["table"], int(options.get("partitions", "4"))

    def _connect(self):
        import sqlite3

        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self):
        with self._connect() as c:
            ordered = c.execute("select 1 from pragma_table_list where schema = 'main' and lower(name) = lower(?) and type = 'table' and not wr", (self.table,)).fetchone()
            if not ordered:  # views and tables without row ids are read in one part
                return [RowRange(None, None)]
            low, high = c.execute(f"select min(rowid), max(rowid) from {quoted(self.table)}").fetchone()
        if low is None:
            return [RowRange(0, 0)]
        step = -(-(high - low + 1) // self.parts)
        return [RowRange(s, min(s + step, high + 1)) for s in range(low, high + 1, step)]

    def read(self, partition):
        names = ", ".join(quoted(f.name) for f in self.schema.fields)
        with self._connect() as c:
            if partition.low is None:
                yield from c.execute(f"select {names} from {quoted(self.table)}")
                return
            yield from c.execute(f"select {names} from {quoted(self.table)} where rowid >= ? and rowid < ?", (partition.low, partition.high))


class SqliteSource(DataSource):
    """``spark.read.format("weftline_sqlite").option("path", file).option("table", name)``; ranges of rowid are read in parallel. The file must be reachable from every executor."""

    @classmethod
    def name(cls):
        return "weftline_sqlite"

    def schema(self):
        import sqlite3

        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as c:
            rows = c.execute(f"pragma table_info({quoted(self.options['table'])})").fetchall()
        if not rows:
            raise ValueError(f"no table {self.options['table']}")
        return ", ".join(f"`{r[1].lower()}` {sqlite_type(r[2])}" for r in rows)

    def reader(self, schema):
        return SqliteReader(schema, self.options)


def sqlite_type(declared: str) -> str:
    kind = (declared or "").upper()
    if "INT" in kind:
        return "bigint"
    if any(x in kind for x in ("REAL", "FLOA", "DOUB", "NUMERIC", "DECIMAL")):
        return "double"
    return "binary" if "BLOB" in kind else "string"


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def read_sqlite(spark: SparkSession, path: str, table: str, partitions: int = 4) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("weftline_sqlite").options(path=path, table=table, partitions=str(partitions)).load()
