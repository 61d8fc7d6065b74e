"""Queries over databases' own catalogs: the given tables' schemas as a database, introspected by its dialect."""

from __future__ import annotations

import os
import tempfile
from contextlib import closing

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import catalog
from weftline.plans.book import Book, table
from weftline.plans.metadata import TABLES, values
from weftline.sources import introspection

BOOK = Book()

# Keys of the given tables: table, primary key, foreign keys (column, table, its column), an indexed column.
KEYS = [
    ("region", "r_regionkey", [], ""),
    ("nation", "n_nationkey", [("n_regionkey", "region", "r_regionkey")], ""),
    ("customer", "c_custkey", [("c_nationkey", "nation", "n_nationkey")], "c_mktsegment"),
    ("supplier", "s_suppkey", [("s_nationkey", "nation", "n_nationkey")], ""),
    ("part", "p_partkey", [], "p_brand"),
    ("orders", "o_orderkey", [("o_custkey", "customer", "c_custkey")], "o_orderdate"),
    ("lineitem", "", [("l_orderkey", "orders", "o_orderkey"), ("l_partkey", "part", "p_partkey"), ("l_suppkey", "supplier", "s_suppkey")], "l_shipdate"),
]
TYPES = {"bigint": "bigint", "int": "integer", "double": "double", "timestamp": "timestamp", "timestamp_ntz": "timestamp"}


def statements(spark: SparkSession, sf_dir: str) -> str:
    """Statements that make the given tables' schemas, with their keys, indexes and a view of each keyed table."""
    known = {t: (key, foreign, index) for t, key, foreign, index in KEYS}
    out = []
    for t in [*known, *(t for t in TABLES if t not in known)]:
        key, foreign, index = known.get(t, ("", [], ""))
        lines = [f"{f.name} {TYPES.get(f.dataType.simpleString(), 'varchar')}" for f in table(spark, sf_dir, t).schema.fields]
        lines += [f"primary key ({key})"] if key else []
        lines += [f"foreign key ({c}) references {to} ({own})" for c, to, own in foreign]
        out.append(f"create table {t} ({', '.join(lines)})")
        out += [f"create index {t}_by_{index} on {t} ({index})"] if index else []
        out += [f"create view {t}_keys as select {key} from {t}"] if key else []
    return ";\n".join(out) + ";"


SHOWN = [(t, key, ",".join(sorted(f"{c}>main.{to}.{own}" for c, to, own in foreign)), index) for t, key, foreign, index in KEYS]
SQL = f"""
with known as (select * from {values(SHOWN)} v(t, p, f, i)), columns as (
  select table_name, string_agg(column_name, ',' order by ordinal_position) as columns from information_schema.columns
  where table_schema = 'main' and table_name in ({", ".join(f"'{t}'" for t in TABLES)}) group by 1)
select table_name, 'table' as kind, columns, coalesce(p, '') as primary_key, '' as unique_keys, coalesce(f, '') as foreign_keys, coalesce(i, '') as indexes from columns left join known on t = table_name
union all select t || '_keys', 'view', p, '', '', '', '' from known where p <> ''
"""


def shown(tables: DataFrame) -> DataFrame:
    listed = lambda c: F.coalesce(F.array_join(F.array_sort(c), ","), F.lit(""))
    mapped = F.transform("foreign_keys", lambda k: F.array_join(F.transform(k["mapping"], lambda m: F.concat(m["from_column"], F.lit(">"), k["referenced_table"], F.lit("."), m["to_column"])), "+"))
    return tables.select(
        F.col("name").alias("table_name"),
        "kind",
        F.array_join(F.transform("columns", lambda c: c["name"]), ",").alias("columns"),
        F.coalesce(F.array_join("primary_key", ","), F.lit("")).alias("primary_key"),
        listed(F.transform("unique_keys", lambda k: F.array_join(k["columns"], "+"))).alias("unique_keys"),
        listed(mapped).alias("foreign_keys"),
        listed(F.transform("indexes", lambda k: F.array_join(k["columns"], "+"))).alias("indexes"),
    )


@BOOK.add(SQL)
def sqlite_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole model of a SQLite file, which only the driver reads."""
    import sqlite3

    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "given.db")
        with closing(sqlite3.connect(path)) as c:
            c.executescript(statements(spark, sf_dir))
        return shown(catalog.assembled_tables(**introspection.components(spark, "sqlite", introspection.sqlite_reader(spark, path))))


@BOOK.add(SQL)
def duckdb_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same model of a DuckDB file, by its own catalog queries."""
    import duckdb

    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "given.duckdb")
        with duckdb.connect(path) as c:
            c.execute(statements(spark, sf_dir))
        return shown(catalog.assembled_tables(**introspection.components(spark, "duckdb", introspection.duckdb_reader(spark, path))))
