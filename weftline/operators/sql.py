"""SQL pass-through behind a read-only gate; Spark's own parser decides what a statement is."""

from __future__ import annotations

import re
import uuid
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.session import written

READ_ONLY, WRITE, UNKNOWN = "READ_ONLY", "WRITE", "UNKNOWN"
# How a read-only statement may begin, and words that make one a write anywhere outside strings and comments.
STARTS = "SELECT WITH EXPLAIN SHOW DESCRIBE VALUES".split()
WRITES = (
    "INSERT UPDATE DELETE MERGE REPLACE UPSERT CREATE ALTER DROP TRUNCATE RENAME GRANT REVOKE BEGIN COMMIT ROLLBACK SAVEPOINT RELEASE SET USE COPY LOAD UNLOAD "
    "VACUUM ANALYZE OPTIMIZE REFRESH CALL EXEC EXECUTE INDEX SEQUENCE CONSTRAINT LOCK INTO"
).split()
SENT = 500_000  # rows of a recursion's level that Spark may broadcast
QUIET = re.compile(r"'(?:''|\\.|[^'])*'|\"(?:\"\"|[^\"])*\"|`(?:``|[^`])*`|--[^\n]*|/\*.*?\*/", re.S)


def classify(sql: str) -> str:
    """READ_ONLY, WRITE or (without any statement) UNKNOWN; strings, quoted names and comments don't count."""
    bare = QUIET.sub(lambda m: " " if m[0][:2] in ("--", "/*") else " x ", sql or "")
    statements = [s for s in bare.split(";") if s.strip()]
    if not statements:
        return UNKNOWN
    words = re.findall(r"[A-Za-z_]\w*", statements[0].upper())
    if len(statements) > 1 or not words or words[0] not in STARTS or set(words) & set(WRITES):
        return WRITE
    return READ_ONLY


def classified(statement: Column) -> Column:
    """The kind of each statement of a column, such as a query log's; null counts as empty."""
    @F.pandas_udf("string")
    def kinds(said: pd.Series) -> pd.Series:
        return said.map(lambda s: classify(s or ""))

    return kinds(statement)


def is_command(spark: SparkSession, sql: str) -> bool:
    """Whether Spark's parser sees a statement that changes something (a second gate)."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    name = plan.getClass().getSimpleName()
    return bool(re.search("Insert|Create|Drop|Alter|Delete|Update|Merge|Truncate|Set|Cache|Load|Call|Replace", name))


def run_sql(spark: SparkSession, sql: str, params: dict | list | None = None, read_only: bool = True) -> DataFrame:
    """The statement's rows; a statement that isn't read-only raises PermissionError unless ``read_only`` is off."""
    if read_only and (classify(sql) != READ_ONLY or is_command(spark, sql.rstrip().rstrip(";"))):
        raise PermissionError("only read-only statements are allowed")
    return spark.sql(sql.rstrip().rstrip(";"), args=params) if params else spark.sql(sql.rstrip().rstrip(";"))


def run_recursive(spark: SparkSession, first: str, next_rows: str, levels: int = 100) -> DataFrame:
    """The rows of a recursion by UNION ALL: those of ``first``, and of ``next_rows`` over each level, which it names ``{level}``.

    Spark's own recursive statements end at a million rows and may broadcast a table anew
    at every level. Here each level is written, and one of more than ``SENT`` rows is joined
    by a shuffle, so what goes through the driver is bounded whatever the number of rows. More levels than ``levels`` raise, as there.
    """
    found = [written(run_sql(spark, first))]
    schema = found[0].schema
    while not found[-1].isEmpty():
        if len(found) > levels:
            raise RecursionError(f"no end after {levels} levels")
        name = f"level_{uuid.uuid4().hex}"
        level = found[-1] if found[-1].count() <= SENT else found[-1].hint("merge")
        level.createTempView(name)
        try:
            rows = run_sql(spark, next_rows.format(level=name)).toDF(*schema.names)
            found.append(written(rows.select(*(F.col(f"`{f.name}`").cast(f.dataType) for f in schema.fields))))
        finally:
            spark.catalog.dropTempView(name)
    return reduce(DataFrame.union, found)
