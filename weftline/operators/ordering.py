"""Order over whole tables without gathering them: numbering, top rows with ties, latest groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import written

_WITHIN = 1 << 33  # what monotonically_increasing_id leaves to a partition


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Rows with their place from 0 in an order over the whole table.

    The rows are dealt by ranges of the order, sorted there and written, so each keeps its
    place within its range; the numbers of the ranges before it, a row a range, make it
    the place in the table. Rows that tie in all of the order have some order. A null is a
    value like others here, so where many rows lack the first column, the next ones spread them.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    kept = written(ranged)
    part = F.floor(F.col("_at") / _WITHIN)
    counts = kept.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = counts.select("_part", "_first", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row a range
    placed = kept.join(before, part == F.col("_part"))
    return placed.withColumn(name, F.col("_before") + F.col("_at") - F.col("_first")).drop("_at", "_part", "_first", "_before")


def _reaches(order: list[tuple[str, bool]], last) -> Column:
    """Whether a row stands no later than ``last``. order: (column, descending); nulls come last."""
    out, tied = F.lit(False), F.lit(True)
    for (name, descending), value in zip(order, last, strict=True):
        c = F.col(name)
        if value is None:
            before = c.isNotNull()
        else:
            before = F.coalesce((c > F.lit(value)) if descending else (c < F.lit(value)), F.lit(False))
        out, tied = out | (tied & before), tied & c.eqNullSafe(F.lit(value))
    return out | tied


def top_with_ties(rows: DataFrame, order: list[tuple[str, bool]], k: int) -> DataFrame:
    """The first k rows of an order and all that tie with the last of them. order: (column, descending); nulls last.

    Two passes, neither of which sorts the table: a distributed top-k finds the k-th row's
    values, and a filter keeps what reaches them. Fewer than k rows are all kept; NaN is
    the largest number.
    """
    if k <= 0:
        return rows.limit(0)
    sort = [F.desc_nulls_last(n) if d else F.asc_nulls_last(n) for n, d in order]
    names = [n for n, _ in order]
    last = rows.select(*names).orderBy(*sort).offset(k - 1).limit(1).collect()  # one row
    return rows.where(_reaches(order, last[0])) if last else rows


def ranked_with_ties(rows: DataFrame, keys: list[str], order: list[tuple[str, bool]], k: int, name: str = "rank") -> DataFrame:
    """The same within each group, with ranks; each task keeps its own first rows before anything is shuffled."""
    sort = [F.desc_nulls_last(n) if d else F.asc_nulls_last(n) for n, d in order]
    return rows.withColumn(name, F.rank().over(Window.partitionBy(*keys).orderBy(*sort))).where(F.col(name) <= k)


def latest_groups(rows: DataFrame, group: str, time: str, k: int) -> DataFrame:
    """All rows of the k groups with the latest times; ties go to the smaller group, rows without a group or time count last."""
    last = rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.max(time).alias("_last"))
    chosen = last.orderBy(F.desc_nulls_last("_last"), group).limit(k).select(F.col(group).alias("_group"))
    return rows.join(chosen, F.col(group) == F.col("_group"), "left_semi")
