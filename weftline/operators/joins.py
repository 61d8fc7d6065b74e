"""Joins that SQL dialects spell differently: as-of, bands, intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICES = 64  # ranges of numeric times


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, left_id: str, values: list[str], tie: str | None = None, max_age: Column | None = None, slice: str | None = "day") -> DataFrame:
    """Each left row with the values of the latest right row of its key at or before it, nulls without one.

    Both sides are merged into one sequence for each key and time slice and the last
    right row is carried forward by a window: the work is that of a sort, where a join
    on the key with an inequality would pair every left row with all earlier right rows.
    A slice (a unit of ``date_trunc``; for numbers a range between quantiles of the right
    side's times; None for one slice) begins with the last right row of the slices before,
    found from one row a key and slice, so a busy key is spread over its slices. A left
    row without key or time finds nothing (null keys aren't equal) and goes past the windows.
    """
    if not isinstance(right.schema[right_time].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        numeric = slice and isinstance(right.schema[right_time].dataType, T.NumericType)
        bounds = sorted(set(right.approxQuantile(right_time, [i / SLICES for i in range(1, SLICES)], 0.25 / SLICES))) if numeric else []  # SLICES numbers
        cut = lambda t: F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= t)) if bounds else F.lit(0)
    else:
        cut = lambda t: F.date_trunc(slice, t) if slice else F.lit(0)
    keyed = " and ".join(f"`{c}` is not null" for c in [*keys, "_time"])
    carried = F.struct(F.col(right_time).alias("_t"), *[F.col(v) for v in values])
    ranked = (F.col(tie) if tie else F.lit(0)).cast("bigint")
    r = right.select(*keys, F.col(right_time).alias("_time"), F.lit(0).alias("_side"), ranked.alias("_tie"), carried.alias("_row")).where(keyed)
    r = r.withColumn("_slice", cut(F.col("_time")))
    ends = r.groupBy(*keys, "_slice").agg(F.max_by("_row", F.struct("_time", "_tie")).alias("_end"))

    l_cols = F.struct(*[F.col(c) for c in left.columns])
    l = left.select(*keys, F.col(left_time).alias("_time"), F.lit(1).alias("_side"), F.col(left_id).cast("bigint").alias("_tie"), l_cols.alias("_left"))  # noqa: E741
    lost, l = l.where(f"not ({keyed})"), l.where(keyed).withColumn("_slice", cut(F.col("_time")))  # noqa: E741
    # slices that either side has, each with the last right row before it
    asked = l.select(*keys, "_slice").distinct().withColumn("_end", F.lit(None).cast(ends.schema["_end"].dataType))
    merged = ends.unionByName(asked).groupBy(*keys, "_slice").agg(F.first("_end", ignorenulls=True).alias("_end"))
    earlier = F.last("_end", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    first = {"_time": F.lit(None).cast(r.schema["_time"].dataType), "_side": F.lit(-1), "_tie": F.lit(0).cast("bigint")}
    starts = merged.withColumns({"_row": earlier, **first}).where("_row is not null").select(r.columns)

    both = r.unionByName(starts).withColumn("_left", F.lit(None).cast(l.schema["_left"].dataType)).unionByName(l.withColumn("_row", F.lit(None).cast(r.schema["_row"].dataType)))
    w = Window.partitionBy(*keys, "_slice").orderBy(F.asc_nulls_first("_time"), "_side", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_found", F.last("_row", ignorenulls=True).over(w)).where("_side = 1").select("_left", "_time", "_found")
    found = found.unionByName(lost.select("_left", "_time", F.lit(None).cast(r.schema["_row"].dataType).alias("_found")))
    taken = [F.col(f"_found.{v}").alias(v) for v in values]
    if max_age is not None:
        fresh = F.col("_time") - F.col("_found._t") <= max_age
        taken = [F.when(fresh, F.col(f"_found.{v}")).alias(v) for v in values]
    return found.select("_left.*", *taken)


def in_bands(rows: DataFrame, value: str, bands: DataFrame, low: str = "low", high: str = "high") -> DataFrame:
    """Rows with the band that holds their value (low <= value < high), for a table of bands that Spark may broadcast by its size."""
    return rows.join(bands, (F.col(value) >= F.col(low)) & (F.col(value) < F.col(high)))


def within(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, seconds: int) -> DataFrame:
    """Pairs of one key whose right time lies in [left time, left time + seconds].

    Time is cut into slices of the given length; a right row meets only the left rows of
    its slice and the one before, so a busy key is spread over its slices.
    """
    slot = lambda t: F.floor(F.unix_timestamp(t.cast("timestamp")) / seconds)
    l = left.withColumn("_slot", F.explode(F.array(slot(F.col(left_time)), slot(F.col(left_time)) + 1)))  # noqa: E741
    r = right.withColumn("_slot", slot(F.col(right_time)))
    end = F.col(left_time) + F.expr(f"interval {seconds} seconds")
    return l.join(r, [key, "_slot"]).where((F.col(right_time) >= F.col(left_time)) & (F.col(right_time) <= end)).drop("_slot")
