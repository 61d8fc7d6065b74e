"""Column profiles, top values, histograms, percentiles and samples; nothing that grows with the data meets in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.stats import cardinality_bucket, exact_distinct, percent, sample_rate
from weftline.functions.text import sample_value
from weftline.session import written

ATOMIC = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)


def profiled_columns(df: DataFrame) -> list[T.StructField]:
    """Columns of atomic types; nested ones have no minimum, maximum or distinct count."""
    return [f for f in df.schema.fields if isinstance(f.dataType, ATOMIC)]


def profile(df: DataFrame, table: str, approximate: bool = False, rsd: float = 0.01) -> DataFrame:
    """A row for each atomic column: counts, distinct count, bucket, percentages, minimum and maximum as text.

    Exact distinct counts are the default, since estimates near a bucket's edge would
    change the bucket. Each column is then grouped by itself, so its scan reads that
    column only and its shuffle moves its distinct values only; everything else comes
    from the groups. ``approximate`` uses one pass of sketches instead.
    """
    fields = profiled_columns(df)
    text = lambda e, f: e.cast("string") if isinstance(f.dataType, (T.StringType, T.IntegralType, T.DateType)) else F.lit(None).cast("string")
    number = lambda e, f: e.cast("double") if isinstance(f.dataType, (T.FractionalType,)) else F.lit(None).cast("double")

    def described(f: T.StructField, c: Column, non_null: Column, rows: Column, distinct: Column) -> list[Column]:
        return [
            F.lit(f.name).alias("column_name"),
            non_null.alias("non_null_count"),
            (rows - non_null).alias("null_count"),
            distinct.alias("distinct_count"),
            text(F.min(c), f).alias("min_text"),
            text(F.max(c), f).alias("max_text"),
            number(F.min(c), f).alias("min_number"),
            number(F.max(c), f).alias("max_number"),
        ]

    if approximate:
        sketched = [(f, F.col(f"`{f.name}`")) for f in fields]
        columns = [F.struct(*described(f, c, F.count(c), F.count("*"), F.approx_count_distinct(c, rsd))) for f, c in sketched]
        gathered = df.agg(F.count("*").alias("row_count"), F.array(*columns).alias("columns"))  # one row
        flat = gathered.select("row_count", F.explode("columns").alias("c")).select(F.lit(table).alias("table_name"), "row_count", "c.*")
    else:
        c, held = F.col("v"), F.coalesce(F.sum("n"), F.lit(0))
        known = F.coalesce(F.sum(F.when(c.isNotNull(), F.col("n"))), F.lit(0))
        groups = [(f, df.select(F.col(f"`{f.name}`").alias("v")).groupBy("v").agg(F.count("*").alias("n"))) for f in fields]
        parts = [g.agg(held.alias("row_count"), *described(f, c, known, held, F.count(c))) for f, g in groups]
        flat = reduce(DataFrame.unionByName, parts).select(F.lit(table).alias("table_name"), "*")
    n = F.col("distinct_count")
    return flat.withColumns(
        {
            "cardinality_bucket": cardinality_bucket(n),
            "exact_distinct": exact_distinct(n),
            "percent_null": percent(F.col("null_count"), F.col("row_count")),
            "percent_distinct": percent(n, F.col("row_count")),
        }
    )


def top_values(df: DataFrame, column: str, k: int = 5) -> DataFrame:
    """(value, frequency) of the k most frequent non-null values; ties go to the smaller value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("frequency"))
    return counts.orderBy(F.desc("frequency"), "value").limit(k)


def approximate_top_values(df: DataFrame, column: str, k: int = 5) -> DataFrame:
    """As ``top_values`` from one sketch, without a shuffle of the values."""
    found = df.agg(F.expr(f"approx_top_k(`{column}`, {k})").alias("t")).select(F.explode("t").alias("e"))
    return found.select(F.col("e.item").cast("string").alias("value"), F.col("e.count").alias("frequency"))


def running_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, frequency, before, total): counts of each non-null value, of the smaller ones and of all of its keys."""
    return running(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("frequency")), keys, value)


def running(counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``running_counts`` of (keys, value, frequency); a null value comes first.

    The counts are dealt by ranges and written, so that each range keeps its number; a
    running count is that within the range plus the counts of the ranges before, of
    which there are as many as shuffle partitions for each key.
    """
    ranged = written(counts.repartitionByRange(*keys, value).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy(*keys, "_range").agg(F.sum("frequency").alias("_size"))
    earlier = F.sum("_size").over(Window.partitionBy(*keys).orderBy("_range")) - F.col("_size")
    total = F.sum("_size").over(Window.partitionBy(*keys))
    starts = sizes.select(F.col("_range").alias("_of"), *[F.col(k).alias(f"_of_{k}") for k in keys], earlier.alias("_start"), total.alias("total"))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys], F.col("_range") == F.col("_of"))
    within = F.sum("frequency").over(Window.partitionBy("_range", *keys).orderBy(value)) - F.col("frequency")
    placed = ranged.withColumn("_within", within).join(starts, same)
    return placed.select(*keys, value, "frequency", (F.col("_start") + F.col("_within")).alias("before"), "total")


def percentiles(df: DataFrame, keys: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """(keys, names): exact percentiles by linear interpolation; groups without a value aren't there."""
    return interpolated(running_counts(df, keys, value), keys, value, points)


def interpolated(counts: DataFrame, keys: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """``percentiles`` from running counts: each lies between two ranks, whose values are picked."""
    at = lambda rank: F.max(F.when((F.col("before") <= rank) & (rank < F.col("before") + F.col("frequency")), F.col(value).cast("double")))
    picked = []
    for name, p in points.items():
        place = F.lit(float(p)) * (F.col("total") - 1)
        picked += [F.max(place).alias(f"_place_{name}"), at(F.floor(place)).alias(f"_low_{name}"), at(F.ceil(place)).alias(f"_high_{name}")]
    found = counts.groupBy(*keys).agg(*picked)
    between = []
    for name in points:
        place, low, high = F.col(f"_place_{name}"), F.col(f"_low_{name}"), F.col(f"_high_{name}")
        between.append(F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high).alias(name))
    return found.select(*keys, *between)


def singleton_histogram(df: DataFrame, column: str) -> DataFrame:
    """(value, frequency, cumulative): counts of the non-null values with their running share of all rows."""
    rows = df.agg(F.count("*").alias("rows"))
    upto = F.col("before") + F.col("frequency")
    return running_counts(df, [], column).crossJoin(F.broadcast(rows)).select(F.col(column).alias("value"), "frequency", (upto / F.col("rows")).alias("cumulative"))


def decoded_singleton(histogram: DataFrame, rows: int) -> DataFrame:
    """Frequencies back from cumulative shares, of a catalog's histogram: its buckets are few, so one window orders them."""
    w = Window.orderBy("value")
    step = F.col("cumulative") - F.coalesce(F.lag("cumulative").over(w), F.lit(0.0))
    return histogram.select("value", F.bround(step * rows).cast("bigint").alias("frequency"))


def equi_height(df: DataFrame, column: str, buckets: int = 100) -> DataFrame:
    """(bucket, low, high, rows): values by the number of exact percentile bounds below them.

    The bound i / buckets lies below a value exactly if its place among all rows comes
    before the value's first row, so a bucket follows from the running count alone. The
    division finds it within one; the places as doubles, as percentiles have them, decide.
    """
    counts = running_counts(df, [], column)
    last, before = F.col("total") - 1, F.col("before")
    least = F.greatest(F.lit(0), F.floor((before * buckets - 1) / F.greatest(last, F.lit(1))) - 1)
    below = lambda i: F.when((i < buckets) & (i.cast("double") / buckets * last < before), 1).otherwise(0)
    bucket = F.least(least, F.lit(buckets - 1)) + below(least + 1) + below(least + 2) + 1
    return counts.groupBy(bucket.cast("int").alias("bucket")).agg(F.min(column).alias("low"), F.max(column).alias("high"), F.sum("frequency").alias("rows"))


def first_rows(df: DataFrame, order: str, limit: int = 5) -> DataFrame:
    """The first rows as sample text, in the order of a column."""
    columns = [sample_value(F.col(f"`{f.name}`"), f.dataType.simpleString()).alias(f.name) for f in df.schema.fields]
    return df.orderBy(order).limit(limit).select(*columns)


def sampled(df: DataFrame, row_count: int | None, seed: int = 7) -> DataFrame:
    """A Bernoulli sample at the rate for the table's size; the whole table where the rate is 1."""
    rate = sample_rate(row_count)
    return df if rate >= 1 else df.sample(False, rate, seed)


def partitioned_row_count(children: DataFrame, table_col: str, count_col: str) -> DataFrame:
    """Sum of the children's row counts; null where any child was never analysed (below zero)."""
    total = F.when(F.min(count_col) < 0, F.lit(None)).otherwise(F.coalesce(F.sum(count_col), F.lit(0)))
    return children.groupBy(table_col).agg(total.cast("bigint").alias("row_count"))
