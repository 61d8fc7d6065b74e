"""Column sketches that add up: of versions, of partitions, of a sample.

A row for each column holds counts, the extremes and two mergeable sketches: distinct
values (HLL) and, for numbers, quantiles (KLL). Rows of several versions merge into those
of their union without reading any data again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.stats import cardinality_bucket, percent, sample_rate
from weftline.operators.profiling import profiled_columns

LG_DISTINCT = 14  # about 0.8 % error
KLL = 400  # about 0.7 % of rank


def sketched(df: DataFrame, version: str, rate: float = 1.0, seed: int = 7) -> DataFrame:
    """(version, column_name, rate, rows, non_null, min_text, max_text, distinct, quantiles) from one pass over all columns, of a sample where the rate is below 1."""
    rows = df if rate >= 1 else df.sample(False, rate, seed)
    fields = profiled_columns(df)
    if not fields:
        raise ValueError("no column can be profiled")

    def of(f: T.StructField):
        c = F.col(f"`{f.name}`")
        hashed = c if isinstance(f.dataType, (T.StringType, T.BinaryType, T.IntegerType, T.LongType)) else c.cast("string")
        quantiles = F.kll_sketch_agg_double(c.cast("double"), F.lit(KLL)) if isinstance(f.dataType, T.NumericType) else F.lit(None).cast("binary")
        return F.struct(
            F.lit(f.name).alias("column_name"), F.count(c).alias("non_null"), F.min(c).cast("string").alias("min_text"), F.max(c).cast("string").alias("max_text"),
            F.hll_sketch_agg(hashed, F.lit(LG_DISTINCT)).alias("distinct"), quantiles.alias("quantiles"), F.lit(isinstance(f.dataType, T.NumericType)).alias("numeric"),
        )

    gathered = rows.agg(F.count("*").alias("rows"), F.array(*map(of, fields)).alias("columns"))  # one row
    return gathered.select(F.lit(version).alias("version"), F.lit(float(rate)).alias("rate"), "rows", F.explode("columns").alias("c")).select("version", "rate", "rows", "c.*")


def merged(sketches: list[DataFrame]) -> DataFrame:
    """The sketches of the union of several versions, which must have been sampled at one rate."""
    both = reduce(DataFrame.unionByName, sketches)
    edge = lambda by, agg, c: F.when(F.bool_and("numeric"), by(c, F.col(c).try_cast("double"))).otherwise(agg(c))
    return both.groupBy("column_name").agg(
        F.array_join(F.array_sort(F.collect_set("version")), "+").alias("version"),
        F.when(F.min("rate") == F.max("rate"), F.min("rate")).otherwise(F.raise_error(F.lit("versions sampled at different rates don't add up"))).alias("rate"),
        F.sum("rows").alias("rows"), F.sum("non_null").alias("non_null"), edge(F.min_by, F.min, "min_text").alias("min_text"), edge(F.max_by, F.max, "max_text").alias("max_text"),
        F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("quantiles").alias("quantiles"), F.bool_and("numeric").alias("numeric"),
    )


def estimated(sketches: DataFrame, points: tuple[float, ...] = (0.5, 0.9, 0.99), total: int | None = None) -> DataFrame:
    """What the sketches say: counts scaled from the sample to the table (``total`` rows if known), distinct values as sampled, quantiles by point.

    Distinct counts of a sample are those of the sample, and aren't scaled.
    """
    rows = F.lit(total).cast("bigint") if total is not None else F.bround(F.col("rows") / F.col("rate")).cast("bigint")
    non_null = F.least(F.bround(F.col("non_null") / F.col("rate")).cast("bigint"), rows)
    distinct = F.hll_sketch_estimate("distinct")
    at = [F.when(F.col("numeric") & (F.col("non_null") > 0), F.kll_sketch_get_quantile_double("quantiles", F.lit(float(p)))).alias(f"p{p * 100:g}".replace(".", "_")) for p in points]
    return sketches.select(
        "version", "column_name", rows.alias("row_count"), non_null.alias("non_null_count"), (rows - non_null).alias("null_count"), distinct.alias("distinct_count"),
        cardinality_bucket(distinct).alias("cardinality_bucket"), percent(rows - non_null, rows).alias("percent_null"), "min_text", "max_text", *at,
    )


def adaptive(df: DataFrame, version: str, row_count: int | None = None) -> DataFrame:
    """Sketches at the rate for a table of the size, counted where it isn't given."""
    return sketched(df, version, sample_rate(df.count() if row_count is None else row_count))
