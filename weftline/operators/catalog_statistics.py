"""Column statistics from what databases have sampled themselves: decoded, and joined to the model.

PostgreSQL keeps shares of nulls, distinct estimates (a number, or below zero minus the
share of rows), most common values with their shares and histogram bounds; MySQL keeps
JSON histograms with one bucket a value or of equal height. Both become rows of one shape:
(schema_name, table_name, column_name, total_row_count, null_count, non_null_count,
distinct_count, cardinality_bucket, min_value, max_value, top_values).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.stats import cardinality_bucket, exact_distinct

KEY = ["schema_name", "table_name"]
TOP = 5
TOP_TYPE = "array<struct<value:string,frequency:bigint>>"


def array_text(text: Column) -> Column:
    """Items of ``{a,b}`` without blanks; null where the text isn't an array. Quotes and escapes aren't known."""
    inner = F.regexp_extract(text, r"(?s)\A\{(.*)\}\z", 1)
    items = F.filter(F.transform(F.split(inner, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(text.rlike(r"(?s)\A\{.*\}\z"), items)


def _described(rows: DataFrame, distinct: Column, nulls: Column, low: Column, high: Column, top: Column) -> DataFrame:
    total = F.col("total_row_count")
    return rows.select(
        *KEY, "column_name", "total_row_count", nulls.alias("null_count"), (total - nulls).alias("non_null_count"),
        exact_distinct(distinct).alias("distinct_count"), cardinality_bucket(distinct).alias("cardinality_bucket"),
        low.alias("min_value"), high.alias("max_value"), top.cast(TOP_TYPE).alias("top_values"),
    )


def _whole(share: Column) -> Column:
    return F.bround(share).cast("bigint")


def from_postgresql(columns: DataFrame, tables: DataFrame) -> DataFrame:
    """columns: (schema_name, table_name, column_name, null_frac, n_distinct, most_common_vals, most_common_freqs, histogram_bounds); tables: (schema_name, table_name, row_count).

    Without the table's row count nothing but the bounds is known; an estimate of 0 is none.
    """
    rows = columns.join(tables.select(*KEY, F.col("row_count").alias("total_row_count")), KEY, "left")
    total, n = F.col("total_row_count"), F.col("n_distinct").cast("double")
    distinct = F.when(n < 0, _whole(F.abs(n) * total)).when((n > 0) & total.isNotNull(), _whole(n))
    values, shares = array_text(F.col("most_common_vals")), F.transform(array_text(F.col("most_common_freqs")), lambda x: x.try_cast("double"))
    paired = F.zip_with(values, shares, lambda v, f: F.struct(v.alias("value"), _whole(f * total).alias("frequency")))
    usable = (F.size(values) == F.size(shares)) & (F.size(values) > 0) & total.isNotNull() & ~F.exists(shares, F.isnull)
    bounds = array_text(F.col("histogram_bounds"))
    edge = lambda i: F.when(F.size(bounds) > 0, F.try_element_at(bounds, F.lit(i)))
    return _described(rows, distinct, _whole(F.col("null_frac").cast("double") * total), edge(1), edge(-1), F.when(usable, F.slice(paired, 1, TOP)))


def decoded_value(value: Column) -> Column:
    """A histogram's value; ``base64:type:payload`` is decoded, null where it can't be."""
    payload = F.regexp_extract(value, r"(?s)\Abase64:[^:]*:(.*)\z", 1)
    return F.when(value.startswith("base64:"), F.try_to_binary(payload, F.lit("base64")).cast("string")).otherwise(value)


def from_mysql(columns: DataFrame, tables: DataFrame) -> DataFrame:
    """columns: (schema_name, table_name, column_name, histogram_json); tables: (schema_name, table_name, row_count).

    Rows without a histogram that can be read are left out; an unknown row count counts as 0.
    """
    rows = columns.join(tables.select(*KEY, F.coalesce("row_count", F.lit(0)).cast("bigint").alias("total_row_count")), KEY, "left").fillna(0, ["total_row_count"])
    parsed = F.from_json("histogram_json", "`histogram-type` string, `null-values` double, buckets array<array<string>>")
    rows = rows.withColumn("h", parsed).where("h.buckets is not null or h.`histogram-type` is not null")
    buckets, total, single = F.coalesce("h.buckets", F.array().cast("array<array<string>>")), F.col("total_row_count"), F.col("h")["histogram-type"] == "singleton"
    some = F.size(buckets) > 0
    estimates = F.aggregate(buckets, F.lit(0).cast("bigint"), lambda s, b: s + F.coalesce(F.try_element_at(b, F.lit(4)).try_cast("bigint"), F.lit(0).cast("bigint")))
    distinct = F.when(single, F.size(buckets)).otherwise(estimates).cast("bigint")
    nulls = F.greatest(F.lit(0), F.least(total, _whole(F.coalesce(F.col("h")["null-values"], F.lit(0.0)) * total)))
    edge = lambda at, i: decoded_value(F.try_element_at(F.try_element_at(buckets, F.lit(at)), i))
    upto = lambda i: F.when(i > 0, F.get(buckets, i - 1)[1].cast("double")).otherwise(0.0)
    steps = F.transform(buckets, lambda b, i: F.struct(-_whole((b[1].cast("double") - upto(i)) * total), i.alias("i"), decoded_value(b[0]).alias("value")))
    top = F.transform(F.slice(F.array_sort(steps), 1, TOP), lambda s: F.struct(s["value"].alias("value"), (-s["col1"]).alias("frequency")))
    return _described(rows, distinct, nulls, F.when(some, edge(1, F.lit(1))), F.when(some, edge(-1, F.when(single, 1).otherwise(2))), F.when(single & some, top))


def with_statistics(tables: DataFrame, statistics: DataFrame, sizes: DataFrame) -> DataFrame:
    """A row for each column of the model, (schema_name, table_name, column_name, type, row_count) and its statistics where there are some.

    tables: as ``catalog.assembled_tables`` gives them; a column without a total of its own has its table's.
    """
    columns = tables.select("schema_name", F.col("name").alias("table_name"), F.explode("columns").alias("c")).select(*KEY, F.col("c.name").alias("column_name"), F.col("c.type").alias("type"))
    sized = columns.join(sizes.select(*KEY, "row_count"), KEY, "left")
    known = statistics.withColumn("has_statistics", F.lit(True))
    joined = sized.join(known, [*KEY, "column_name"], "left")
    return joined.withColumn("total_row_count", F.when(F.col("has_statistics"), F.coalesce("total_row_count", "row_count"))).drop("has_statistics")
