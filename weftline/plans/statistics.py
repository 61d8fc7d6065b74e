"""Queries of the profiling operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.stats import cardinality_bucket, percent
from weftline.operators import profiling
from weftline.plans.book import Book, table

BOOK = Book()
# The atomic columns of the tables and how their minimum is shown.
COLUMNS = {
    "lineitem": "l_orderkey:t l_partkey:t l_suppkey:t l_linenumber:t l_quantity:d l_extendedprice:d l_discount:d l_tax:d l_returnflag:t l_linestatus:t l_shipdate:n",
    "orders": "o_orderkey:t o_custkey:t o_orderstatus:t o_totalprice:d o_orderdate:n o_orderpriority:t",
    "customer": "c_custkey:t c_name:t c_nationkey:t c_acctbal:d c_mktsegment:t",
    "events": "event_id:t ts:n user_id:t event_type:t value:d props:t",
    "documents": "doc_id:t text:t lang:t source:t n_chars:t",
    "part": "p_partkey:t p_name:t p_brand:t p_type:t p_size:t p_retailprice:d",
    "supplier": "s_suppkey:t s_name:t s_nationkey:t s_acctbal:d",
    "nation": "n_nationkey:t n_name:t n_regionkey:t",
    "region": "r_regionkey:t r_name:t",
    "conversations": "conv_id:t turn:t role:t text:t",
}
BUCKET = "case when {n} = 0 then '0' when {n} = 1 then '1' when {n} < 5 then '2-4' when {n} < 10 then '5-9' when {n} < 20 then '10-19' when {n} < 50 then '20-49' when {n} < 100 then '50-99' when {n} < 1000 then '100-999' else '1000+' end"


def profile_sql(name: str) -> str:
    parts = []
    for spec in COLUMNS[name].split():
        c, kind = spec.split(":")
        text = f"cast(min({c}) as varchar) as min_text, cast(max({c}) as varchar) as max_text" if kind == "t" else "cast(null as varchar) as min_text, cast(null as varchar) as max_text"
        number = f"cast(min({c}) as double) as min_number, cast(max({c}) as double) as max_number" if kind == "d" else "cast(null as double) as min_number, cast(null as double) as max_number"
        parts.append(f"select '{name}' as table_name, count(*) as row_count, '{c}' as column_name, count({c}) as non_null_count, count(*) - count({c}) as null_count, count(distinct {c}) as distinct_count, {text}, {number} from {name}")
    return (
        f"select *, {BUCKET.format(n='distinct_count')} as cardinality_bucket, case when distinct_count < 20 then distinct_count end as exact_distinct, "
        "null_count::double / row_count * 100 as percent_null, distinct_count::double / row_count * 100 as percent_distinct from (" + " union all ".join(parts) + ")"
    )


def profile_query(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return profiling.profile(table(spark, sf_dir, name), name)

    run.__name__ = f"profile_{name}"
    return run


for _name in COLUMNS:
    BOOK.add(profile_sql(_name))(profile_query(_name))


@BOOK.add("select cast(event_type as varchar) as value, count(*) as frequency from events where event_type is not null group by 1 order by 2 desc, 1 limit 5")
def top_values_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.top_values(table(spark, sf_dir, "events"), "event_type")


@BOOK.add("select cast(o_orderpriority as varchar) as value, count(*) as frequency from orders where o_orderpriority is not null group by 1 order by 2 desc, 1 limit 3")
def top_values_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.top_values(table(spark, sf_dir, "orders"), "o_orderpriority", 3)


@BOOK.add()
def top_values_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.approximate_top_values(table(spark, sf_dir, "events"), "event_type")


@BOOK.add()
def profile_sketch_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.profile(table(spark, sf_dir, "lineitem"), "lineitem", approximate=True)


@BOOK.add("""
with b as (select quantile_cont(l_extendedprice, list_transform(range(1, 100), lambda i: i / 100.0)) as bounds from lineitem),
n as (select l_extendedprice as x, len(list_filter(bounds, lambda y: y < l_extendedprice)) + 1 as bucket from lineitem cross join b)
select cast(bucket as integer) as bucket, min(x) as low, max(x) as high, count(*) as rows from n group by 1
""")
def equi_height_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.equi_height(table(spark, sf_dir, "lineitem"), "l_extendedprice")


@BOOK.add("""
select l_linenumber as value, count(*) as frequency, round(sum(count(*)) over (order by l_linenumber) / (select count(*) from lineitem), 9) as cumulative from lineitem group by 1
""")
def singleton_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.singleton_histogram(table(spark, sf_dir, "lineitem"), "l_linenumber").withColumn("cumulative", F.round("cumulative", 9))


@BOOK.add("select l_linenumber as value, count(*) as frequency from lineitem group by 1")
def decoded_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    return profiling.decoded_singleton(profiling.singleton_histogram(items, "l_linenumber"), items.count())


@BOOK.add(f"select o_custkey, count(*) as orders, {BUCKET.format(n='count(*)')} as bucket from orders group by o_custkey")
def cardinality_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders")).withColumn("bucket", cardinality_bucket(F.col("orders")))


@BOOK.add("select c_mktsegment, count(*) filter (c_acctbal < 0)::double / count(*) * 100 as percent_negative from customer group by 1")
def percentages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(percent(F.count_if(F.col("c_acctbal") < 0), F.count("*")).alias("percent_negative"))


@BOOK.add("""
select cast(doc_id as varchar) as doc_id, case when length(text) > 256 then left(text, 256) || '…[truncated, 256/' || length(text) || ']' else text end as text,
       lang, source, cast(n_chars as varchar) as n_chars from (select * from documents order by doc_id limit 5)
""")
def sample_first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.first_rows(table(spark, sf_dir, "documents"), "doc_id")


@BOOK.add()
def sample_bernoulli(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    return profiling.sampled(items, items.count())


@BOOK.add("""
select o_orderpriority as parent, case when min(n) < 0 then null else cast(coalesce(sum(n), 0) as bigint) end as row_count
from (select o_orderpriority, o_orderstatus, case when count(*) > 10 then count(*) else -1 end as n from orders group by all) group by 1
""")
def partitioned_row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    children = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("parent"), "o_orderstatus").agg(F.count("*").alias("c"))
    return profiling.partitioned_row_count(children.withColumn("n", F.when(F.col("c") > 10, F.col("c")).otherwise(-1)), "parent", "n")


@BOOK.add("""
select event_type, quantile_cont(value, 0.5) as median, quantile_cont(value, 0.9) as p90, quantile_cont(value, 0.99) as p99, max(value) as largest from events group by 1
""")
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    largest = events.groupBy("event_type").agg(F.max("value").alias("largest"))
    ranks = profiling.percentiles(events, ["event_type"], "value", {"median": 0.5, "p90": 0.9, "p99": 0.99}).withColumnRenamed("event_type", "_type")
    return largest.join(ranks, F.col("event_type").eqNullSafe(F.col("_type")), "left").drop("_type")
