import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import perf, profiling

SCHEMA = "k string, x double"


def rows(n, seed, distinct=40):
    r = random.Random(seed)
    return [(r.choice(["a", "b", None]), r.choice([None, *[i / 7 for i in range(distinct)]])) for _ in range(n)]


@pytest.mark.parametrize("n, distinct", [(1, 5), (2, 5), (300, 7), (1500, 1000)])
def test_percentiles_are_those_of_all_values(spark, n, distinct):
    df = spark.createDataFrame(rows(n, n, distinct), SCHEMA)
    points = {"p10": 0.1, "p29": 0.29, "p50": 0.5, "p100": 1.0}
    mine = {r.k: [round(r[p], 9) for p in points] for r in profiling.percentiles(df, ["k"], "x", points).collect()}
    wanted = df.where("x is not null").groupBy("k").agg(*[F.percentile("x", q).alias(p) for p, q in points.items()])
    assert mine == {r.k: [round(r[p], 9) for p in points] for r in wanted.collect()}


@pytest.mark.parametrize("n", [1, 5, 101, 201, 777])
@pytest.mark.parametrize("buckets", [4, 100])
def test_equi_height_counts_the_bounds_below(spark, n, buckets):
    values = [(float(i * i % 83),) for i in range(n)] + [(None,)]
    df = spark.createDataFrame(values, "x double")
    bounds = df.agg(F.percentile("x", F.array(*[F.lit(i / buckets) for i in range(1, buckets)])).alias("b")).first().b
    wanted = {}
    for (x,) in values[:-1]:
        wanted.setdefault(sum(b < x for b in bounds) + 1, []).append(x)
    mine = {r.bucket: (r.low, r.high, r.rows) for r in profiling.equi_height(df, "x", buckets).collect()}
    assert mine == {b: (min(v), max(v), len(v)) for b, v in wanted.items()}


def test_running_counts_by_key(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("a", 2), (None, 5), ("b", None), ("b", 1)], "k string, v int")
    got = sorted((str(r.k), r.v, r.frequency, r.before, r.total) for r in profiling.running_counts(df, ["k"], "v").collect())
    assert got == [("None", 5, 1, 0, 1), ("a", 1, 1, 0, 3), ("a", 2, 2, 1, 3), ("b", 1, 1, 0, 1)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert profiling.percentiles(none, ["k"], "x", {"m": 0.5}).count() == 0
    assert profiling.equi_height(none, "x").count() == profiling.singleton_histogram(none, "x").count() == 0
    assert [(r.row_count, r.distinct_count, r.null_count, r.min_number) for r in profiling.profile(none, "t").collect()] == [(0, 0, 0, None)] * 2
    runs = spark.createDataFrame([], "status string, run_ms double")
    assert [tuple(r) for r in perf.overview(runs).collect()] == [(0, 0, None, None)]


def test_profile_is_that_of_a_single_pass(spark):
    df = spark.createDataFrame(rows(200, 3), SCHEMA).withColumn("n", F.lit(1))
    columns = ["column_name", "row_count", "null_count", "distinct_count", "min_text", "max_text", "min_number", "max_number", "cardinality_bucket"]
    exact = sorted(map(repr, profiling.profile(df, "t").select(columns).collect()))
    assert exact == sorted(map(repr, profiling.profile(df, "t", approximate=True).select(columns).collect()))
