"""Queries of the performance analytics and of event-time streams; events stand for spans."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import perf
from weftline.plans.book import Book, table
from weftline.session import shared_folder
from weftline.streaming import sink, windows

BOOK = Book()
SPANS = """spans as (
  select 'run' || (user_id % 50) as run_id, 's' || event_id as span_id, case when event_id % 7 > 0 then 's' || (event_id - event_id % 7) end as parent_span_id,
         case when user_id % 5 > 0 then 'src' || (user_id % 5) end as datasource_id, event_type as name, cast(event_id as double) as t_start_ms, value as duration_ms,
         case when event_type = 'error' then 'error' else 'ok' end as status, case when user_id % 2 = 0 then 'build' else 'index' end as operation
  from events)"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_columns(table(spark, sf_dir, "events"))


def span_columns(events: DataFrame) -> DataFrame:
    u, e = F.col("user_id"), F.col("event_id")
    return events.select(
        F.concat(F.lit("run"), (u % 50).cast("string")).alias("run_id"),
        F.concat(F.lit("s"), e.cast("string")).alias("span_id"),
        F.when(e % 7 > 0, F.concat(F.lit("s"), (e - e % 7).cast("string"))).alias("parent_span_id"),
        F.when(u % 5 > 0, F.concat(F.lit("src"), (u % 5).cast("string"))).alias("datasource_id"),
        F.col("event_type").alias("name"),
        e.cast("double").alias("t_start_ms"),
        F.col("value").alias("duration_ms"),
        F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"),
        F.when(u % 2 == 0, "build").otherwise("index").alias("operation"),
        F.lit(None).cast("string").alias("error_type"),
        F.create_map(F.lit("chunk_count"), (u % 9).cast("string"), F.lit("context_size"), (e % 100).cast("string"), F.lit("datasource_type"), F.lit("duckdb")).alias("attrs"),
    )


TOTALS = """totals as (
  select operation, run_id, datasource_id, name, sum(duration_ms) as total_ms, count(*) as span_count, min(t_start_ms) as first_start_ms, bool_or(status <> 'ok') as any_error
  from spans group by all)"""


@BOOK.add(f"with {SPANS}, {TOTALS} select operation, run_id, datasource_id, name, round(total_ms, 4) as total_ms, span_count, first_start_ms, any_error from totals")
def perf_step_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perf.step_totals(spans(spark, sf_dir)).withColumn("total_ms", F.round("total_ms", 4))


@BOOK.add(f"""
with {SPANS}, {TOTALS}, m as (
  select 'run' || (user_id % 50) as run_id, case when user_id % 5 > 0 then 'src' || (user_id % 5) end as datasource_id, max(user_id % 9) as chunk_count, max(event_id % 100) as context_size
  from events group by all)
select t.operation, t.run_id, t.datasource_id, t.name, t.span_count, m.chunk_count, m.context_size, case when m.chunk_count > 0 then round(t.total_ms / m.chunk_count, 4) end as ms_per_chunk
from totals t left join m on t.run_id = m.run_id and t.datasource_id is not distinct from m.datasource_id
""")
def perf_null_safe_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spans(spark, sf_dir)
    out = perf.step_totals(s, perf.datasource_metrics(s))
    return out.select("operation", "run_id", "datasource_id", "name", "span_count", "chunk_count", "context_size", F.round("ms_per_chunk", 4).alias("ms_per_chunk"))


@BOOK.add(f"""
with {SPANS}, runs as (select run_id, operation, max(status) as status from spans group by all having operation = 'build')
select run_id, datasource_id, count(*) as spans, round(sum(duration_ms), 4) as total_ms from spans semi join runs using (run_id) where operation is not null and datasource_id in ('src1', 'src2') group by all
""")
def perf_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of two sources within the runs of one operation; any status."""
    s = spans(spark, sf_dir)
    found = s.groupBy("run_id", "operation").agg(F.max("status").alias("status"))
    chosen = perf.selected(found, s, operations=["build"], sources=["src1", "src2"])[2]
    return chosen.groupBy("run_id", "datasource_id").agg(F.count("*").alias("spans"), F.round(F.sum("duration_ms"), 4).alias("total_ms"))


@BOOK.add("""
select case when user_id % 2 = 0 then 'build' else 'index' end as operation, count(*) as total, count(*) filter (event_type not in ('error', 'signup')) as ok,
       count(*) filter (event_type = 'signup') as skipped, count(*) filter (event_type = 'error') as failed
from events group by 1
""")
def perf_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of each operation by outcome."""
    return perf.outcomes(spans(spark, sf_dir).withColumn("status", F.when(F.col("name") == "error", "FAILED").when(F.col("name") == "signup", "SKIPPED").when(F.col("name").isNotNull(), "OK")))


@BOOK.add("""
select event_id, json_extract_string(props, '$.k') as k, cast(event_id as bigint) as t_start_ms, cast(event_id as bigint) + cast(trunc(value) as bigint) as t_end_ms, strftime(ts, '%Y-%m-%d %H:%M:%S') as short_ts from events
""")
def perf_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON attributes as columns, whole milliseconds and short times."""
    rows = table(spark, sf_dir, "events").select("event_id", "ts", F.col("props").alias("attrs"), F.col("event_id").alias("t_start_ms"), F.col("value").alias("duration_ms"))
    out = perf.with_ends(perf.flat_attributes(rows, ["k"]))
    return out.select("event_id", F.col("`attr.k`").alias("k"), "t_start_ms", "t_end_ms", perf.short_time(F.col("ts")).alias("short_ts"))


@BOOK.add("""
select event_type as name, count(value) as count, cast(round_even(avg(value), 0) as bigint) as mean, cast(round_even(quantile_cont(value, 0.5), 0) as bigint) as median,
       cast(round_even(quantile_cont(value, 0.9), 0) as bigint) as p90, cast(round_even(quantile_cont(value, 0.99), 0) as bigint) as p99, cast(round_even(max(value), 0) as bigint) as max
from events where event_type is not null group by 1
""")
def perf_step_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perf.step_stats(spans(spark, sf_dir), value="duration_ms")


def run_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    starts = orders.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").cast("string").alias("run_id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), F.col("o_orderpriority").alias("operation"))
    ends = orders.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").cast("string").alias("run_id"), F.lit(None).cast("string").alias("ts"), F.when(F.col("o_orderstatus") == "F", "error").otherwise("ok").alias("status"), F.col("o_totalprice").alias("duration_ms"))
    return perf.runs(starts, ends)


RUNS = """runs as (
  select coalesce(s.run_id, e.run_id) as run_id, s.start_dt, coalesce(s.operation, 'unknown') as operation, coalesce(e.status, 'unknown') as status, e.run_ms
  from (select cast(o_orderkey as varchar) as run_id, o_orderdate as start_dt, o_orderpriority as operation from orders where o_orderkey % 3 <> 0) s
  full join (select cast(o_orderkey as varchar) as run_id, case when o_orderstatus = 'F' then 'error' else 'ok' end as status, o_totalprice as run_ms from orders where o_orderkey % 5 <> 0) e on s.run_id = e.run_id)"""


@BOOK.add(f"with {RUNS} select run_id, operation, status, run_ms, cast(row_number() over (order by start_dt nulls last, run_id) - 1 as integer) as run_index from runs")
def perf_runs_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perf.numbered_runs(run_frames(spark, sf_dir)).select("run_id", "operation", "status", "run_ms", "run_index")


@BOOK.add(f"with {RUNS} select count(*) as runs, count(*) filter (status not in ('ok', 'unknown')) as errors, round(avg(run_ms), 4) as mean_ms, round(quantile_cont(run_ms, 0.9), 4) as p90_ms from runs")
def perf_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perf.overview(run_frames(spark, sf_dir)).select("runs", "errors", F.round("mean_ms", 4).alias("mean_ms"), F.round("p90_ms", 4).alias("p90_ms"))


@BOOK.add(f"with {SPANS} select datasource_id, " + ", ".join(f"round(avg(duration_ms) filter (name = '{n}'), 4) as {n}" for n in ("click", "error", "purchase", "signup", "view")) + " from spans group by 1")
def perf_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["click", "error", "purchase", "signup", "view"]
    out = perf.pivoted(spans(spark, sf_dir), "datasource_id", "name", "duration_ms", kinds)
    return out.select("datasource_id", *[F.round(k, 4).alias(k) for k in kinds])


@BOOK.add(f"""
with recursive {SPANS}, tree as (
  select run_id, span_id, 0 as depth, span_id as path from spans s where not exists (select 1 from spans p where p.run_id = s.run_id and p.span_id = s.parent_span_id)
  union all
  select s.run_id, s.span_id, t.depth + 1, t.path || '/' || s.span_id from spans s join tree t on s.run_id = t.run_id and s.parent_span_id = t.span_id)
select run_id, span_id, depth, path from tree
""")
def span_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perf.span_depths(spans(spark, sf_dir))


@BOOK.add(f"""
with {SPANS}, timed as (select *, coalesce(datasource_id, 'pipeline') as lane from spans where t_start_ms is not null and duration_ms is not null)
select run_id, name, 'X' as ph, 1 as pid, cast(dense_rank() over (partition by run_id order by lane) as integer) as tid, cast(round_even(t_start_ms * 1000, 0) as bigint) as ts, cast(round_even(duration_ms * 1000, 0) as bigint) as dur from timed
""")
def trace_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perf.trace_events(spans(spark, sf_dir)).drop("args")


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream: a folder that holds its file."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # a file stream wants a folder; a glob of the one file is one
    return windows.event_stream(spark, f"{sf_dir}/events.parque[t]", schema)


def windowed(spark: SparkSession, sf_dir: str, window) -> DataFrame:
    """All windows of the events, out of the table that a stream with a watermark has appended them to."""
    return sink.finished(spark, shared_folder(spark), lambda closing: window(closing.of(stream(spark, sf_dir), "ts")))


@BOOK.add("""
select cast(s as timestamp) as window_start, cast(s + interval '1 hour' as timestamp) as window_end, event_type, count(*) as n, round(sum(value), 4) as total
from (select date_trunc('hour', ts) as s, event_type, value from events) group by all
""")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(windowed(spark, sf_dir, lambda e: windows.tumbling(e, "1 hour", ["event_type"])))


@BOOK.add("""
select s as window_start, s + interval '2 hours' as window_end, event_type, count(*) as n, round(sum(value), 4) as total
from (select unnest([date_trunc('hour', ts), date_trunc('hour', ts) - interval '1 hour']) as s, event_type, value from events) group by all
""")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(windowed(spark, sf_dir, lambda e: windows.sliding(e, "2 hours", "1 hour", ["event_type"])))


@BOOK.add("""
with m as (select user_id, ts, value, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval '30 minutes' then 0 else 1 end as fresh, event_id from events),
g as (select *, sum(fresh) over (partition by user_id order by ts, event_id) as g from m)
select min(ts) as window_start, max(ts) + interval '30 minutes' as window_end, user_id, count(*) as n, round(sum(value), 4) as total from g group by user_id, g
""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(windowed(spark, sf_dir, lambda e: windows.sessions(e, "30 minutes", ["user_id"])))


@BOOK.add("""
with s as (select cast(o_orderkey as varchar) as run_id, o_orderdate as start_dt, o_orderpriority as operation from orders where o_orderkey % 3 <> 0),
e as (select cast(o_orderkey as varchar) as run_id, o_orderdate + to_minutes(cast(o_custkey % 150 as integer)) as end_dt, case when o_orderstatus = 'F' then 'error' else 'ok' end as status, o_totalprice as run_ms from orders where o_orderkey % 5 <> 0)
select coalesce(s.run_id, e.run_id) as run_id, start_dt, end_dt, coalesce(operation, 'unknown') as operation, coalesce(status, 'unknown') as status, run_ms,
       case when e.run_id is null then 'timeout' when s.run_id is null then 'no start' else 'end' end as closed_by
from s full join e on s.run_id = e.run_id and end_dt >= start_dt and end_dt <= start_dt + interval '2 hours'
""")
def stream_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs whose start and end come in two streams; some ends come too late or never."""
    schema = spark.read.parquet(f"{sf_dir}/orders.parquet").schema

    def plan(closing):
        rows = lambda: spark.readStream.schema(schema).parquet(f"{sf_dir}/orders.parque[t]").withColumn("at", F.col("o_orderdate").cast("timestamp"))
        run = F.col("o_orderkey").cast("string").alias("run_id")
        starts = rows().where("o_orderkey % 3 <> 0").select(run, F.col("at").alias("start_dt"), F.col("o_orderpriority").alias("operation"))
        end = (F.col("at") + F.make_dt_interval(mins=(F.col("o_custkey") % 150).cast("int"))).alias("end_dt")
        ends = rows().where("o_orderkey % 5 <> 0").select(run, end, F.when(F.col("o_orderstatus") == "F", "error").otherwise("ok").alias("status"), F.col("o_totalprice").alias("run_ms"))
        return windows.run_states(closing.of(starts, "start_dt"), closing.of(ends, "end_dt"))

    out = sink.finished(spark, shared_folder(spark), plan)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start_dt", "end_dt")})


@BOOK.add(f"with {SPANS} select run_id, datasource_id, name, round(sum(duration_ms), 4) as total_ms, count(*) as span_count, min(t_start_ms) as first_start_ms from spans group by all")
def stream_step_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the spans as they arrive: the latest row of each step, run and source counts."""
    keys = ["run_id", "datasource_id", "name"]
    arriving = span_columns(stream(spark, sf_dir))
    out = windows.run_available(windows.step_totals_of(arriving), f"totals_{uuid.uuid4().hex}", "update", keys=keys)
    return out.withColumn("total_ms", F.round("total_ms", 4))


def shown(out: DataFrame) -> DataFrame:
    return out.withColumns({"window_start": F.col("window_start").cast("timestamp_ntz"), "window_end": F.col("window_end").cast("timestamp_ntz"), "total": F.round("total", 4)})
