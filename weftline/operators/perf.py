"""Analytics over performance records: runs, spans, totals, quantiles, trees, traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.ordering import numbered
from weftline.operators.profiling import percentiles
from weftline.session import written

RECORD = "type string, ts string, run_id string, operation string, status string, span_id string, parent_span_id string, datasource_id string, name string, t_start_ms double, duration_ms double, error_type string, attrs map<string,string>"


def split_records(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(run starts, run ends, spans); other types are dropped."""
    return tuple(records.where(F.col("type") == t) for t in ("run_start", "run_end", "span"))


def runs(starts: DataFrame, ends: DataFrame) -> DataFrame:
    """A row a run, also where its start or end is missing; operation and status are then unknown."""
    s = starts.select("run_id", F.try_to_timestamp("ts").alias("start_dt"), "operation")
    e = ends.select("run_id", F.try_to_timestamp("ts").alias("end_dt"), "status", F.col("duration_ms").alias("run_ms"))
    both = s.join(e, "run_id", "full_outer")
    return both.withColumns({"operation": F.coalesce("operation", F.lit("unknown")), "status": F.coalesce("status", F.lit("unknown"))})


def numbered_runs(found: DataFrame) -> DataFrame:
    """Runs with run_index from 0, by start, those without one last, ties by id; ranges of this order are numbered, never the whole in one task."""
    return numbered(found, [F.col("start_dt").isNull().asc(), F.asc_nulls_last("start_dt"), F.asc("run_id")], "run_index")


def selected(found: DataFrame, spans: DataFrame, operations: list[str] | None = None, statuses: list[str] | None = None, sources: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(runs of the operations and statuses, their spans, those of them of the sources); an empty choice of a kind means all that have one.

    A run without an operation or status is never chosen; spans keep a null source unless sources are named.
    """
    for name, wanted in (("operation", operations), ("status", statuses)):
        found = found.where(F.col(name).isin(wanted) if wanted else F.col(name).isNotNull())
    of_runs = spans.join(found.select("run_id").where("run_id is not null"), "run_id", "left_semi")
    return found, of_runs, of_runs.where(F.col("datasource_id").isin(sources)) if sources else of_runs


def outcomes(results: DataFrame, name: str = "operation", status: str = "status") -> DataFrame:
    """How many results of each operation went well, were skipped and failed; other outcomes count in the total only."""
    kinds = {"ok": ["ok"], "skipped": ["skipped"], "failed": ["failed", "error"]}
    counts = [F.count_if(F.coalesce(F.lower(status).isin(said), F.lit(False))).alias(k) for k, said in kinds.items()]
    return results.groupBy(name).agg(F.count("*").alias("total"), *counts)


def attribute_names(spans: DataFrame, column: str = "attrs") -> DataFrame:
    """The names of the JSON attributes, a row a name."""
    return spans.select(F.explode(F.json_object_keys(column)).alias("name")).distinct()


def flat_attributes(spans: DataFrame, names: list[str], column: str = "attrs") -> DataFrame:
    """JSON attributes as columns attr.name; dots in a name lead into nested objects. What isn't an object has no attributes."""
    is_object = F.json_object_keys(column).isNotNull()
    value = lambda n: F.when(is_object, F.get_json_object(column, "$" + "".join(f"['{p}']" for p in n.split("."))))
    return spans.select("*", *[value(n).alias(f"attr.{n}") for n in names]).drop(column)


def with_ends(spans: DataFrame) -> DataFrame:
    """Start and duration as whole milliseconds, null where they are none, and t_end_ms."""
    whole = lambda c: F.col(c).try_cast("double").try_cast("bigint")
    rows = spans.withColumns({c: whole(c) for c in ("t_start_ms", "duration_ms")})
    return rows.withColumn("t_end_ms", F.col("t_start_ms") + F.col("duration_ms"))


def short_time(ts: Column) -> Column:
    """A time's text to the second."""
    return F.substring(ts.cast("string"), 1, 19)


def with_runs(spans: DataFrame, found: DataFrame) -> DataFrame:
    return spans.drop("operation", "status").withColumn("span_status", spans["status"]).join(found.select("run_id", "operation", F.col("status").alias("run_status")), "run_id", "left")


def datasource_metrics(spans: DataFrame) -> DataFrame:
    """Largest chunk count and context size and first known type by run and source; a missing source is a group of its own."""
    number = lambda k: F.max(F.try_element_at("attrs", F.lit(k)).try_cast("bigint"))
    kind = F.min_by(F.try_element_at("attrs", F.lit("datasource_type")), F.when(F.try_element_at("attrs", F.lit("datasource_type")).isNotNull(), F.struct("t_start_ms", "span_id")))
    return spans.groupBy("run_id", "datasource_id").agg(number("chunk_count").alias("chunk_count"), number("context_size").alias("context_size"), kind.alias("datasource_type"))


def step_totals(spans: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """Time, number, first start and failure of each step by run and source; with metrics also the time a chunk."""
    keys = ["operation", "run_id", "datasource_id", "name"]
    totals = spans.groupBy(*keys).agg(
        F.sum("duration_ms").alias("total_ms"), F.count("span_id").alias("span_count"), F.min("t_start_ms").alias("first_start_ms"), F.bool_or(F.coalesce("status", F.lit("ok")) != "ok").alias("any_error")
    )
    if metrics is None:
        return totals
    m = metrics.withColumnsRenamed({"run_id": "_run", "datasource_id": "_source"})
    joined = totals.join(m, F.col("run_id").eqNullSafe(F.col("_run")) & F.col("datasource_id").eqNullSafe(F.col("_source")), "left").drop("_run", "_source")
    return joined.withColumn("ms_per_chunk", F.when(F.col("chunk_count") > 0, F.col("total_ms") / F.col("chunk_count")))


def step_stats(totals: DataFrame, name: str = "name", value: str = "total_ms") -> DataFrame:
    """Count, mean, median, 90th and 99th percentile and maximum by step, rounded half-even, slowest first."""
    whole = lambda c: F.bround(c).cast("bigint")
    named = totals.where(F.col(name).isNotNull())
    plain = named.groupBy(name).agg(F.count(value).alias("count"), whole(F.avg(value)).alias("mean"), whole(F.max(value)).alias("max"))
    ranks = percentiles(named, [name], value, {"median": 0.5, "p90": 0.9, "p99": 0.99})
    out = plain.join(ranks, name, "left")
    return out.select(name, "count", "mean", *[whole(c).alias(c) for c in ("median", "p90", "p99")], "max").orderBy(F.desc("p90"), name)


def overview(found: DataFrame) -> DataFrame:
    """Number of runs and of failed ones, mean and 90th percentile of their time."""
    plain = found.agg(F.count("*").alias("runs"), F.count_if(~F.col("status").isin("ok", "unknown")).alias("errors"), F.avg("run_ms").alias("mean_ms"))
    return plain.join(percentiles(found, [], "run_ms", {"p90_ms": 0.9}), how="left")  # one row each


def pivoted(rows: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """Mean value by row and column; the columns are named, so no extra pass finds them."""
    return rows.groupBy(row).pivot(column, columns).agg(F.avg(value))


def by_largest(table: DataFrame, row: str, columns: list[str]) -> DataFrame:
    """A pivoted table with its rows' largest value, largest first, ties by name; rows without any value last."""
    top = F.greatest(*columns) if len(columns) > 1 else F.col(columns[0])
    return table.withColumn("largest", top).orderBy(F.desc_nulls_last("largest"), row)


def span_depths(spans: DataFrame) -> DataFrame:
    """(run_id, span_id, depth, path): depth from the roots down; a span whose parent isn't there is a root.

    Every span holds the path up to some ancestor and each round joins that ancestor's
    own path, so a tree of depth d takes about log2(d) rounds, each written. Spans that
    are their own ancestors hang on no root and are left out. A span that was logged more
    than once counts once; if its parents differ, the smallest named one counts.
    """
    s = spans.groupBy("run_id", "span_id").agg(F.min("parent_span_id").alias("parent_span_id"))
    known = s.select("run_id", F.col("span_id").alias("parent_span_id"), F.lit(True).alias("has_parent")).distinct()
    linked = s.join(known, ["run_id", "parent_span_id"], "left")
    above = F.when(F.col("has_parent"), F.col("parent_span_id"))
    paths = written(linked.select("run_id", "span_id", above.alias("up"), F.when(F.col("has_parent"), 1).otherwise(0).alias("depth"), F.col("span_id").alias("path")))
    for _ in range(paths.count().bit_length() + 1):
        if paths.where("up is not null").isEmpty():
            break
        nearer = paths.select("run_id", F.col("span_id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"), F.col("path").alias("_path"))
        joined = paths.join(nearer, ["run_id", "up"], "left")
        found = F.col("_path").isNotNull()
        depth, path = F.when(found, F.col("depth") + F.col("_depth")).otherwise(F.col("depth")), F.when(found, F.concat_ws("/", "_path", "path")).otherwise(F.col("path"))
        paths = written(joined.select("run_id", "span_id", F.col("_up").alias("up"), depth.alias("depth"), path.alias("path")))
    return paths.where("up is null").drop("up")


def trace_events(spans: DataFrame) -> DataFrame:
    """Complete events of a trace viewer: micro-seconds, a lane for each source by name, arguments as JSON."""
    lane = F.coalesce(F.nullif("datasource_id", F.lit("")), F.lit("pipeline"))
    timed = spans.where("t_start_ms is not null and duration_ms is not null").withColumn("lane", lane)
    micro = lambda c: F.bround(F.col(c) * 1000).cast("bigint")
    args = F.to_json(F.struct("span_id", "parent_span_id", "datasource_id", "status", "error_type"))
    lanes = timed.select("run_id", "lane").distinct().withColumn("tid", F.row_number().over(Window.partitionBy("run_id").orderBy("lane")))
    return timed.join(lanes, ["run_id", "lane"]).select("run_id", F.col("name"), F.lit("X").alias("ph"), F.lit(1).alias("pid"), "tid", micro("t_start_ms").alias("ts"), micro("duration_ms").alias("dur"), args.alias("args"))
