"""Queries of orders with ties, numeric as-of joins, semantic measures, catalog statistics, partitions, paged chunks and sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.stats import BUCKETS
from weftline.operators import catalog, catalog_statistics, joins, measures, ordering, paged, profiling, sketches
from weftline.plans.book import Book, table

BOOK = Book()


@BOOK.add("select l_orderkey, l_linenumber, l_quantity, l_discount from lineitem qualify rank() over (order by l_quantity desc nulls last, l_discount nulls last) <= 100")
def top_lines_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 largest quantities at the least discount, and all that tie with the last of them."""
    found = ordering.top_with_ties(table(spark, sf_dir, "lineitem"), [("l_quantity", True), ("l_discount", False)], 100)
    return found.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


@BOOK.add("select l_suppkey, l_orderkey, l_linenumber, cast(rank() over (partition by l_suppkey order by l_quantity desc nulls last) as integer) as rank from lineitem qualify rank <= 3")
def supplier_lines_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's three largest quantities with ties."""
    return ordering.ranked_with_ties(table(spark, sf_dir, "lineitem"), ["l_suppkey"], [("l_quantity", True)], 3).select("l_suppkey", "l_orderkey", "l_linenumber", "rank")


@BOOK.add("""
with latest as (select user_id from events where user_id is not null group by user_id order by max(ts) desc nulls last, user_id limit 30)
select user_id, event_type, count(*) as n from events semi join latest using (user_id) group by all
""")
def latest_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type of the 30 users seen last."""
    return ordering.latest_groups(table(spark, sf_dir, "events"), "user_id", "ts", 30).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@BOOK.add("select o_orderkey, cast(row_number() over (order by o_orderdate nulls last, o_orderkey) - 1 as bigint) as place from orders")
def numbered_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's place by date."""
    return ordering.numbered(table(spark, sf_dir, "orders"), [F.asc_nulls_last("o_orderdate"), F.asc("o_orderkey")], "place").select("o_orderkey", "place")


@BOOK.add("""
with l as (select event_id, event_id * 3 as at, nullif(user_id % 10, 0) as k from events where event_type = 'error'),
r as (select event_id as found, event_id * 3 - 1 as at, nullif(user_id % 10, 0) as k from events where event_type = 'purchase')
select l.event_id, r.found from l asof left join r on l.k = r.k and l.at >= r.at
""")
def as_of_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last purchase before each error by numbers instead of times; a tenth of the keys are null."""
    events = table(spark, sf_dir, "events")
    key = F.nullif(F.col("user_id") % 10, F.lit(0)).alias("k")
    left = events.where("event_type = 'error'").select("event_id", (F.col("event_id") * 3).alias("at"), key)
    right = events.where("event_type = 'purchase'").select(F.col("event_id").alias("found"), (F.col("event_id") * 3 - 1).alias("before"), key)
    return joins.as_of(left, right, ["k"], "at", "before", "event_id", ["found"]).select("event_id", "found")


# A semantic model over order lines.
MEASURES = [
    {"name": "lines", "agg": "count", "expr": "l_linenumber"},
    {"name": "quantity", "agg": "sum", "expr": "l_quantity"},
    {"name": "returned", "agg": "sum_boolean", "expr": "l_returnflag = 'R'"},
    {"name": "parts", "agg": "count_distinct", "expr": "l_partkey"},
    {"name": "smallest", "agg": "min", "expr": "l_extendedprice"},
    {"name": "largest", "agg": "max", "expr": "l_extendedprice"},
    {"name": "mean_tax", "agg": "average", "expr": "l_tax"},
    {"name": "middle", "agg": "median", "expr": "l_extendedprice"},
    {"name": "p90", "agg": "percentile", "expr": "l_extendedprice", "agg_params": {"percentile": 0.9}},
    {"name": "p10_discrete", "agg": "percentile", "expr": "l_quantity", "agg_params": {"percentile": 0.1, "use_discrete_percentile": True}},
]
MEASURED = """
  count(l_linenumber) as lines, round(sum(l_quantity), 4) as quantity, count(*) filter (l_returnflag = 'R') as returned, count(distinct l_partkey) as parts,
  min(l_extendedprice) as smallest, max(l_extendedprice) as largest, round(avg(l_tax), 6) as mean_tax, round(quantile_cont(l_extendedprice, 0.5), 4) as middle,
  round(quantile_cont(l_extendedprice, 0.9), 4) as p90, quantile_disc(l_quantity, 0.1) as p10_discrete
from lineitem join orders on l_orderkey = o_orderkey"""


def measured(spark: SparkSession, sf_dir: str, grain: list[str]) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    out = measures.compiled(lines, MEASURES, grain)
    return out.withColumns({"quantity": F.round("quantity", 4), "mean_tax": F.round("mean_tax", 6), "middle": F.round("middle", 4), "p90": F.round("p90", 4)})


@BOOK.add(f"select o_orderpriority, date_trunc('year', o_orderdate)::timestamp as o_orderdate__year, {MEASURED} group by 1, 2")
def semantic_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(spark, sf_dir, ["o_orderpriority", "o_orderdate__year"]).withColumn("o_orderdate__year", F.col("o_orderdate__year").cast("timestamp_ntz"))


@BOOK.add(f"select {MEASURED}")
def semantic_measures_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(spark, sf_dir, [])


NAMED = "schema_name string, table_name string, column_name string"
STATISTICS = "schema_name table_name column_name type row_count total_row_count null_count non_null_count distinct_count cardinality_bucket min_value max_value".split()
BUCKET = "case " + " ".join(f"when {{n}} < {high} then '{name}'" for _, high, name in BUCKETS) + " else '1000+' end"


def model(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table model of one given table."""
    columns = catalog.schema_columns(table(spark, sf_dir, name), "main", name)
    none = lambda schema: spark.createDataFrame([], f"schema_name string, table_name string, {schema}")
    return catalog.assembled_tables(none("kind string, description string"), columns, none("constraint_name string, position int, column_name string, validated boolean"), none("constraint_name string, position int, from_column string, ref_schema string, ref_table string, to_column string, on_update string, on_delete string"))


def sizes(rows: DataFrame, name: str) -> DataFrame:
    return rows.agg(F.count("*").alias("row_count")).select(F.lit("main").alias("schema_name"), F.lit(name).alias("table_name"), "row_count")


def shown(statistics: DataFrame) -> DataFrame:
    top = F.array_join(F.transform("top_values", lambda v: F.concat(v["value"], F.lit(":"), v["frequency"].cast("string"))), ",")
    return statistics.select(*STATISTICS, top.alias("top_values"))


@BOOK.add(f"""
with n as (select count(*) as n from lineitem),
flags as (select string_agg(v || ':' || k, ',' order by k desc, v) as top, count(*) as d from (select l_returnflag as v, count(*) as k from lineitem where l_returnflag is not null group by 1 order by k desc, v limit 5)),
known as (
  select 'l_returnflag' as c, (select count(distinct l_returnflag) from lineitem) as d, (select count(*) from lineitem where l_returnflag is null) as nulls, cast(null as varchar) as low, cast(null as varchar) as high, (select top from flags) as top
  union all select 'l_orderkey', (select count(distinct l_orderkey) from lineitem), 0, (select cast(min(l_orderkey) as varchar) from lineitem), (select cast(max(l_orderkey) as varchar) from lineitem), null
  union all select 'l_suppkey', (select count(distinct l_suppkey) from lineitem), 0, (select cast(min(l_suppkey) as varchar) from lineitem), (select cast(max(l_suppkey) as varchar) from lineitem), null
)
select 'main' as schema_name, 'lineitem' as table_name, m.c as column_name, m.t as type, n as row_count, case when k.c is not null then n end as total_row_count, cast(nulls as bigint) as null_count, cast(n - nulls as bigint) as non_null_count,
       case when d < 20 then d end as distinct_count, case when d is not null then {BUCKET.format(n="d")} end as cardinality_bucket, low as min_value, high as max_value, top as top_values
from (values ('l_orderkey', 'bigint'), ('l_partkey', 'bigint'), ('l_suppkey', 'bigint'), ('l_linenumber', 'int'), ('l_quantity', 'double'), ('l_extendedprice', 'double'), ('l_discount', 'double'), ('l_tax', 'double'),
             ('l_returnflag', 'string'), ('l_linestatus', 'string'), ('l_shipdate', 'timestamp_ntz')) m(c, t) cross join n left join known k on k.c = m.c
""")
def catalog_statistics_postgresql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog rows as the database would hold them, made from the order lines, decoded and joined to the model."""
    items = table(spark, sf_dir, "lineitem")
    rows = items.agg(F.count("*").cast("double").alias("_rows"))
    frequent = profiling.top_values(items, "l_returnflag", 10).crossJoin(F.broadcast(rows))  # one row
    listed = lambda c: F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("frequency")).alias("o"), "value", (F.col("frequency") / F.col("_rows")).cast("string").alias("share")))), lambda x: x[c]), ","), F.lit("}"))
    flags = frequent.agg(F.count("*").cast("double").alias("n_distinct"), listed("value").alias("most_common_vals"), listed("share").alias("most_common_freqs"))
    nulls = items.agg((F.count_if(F.col("l_returnflag").isNull()) / F.count("*")).alias("null_frac"))
    none = F.lit(None).cast("string")
    parts = flags.crossJoin(nulls).select(F.lit("l_returnflag").alias("column_name"), "null_frac", "n_distinct", "most_common_vals", "most_common_freqs", none.alias("histogram_bounds"))
    for c in ("l_orderkey", "l_suppkey"):
        # a ratio for a column that grows with the table, a number for one that doesn't
        counts = items.groupBy(c).agg(F.count("*").alias("n")).agg(F.count(c).alias("d"), F.sum("n").alias("rows"), F.min(c).alias("low"), F.max(c).alias("high"))
        distinct = F.when(F.lit(c == "l_orderkey"), -F.col("d") / F.col("rows")).otherwise(F.col("d").cast("double"))
        bounds = F.concat(F.lit("{"), F.concat_ws(",", "low", F.bround((F.col("low") + F.col("high")) / 2).cast("bigint"), "high"), F.lit("}"))
        parts = parts.unionByName(counts.select(F.lit(c).alias("column_name"), F.lit(0.0).alias("null_frac"), distinct.alias("n_distinct"), none.alias("most_common_vals"), none.alias("most_common_freqs"), bounds.alias("histogram_bounds")))
    stored = parts.withColumns({"schema_name": F.lit("main"), "table_name": F.lit("lineitem")})
    size = sizes(items, "lineitem")
    return shown(catalog_statistics.with_statistics(model(spark, sf_dir, "lineitem"), catalog_statistics.from_postgresql(stored, size), size))


@BOOK.add(f"""
with n as (select count(*) as n from orders),
statuses as (select o_orderstatus as v, count(*) as k from orders group by 1),
known as (
  select 'o_orderstatus' as c, (select count(*) from statuses) as d, (select min(v) from statuses) as low, (select max(v) from statuses) as high, (select string_agg(v || ':' || k, ',' order by k desc, v) from statuses) as top
  union all select 'o_custkey', (select sum(d) from (select count(distinct o_custkey) as d from orders group by o_custkey // 100)), (select cast(min(o_custkey) as varchar) from orders), (select cast(max(o_custkey) as varchar) from orders), null
)
select 'main' as schema_name, 'orders' as table_name, m.c as column_name, m.t as type, n as row_count, case when k.c is not null then n end as total_row_count, case when k.c is not null then 0::bigint end as null_count, case when k.c is not null then n end as non_null_count,
       case when d < 20 then cast(d as bigint) end as distinct_count, case when d is not null then {BUCKET.format(n="d")} end as cardinality_bucket, low as min_value, high as max_value, top as top_values
from (values ('o_orderkey', 'bigint'), ('o_custkey', 'bigint'), ('o_orderstatus', 'string'), ('o_totalprice', 'double'), ('o_orderdate', 'timestamp_ntz'), ('o_orderpriority', 'string')) m(c, t) cross join n left join known k on k.c = m.c
""")
def catalog_statistics_mysql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from JSON histograms: one of single values in base64, one of buckets."""
    orders = table(spark, sf_dir, "orders")
    steps = profiling.singleton_histogram(orders, "o_orderstatus")
    encoded = F.concat(F.lit("base64:type254:"), F.base64(F.col("value").cast("binary")))
    single = steps.select(F.lit("o_orderstatus").alias("column_name"), F.lit("singleton").alias("kind"), F.col("value").alias("at"), F.array(encoded, F.col("cumulative").cast("string")).alias("bucket"))
    groups = orders.groupBy(F.floor(F.col("o_custkey") / 100).alias("g")).agg(F.min("o_custkey").alias("low"), F.max("o_custkey").alias("high"), F.count_distinct("o_custkey").alias("d"))
    tall = groups.select(F.lit("o_custkey").alias("column_name"), F.lit("equi-height").alias("kind"), F.format_string("%020d", "low").alias("at"), F.array(*(F.col(c).cast("string") for c in ("low", "high")), F.lit("0"), F.col("d").cast("string")).alias("bucket"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("at", "bucket"))), lambda x: x["bucket"])
    rows = single.unionByName(tall).groupBy("column_name", "kind").agg(F.to_json(listed).alias("buckets"))
    text = F.concat(F.lit('{"histogram-type": "'), "kind", F.lit('", "null-values": 0.0, "buckets": '), "buckets", F.lit("}"))
    stored = rows.select(F.lit("main").alias("schema_name"), F.lit("orders").alias("table_name"), "column_name", text.alias("histogram_json"))
    size = sizes(orders, "orders")
    return shown(catalog_statistics.with_statistics(model(spark, sf_dir, "orders"), catalog_statistics.from_mysql(stored, size), size))


@BOOK.add("""
with p as (select distinct 'orders_' || o_orderstatus as parent, 'orders_' || o_orderstatus || '_' || year(o_orderdate) as child from orders)
select 'main' as schema_name, parent as name, 'range partitioned' as strategy, 'o_orderdate,o_orderkey' as columns, string_agg(child, ',' order by child) as partition_tables from p group by parent
""")
def partition_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by status as tables, their years as partitions: the parents stay and name their children."""
    orders = table(spark, sf_dir, "orders").where("o_orderstatus is not null and o_orderdate is not null")
    parent = F.concat(F.lit("orders_"), "o_orderstatus")
    found = orders.select(parent.alias("table_name"), F.concat(parent, F.lit("_"), F.year("o_orderdate").cast("string")).alias("partition_table")).distinct()
    key = F.explode(F.array(*(F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name")) for i, c in ((2, "o_orderkey"), (1, "o_orderdate")))))
    rows = found.select(F.lit("main").alias("schema_name"), "table_name", F.lit("range partitioned").alias("partitioning_strategy"), "partition_table", key.alias("k")).select("schema_name", "table_name", "partitioning_strategy", "partition_table", "k.*")
    names = found.select("table_name").unionByName(found.select(F.col("partition_table").alias("table_name"))).distinct()
    relations = names.select(F.lit("main").alias("schema_name"), "table_name", F.lit("table").alias("kind"), F.lit(None).cast("string").alias("description"))
    none = lambda schema: spark.createDataFrame([], f"schema_name string, table_name string, {schema}")
    columns = none("ordinal_position int, column_name string, data_type string, is_nullable string, generated string, description string")
    keys, foreign = none("constraint_name string, position int, column_name string, validated boolean"), none("constraint_name string, position int, from_column string, ref_schema string, ref_table string, to_column string, on_update string, on_delete string")
    tables = catalog.assembled_tables(relations, columns, keys, foreign, partitions=rows)
    return tables.select("schema_name", "name", F.col("partition_info.strategy").alias("strategy"), F.array_join("partition_info.columns", ",").alias("columns"), F.array_join("partition_info.partition_tables", ",").alias("partition_tables"))


def paged_rows(docs: DataFrame) -> DataFrame:
    """Documents as printed tables: one by source and language, a row a document."""
    cells = F.array(F.col("doc_id").cast("string"), F.col("n_chars").cast("string"), F.substring("text", 1, 200))
    return docs.select("source", "lang", F.col("doc_id").alias("row_no"), F.concat(F.lit("Documents of "), "source").alias("caption"), F.array(*map(F.lit, ("id", "length", "beginning"))).alias("headers"), cells.alias("cells"))


@BOOK.add()
def paged_table_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paged.table_chunks(paged_rows(table(spark, sf_dir, "documents")), ["source", "lang"])


@BOOK.add(r"""
with b as (select doc_id, 'Source ' || source || ' in ' || lang as heading, string_split_regex(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') as w from documents where trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) <> ''),
s as (select doc_id, heading, w, unnest(case when len(w) + 4 <= 512 or len(w) <= 512 then [0] else range(0, cast(ceil((len(w) - 512) / 448.0) as bigint) + 1) end) as k from b)
select doc_id, cast(k as integer) as chunk_index, heading || chr(10) || array_to_string(case when len(w) + 4 <= 512 then w else list_slice(w, k * 448 + 1, k * 448 + 512) end, ' ') as embeddable_text from s
""")
def paged_text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    items = docs.select("doc_id", F.concat(F.lit("Source "), "source", F.lit(" in "), "lang").alias("heading"), F.col("text").alias("body"))
    return paged.text_chunks(items, ["doc_id"])


@BOOK.add()
def sketch_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of two versions of the order lines, merged without reading them again."""
    items = table(spark, sf_dir, "lineitem")
    halves = [sketches.sketched(items.where(f"l_orderkey % 2 = {k}"), f"v{k}") for k in (0, 1)]
    return sketches.estimated(sketches.merged(halves))
