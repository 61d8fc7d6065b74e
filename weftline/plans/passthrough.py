"""SQL that reaches the engine as it is: one statement for both sides wherever the dialects agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import joins
from weftline.operators.sql import run_recursive, run_sql
from weftline.plans.book import Book, table

BOOK = Book()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shared(name: str, sql: str, other: str | None = None) -> None:
    """A query that is its own oracle, or has another spelling there."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in TABLES:
            if t in sql:
                table(spark, sf_dir, t).createOrReplaceTempView(t)
        return run_sql(spark, sql)

    run.__name__ = name
    BOOK.add(other or sql)(run)


shared("sql_inner_join", "select c_mktsegment, o_orderpriority, count(*) as n, round(sum(o_totalprice), 2) as total from customer join orders on o_custkey = c_custkey group by c_mktsegment, o_orderpriority")
shared("sql_outer_joins", "select c.c_custkey, o.o_orderkey, n.n_name from customer c left join orders o on o.o_custkey = c.c_custkey and o.o_totalprice > 200000 right join nation n on n.n_nationkey = c.c_nationkey")
shared("sql_full_join", "select coalesce(a.k, b.k) as k, a.n as orders, b.n as balances from (select o_custkey as k, count(*) as n from orders where o_totalprice > 150000 group by o_custkey) a full join (select c_custkey as k, count(*) as n from customer where c_acctbal > 5000 group by c_custkey) b on a.k = b.k")
shared("sql_semi_join", "select c_custkey from customer c where exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_orderstatus = 'O')")
shared("sql_anti_join", "select c_custkey from customer c where not exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_totalprice > 100000)")
shared("sql_theta_join", "select s.s_suppkey, n.n_nationkey from supplier s join nation n on s.s_nationkey < n.n_nationkey where s.s_acctbal > 9000")
shared("sql_range_join", "select b.band, count(*) as n from orders join (values (0, 0, 50000), (1, 50000, 150000), (2, 150000, 1000000)) as b(band, low, high) on o_totalprice >= b.low and o_totalprice < b.high group by b.band")
shared("sql_cross_join", "select r.r_name, n.n_name from region r cross join nation n where n.n_nationkey < 3")
shared("sql_cube", "select l_returnflag, l_linestatus, count(*) as n, grouping(l_returnflag) as g from lineitem group by cube(l_returnflag, l_linestatus)", "select l_returnflag, l_linestatus, count(*) as n, cast(grouping(l_returnflag) as tinyint) as g from lineitem group by cube(l_returnflag, l_linestatus)")
shared("sql_rollup", "select c_mktsegment, c_nationkey, count(*) as n from customer group by rollup(c_mktsegment, c_nationkey)")
shared("sql_grouping_sets", "select o_orderstatus, o_orderpriority, count(*) as n from orders group by grouping sets ((o_orderstatus), (o_orderpriority), ())")
shared("sql_having", "select o_custkey, count(distinct o_orderpriority) as kinds from orders group by o_custkey having count(distinct o_orderpriority) >= 5")
shared(
    "sql_windows",
    "select o_orderkey, rank() over w as r, dense_rank() over w as d, ntile(4) over w as q, lag(o_totalprice) over w as before, lead(o_totalprice) over w as after, first_value(o_orderkey) over w as first, round(sum(o_totalprice) over (partition by o_orderpriority order by o_orderdate, o_orderkey rows between 2 preceding and current row), 2) as moving from orders window w as (partition by o_orderpriority order by o_orderdate, o_orderkey)",
)
shared("sql_union_all", "select c_custkey as k from customer where c_acctbal < 0 union all select s_suppkey from supplier where s_acctbal < 0")
shared("sql_set_operations", "(select c_nationkey as k from customer intersect select s_nationkey from supplier) except select n_nationkey from nation where n_regionkey = 1")
shared("sql_union_distinct", "select o_orderstatus as s from orders union select l_linestatus from lineitem")
shared("sql_json_path", "select event_id, get_json_object(props, '$.k') as k from events", "select event_id, json_extract_string(props, '$.k') as k from events")
shared("sql_dates", "select date_trunc('month', o_orderdate) as m, year(o_orderdate) as y, count(*) as n from orders group by 1, 2", "select date_trunc('month', o_orderdate)::timestamp as m, cast(year(o_orderdate) as integer) as y, count(*) as n from orders group by 1, 2")
shared("sql_arrays", "select vec_id, slice(embedding, 1, 3) as head, array_max(embedding) as top, size(embedding) as n from embeddings", "select vec_id, embedding[1:3] as head, list_max(embedding) as top, cast(len(embedding) as integer) as n from embeddings")
shared("sql_scalar_subquery", "select c_custkey from customer where c_acctbal > (select avg(c_acctbal) * 1.9 from customer)")
shared("sql_correlated_subquery", "select p_partkey from part p where p_retailprice > (select 1.2 * avg(q.p_retailprice) from part q where q.p_brand = p.p_brand)")
shared("sql_cte", "with t as (select o_custkey, sum(o_totalprice) as total from orders group by o_custkey) select c_mktsegment, count(*) as n from t join customer on c_custkey = o_custkey where total > 500000 group by c_mktsegment")
shared("sql_offset", "select o_orderkey from orders order by o_totalprice desc, o_orderkey limit 20 offset 10")
shared("sql_string_functions", "select c_custkey, upper(substr(c_name, 1, 4)) as a, concat(c_name, '-') as b, length(c_mktsegment) as c from customer where c_mktsegment like 'B%' or c_name like '%9'")
shared("sql_pricing_summary", "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc, round(avg(l_discount), 6) as avg_disc, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02 00:00:00' group by l_returnflag, l_linestatus", "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc, round(avg(l_discount), 6) as avg_disc, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02 00:00:00' group by l_returnflag, l_linestatus")
shared("sql_regional_revenue", "select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey and c_nationkey = s_nationkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by n_name")


@BOOK.add("with recursive t(k, d, total) as (select c_custkey, 0, c_acctbal from customer where c_custkey = 0 union all select c_custkey, d + 1, round(total + c_acctbal, 2) from t join customer on floor((c_custkey - 1) / 2) = k where c_custkey > 0) select k, d, round(total, 2) as total from t")
def sql_recursive_cte(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statement's two parts, level by level."""
    table(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    first = "select c_custkey as k, 0 as d, c_acctbal as total from customer where c_custkey = 0"
    each = "select c_custkey, d + 1, round(total + c_acctbal, 2) from {level} join customer on floor((c_custkey - 1) / 2) = k where c_custkey > 0"
    return run_recursive(spark, first, each).select("k", "d", F.round("total", 2).alias("total"))


@BOOK.add("select e.event_id, o.event_id as latest_purchase, o.value as latest_value from (select * from events where event_type = 'error') e asof left join (select user_id, ts, event_id, value from events where event_type = 'purchase') o on e.user_id = o.user_id and e.ts >= o.ts")
def as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    left = events.where("event_type = 'error'").select("event_id", "user_id", "ts")
    right = events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("latest_purchase"), F.col("value").alias("latest_value"))
    out = joins.as_of(left, right, ["user_id"], "ts", "at", "event_id", ["latest_purchase", "latest_value"], tie="latest_purchase")
    return out.select("event_id", "latest_purchase", "latest_value")


@BOOK.add("select a.event_id as a, b.event_id as b from events a join events b on a.user_id = b.user_id and a.event_type = 'view' and b.event_type = 'purchase' and b.ts between a.ts and a.ts + interval '6 hours'")
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    left = events.where("event_type = 'view'").select("user_id", F.col("ts").alias("t1"), F.col("event_id").alias("a"))
    right = events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("t2"), F.col("event_id").alias("b"))
    return joins.within(left, right, "user_id", "t1", "t2", 6 * 3600).select("a", "b")


@BOOK.add("select event_id, b as band from events join (values ('low', -1e9, 20.0), ('middle', 20.0, 60.0), ('high', 60.0, 1e9)) v(b, low, high) on value >= low and value < high")
def band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = spark.createDataFrame([("low", -1e9, 20.0), ("middle", 20.0, 60.0), ("high", 60.0, 1e9)], "band string, low double, high double")
    return joins.in_bands(table(spark, sf_dir, "events"), "value", bands).select("event_id", "band")


@BOOK.add("select user_id, " + ", ".join(f"count(*) filter (event_type = '{k}') as {k}" for k in ("click", "view")) + " from events group by 1")
def pivot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["click", "view"]).agg(F.count(F.lit(1)))
    return out.na.fill(0)


@BOOK.add("select s_suppkey, 'nation' as name, cast(s_nationkey as double) as value from supplier union all select s_suppkey, 'balance', s_acctbal from supplier")
def unpivot_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("double").alias("nation"), F.col("s_acctbal").alias("balance"))
    return s.unpivot(["s_suppkey"], ["nation", "balance"], "name", "value")


@BOOK.add("select p_brand, array_to_string(list_sort(list(distinct p_type)), ',') as types, count(*) as n from part group by 1")
def map_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by type gathered into a map, then its sorted keys and the sum of its values."""
    counts = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("c"))
    m = counts.groupBy("p_brand").agg(F.map_from_entries(F.collect_list(F.struct("p_type", "c"))).alias("m"))
    total = F.aggregate(F.map_values("m"), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return m.select("p_brand", F.array_join(F.array_sort(F.map_keys("m")), ",").alias("types"), total.alias("n"))
