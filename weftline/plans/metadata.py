"""Queries of the catalog operators, over the tables' own schemas and component rows that Spark derives from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text
from weftline.operators import catalog, chunking
from weftline.operators.catalog import Rule, Scope
from weftline.operators.sql import classified
from weftline.plans.book import Book, table
from weftline.sources import parquet_footer

BOOK = Book()

def values(rows: list[tuple]) -> str:
    show = lambda v: "null" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "(values " + ", ".join("(" + ", ".join(show(v) for v in r) + ")" for r in rows) + ")"


#: Component rows out of given tables: a customer is a table, its orders are the columns; every fifth is in the primary key, every third in one of two foreign keys.
MODEL = """
c as (select 't' || o_custkey as t, o_orderkey as p, 'c' || o_orderkey as c, o_orderpriority as ty, coalesce(o_orderstatus <> 'F', true) as nullable from orders where o_custkey is not null),
pk as (select t, list(c order by p) as k, arg_min(ty, p) as ty from c where p % 5 = 0 group by t),
fk as (select t, p % 2 as f, 'shop.u' || (p % 2) as r, list(c order by p) as froms, list('k' || p order by p) as tos from c where p % 3 = 0 group by t, p % 2)"""


def model(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Relations, columns, keys and foreign keys as a catalog would give them."""
    p, none = F.col("o_orderkey"), F.lit(None).cast("string")
    name = lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    rows = table(spark, sf_dir, "orders").where("o_custkey is not null")
    rows = rows.withColumns({"schema_name": F.lit("shop"), "table_name": name("t", F.col("o_custkey")), "position": p, "column_name": name("c", p)})
    relations = rows.select("schema_name", "table_name").distinct().withColumns({"kind": F.lit("TABLE"), "description": none})
    nullable = F.when(F.col("o_orderstatus") == "F", "NO").otherwise("YES")
    columns = rows.withColumns({"ordinal_position": p, "data_type": F.col("o_orderpriority"), "is_nullable": nullable, "generated": none, "description": none})
    keys = rows.where(p % 5 == 0).withColumns({"constraint_name": F.lit("pk"), "validated": F.lit(True)})
    ends = {"from_column": F.col("column_name"), "ref_schema": F.lit("shop"), "ref_table": name("u", p % 2), "to_column": name("k", p)}
    foreign = rows.where(p % 3 == 0).withColumns({"constraint_name": name("f", p % 2), **ends, "on_update": none, "on_delete": none})
    return relations, columns, keys, foreign


@BOOK.add(f"with {MODEL} select t as table_name, 'pk' as constraint_name, array_to_string(k, ',') as columns from pk")
def constraint_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.assembled_keys(model(spark, sf_dir)[2]).select("table_name", "constraint_name", F.array_join("columns", ",").alias("columns"))


@BOOK.add(f"with {MODEL} select t as table_name, 'f' || f as constraint_name, r as referenced_table, array_to_string(list_transform(list_zip(froms, tos), lambda x: x[1] || '>' || x[2]), ',') as mapping from fk")
def foreign_key_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = F.array_join(F.transform("mapping", lambda m: F.concat(m["from_column"], F.lit(">"), m["to_column"])), ",")
    return catalog.assembled_foreign_keys(model(spark, sf_dir)[3]).select("table_name", "constraint_name", "referenced_table", mapping.alias("mapping"))


@BOOK.add(f"""
with {MODEL},
cols as (select t, list(c order by p) as names, count(*) as n from c group by t),
targets as (select t, list(r order by f) as r from fk group by t),
own as (
  select cols.t as table_name, -1 as position, concat_ws('. ',
    cols.t || ' is a database table with ' || n || ' columns',
    case when len(k) = 1 then 'Its primary key is the column ' || k[1] || ' of type ' || pk.ty when len(k) > 1 then 'Its primary key is composed of the columns (' || array_to_string(k, ', ') || ')' end,
    case when len(r) = 1 then 'The column has a foreign key to ' || r[1] when len(r) = 2 then 'The table has foreign keys to ' || r[1] || ' and ' || r[2] end,
    case when n > 50 then 'Here are the first 50 columns for the table: ' || array_to_string(names[1:50], ', ') else 'Here is the full list of columns for the table: ' || array_to_string(names, ', ') end) as embeddable_text
  from cols left join pk on pk.t = cols.t left join targets on targets.t = cols.t),
each as (
  select c.t as table_name, cast(row_number() over (partition by c.t order by p) - 1 as integer) as position, concat_ws('. ',
    c.c || ' is a column with type ' || c.ty || ' in the table ' || c.t,
    case when nullable then 'It can contain null values' else 'It can not contain null values' end,
    case when p % 5 = 0 and len(k) = 1 then 'It is the primary key of the table' when p % 5 = 0 then 'It is part of the primary key of the table' end,
    case when p % 3 = 0 and len(froms) = 1 then 'This column is a foreign key to ' || r || '.k' || p when p % 3 = 0 then 'This column is part of a foreign key to ' || r end) as embeddable_text
  from c left join pk on pk.t = c.t left join fk on fk.t = c.t and fk.f = p % 2)
select * from own union all select * from each
""")
def database_chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    relations, columns, keys, foreign = model(spark, sf_dir)
    return chunking.table_chunks(catalog.assembled_tables(relations, columns, keys, foreign)).select("table_name", "position", "embeddable_text")


@BOOK.add("""
select r_name as catalog, n_name as schema_name from region join nation on n_regionkey = r_regionkey
where lower(n_name) not in ('nation_3') and (lower(r_name) glob 'a*' or lower(n_name) glob '*_1[0-9]')
  and not (lower(n_name) glob '*_?' and lower(n_name) not glob '*_5')
""")
def scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _names(spark, sf_dir)
    scope = Scope([Rule(catalog="A*"), Rule(schemas=["*_1[0-9]"])], [Rule(schemas=["*_?"], except_schemas=["*_5"])], ("NATION_3",))
    return names.where(scope.keeps(F.col("catalog"), F.col("schema_name")))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("catalog"), F.col("n_name").alias("schema_name"))


@BOOK.add("""
select c_mktsegment as catalog, 'nation' || c_nationkey as schema_name, c_name as table_name from customer
where (lower('nation' || c_nationkey) glob 'nation1*' and lower(c_name) glob '*[13579]') and not (lower(c_mktsegment) glob 'b*' and lower(c_name) not glob '*11')
""")
def sampling_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("catalog"), F.concat(F.lit("nation"), F.col("c_nationkey").cast("string")).alias("schema_name"), F.col("c_name").alias("table_name"))
    scope = Scope([Rule(schemas=["nation1*"], tables=["*[13579]"])], [Rule(catalog="b*", except_tables=["*11"])])
    return names.where(scope.keeps(F.col("catalog"), F.col("schema_name"), F.col("table_name")))


@BOOK.add("select p_partkey, p_name from part where p_name glob '*a*' and p_brand glob '*1?' or p_partkey = 7")
def resource_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    fields = {"unique_id": F.col("p_partkey").cast("string"), "name": F.col("p_name"), "schema": F.col("p_brand")}
    return part.where(catalog.resource_matches([{"name": "*a*", "schema": "*1?"}, "7"], fields)).select("p_partkey", "p_name")


@BOOK.add("select l.l_orderkey, l.l_linenumber from lineitem l where not exists (select 1 from orders o where o.o_orderkey = l.l_orderkey and o.o_totalprice > 1000)")
def foreign_key_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_totalprice > 1000")
    return catalog.orphans(table(spark, sf_dir, "lineitem"), "l_orderkey", orders, "o_orderkey").select("l_orderkey", "l_linenumber")


@BOOK.add("select o_custkey, o_orderstatus, count(*) as n from orders group by all having count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.duplicated_keys(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus")


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@BOOK.add("select table_name, cast(ordinal_position as integer) as ordinal_position, column_name from information_schema.columns where table_name in (" + ", ".join(f"'{t}'" for t in TABLES) + ") and table_schema = 'main'")
def introspected_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tables' columns in order, from their schemas alone."""
    rows = reduce(DataFrame.unionByName, [catalog.schema_columns(table(spark, sf_dir, t), "main", t) for t in TABLES])
    return rows.select("table_name", (F.col("ordinal_position") + 1).alias("ordinal_position"), "column_name")


RANGED = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax".split()


@BOOK.add(" union all ".join(f"select '{c}' as column_name, count(*) as num_values, cast(count(*) - count({c}) as bigint) as null_count, cast(min({c}) as double) as least, cast(max({c}) as double) as most from lineitem" for c in RANGED))
def parquet_footer_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values, nulls and true extremes of numeric columns out of the files' footers."""
    return parquet_footer.ranges(parquet_footer.row_groups(spark, f"{sf_dir}/lineitem.parquet").where(F.col("column_name").isin(RANGED)))


@BOOK.add()
def parquet_footers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parquet_footer.columns(parquet_footer.row_groups(spark, f"{sf_dir}/orders.parquet"))


@BOOK.add("""
select c_custkey, case when length(c_name) > 10 then left(c_name, 10) || '…[truncated, 10/' || length(c_name) || ']' else c_name end as short,
       case lower(trim(c_mktsegment)) when 'building' then true else true end as flag from customer
""")
def sample_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", text.truncated(F.col("c_name"), 10).alias("short"), text.coerced_bool(F.col("c_mktsegment")).alias("flag"))


# Statements and what they are.
STATEMENTS = [
    ("SELECT 1", "READ_ONLY"),
    ("select * from t", "READ_ONLY"),
    ("WITH x AS (SELECT 1) SELECT * FROM x", "READ_ONLY"),
    ("EXPLAIN SELECT 1", "READ_ONLY"),
    ("SHOW TABLES", "READ_ONLY"),
    ("VALUES (1)", "READ_ONLY"),
    ("SELECT 'DROP TABLE t'", "READ_ONLY"),
    ("SELECT 1 -- DELETE", "READ_ONLY"),
    ("SELECT /* INSERT */ 1", "READ_ONLY"),
    ("SELECT 1;", "READ_ONLY"),
    ("INSERT INTO t VALUES (1)", "WRITE"),
    ("WITH x AS (DELETE FROM t RETURNING *) SELECT * FROM x", "WRITE"),
    ("SELECT 1; DROP TABLE t", "WRITE"),
    ("SELECT * INTO u FROM t", "WRITE"),
    ("EXPLAIN ANALYZE DELETE FROM t", "WRITE"),
    ("SELECT * FROM t FOR UPDATE", "WRITE"),
    ("PRAGMA x", "WRITE"),
    ("CREATE TABLE t (a INT)", "WRITE"),
    ("", "UNKNOWN"),
    ("-- nothing", "UNKNOWN"),
    (";", "UNKNOWN"),
]


@BOOK.add(f"select event_id, k as kind from events join (select s, k, row_number() over () - 1 as i from {values(STATEMENTS)} v(s, k)) on event_id % {len(STATEMENTS)} = i")
def statement_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each logged statement is: an event's type stands in a comment before one of the statements, its properties in one behind it."""
    said = F.element_at(F.array(*[F.lit(s) for s, _ in STATEMENTS]), (F.col("event_id") % len(STATEMENTS) + 1).cast("int"))
    part = lambda c: F.coalesce(F.col(c), F.lit(""))
    logged = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("/* "), part("event_type"), F.lit(" */ "), said, F.lit(" -- "), part("props")).alias("statement"))
    return logged.select("event_id", classified(F.col("statement")).alias("kind"))


@BOOK.add("""
select 't' || l_orderkey as table_name, 'i' || l_returnflag as index_name, array_to_string(list('p' || l_partkey order by l_linenumber, 'p' || l_partkey), ',') as columns, l_returnflag = 'R' as is_unique
from lineitem group by l_orderkey, l_returnflag
""")
def index_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a table, its lines with one flag are an index; one flag means unique, one not, one says nothing."""
    flag = F.col("l_returnflag")
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    unique = F.when(flag == "R", "YES").when(flag == "A", "0")
    own = [F.lit("shop").alias("schema_name"), name("t", "l_orderkey").alias("table_name"), name("i", "l_returnflag").alias("index_name")]
    rows = table(spark, sf_dir, "lineitem").select(*own, F.col("l_linenumber").alias("position"), name("p", "l_partkey").alias("expr"), unique.alias("is_unique"), F.lit("btree").alias("method"))
    return catalog.assembled_indexes(rows).select("table_name", "index_name", F.array_join("columns", ",").alias("columns"), F.col("unique").alias("is_unique"))


@BOOK.add(f"with {MODEL} select t as table_name, array_to_string(list(c order by p), ',') as columns, count(*) filter (not nullable) as required from c group by t")
def column_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog.assembled_columns(model(spark, sf_dir)[1])
    names = F.array_join(F.transform("columns", lambda c: c["name"]), ",")
    required = F.size(F.filter("columns", lambda c: ~c["nullable"])).cast("bigint")
    return found.select("table_name", names.alias("columns"), required.alias("required"))


@BOOK.add("select r_name as schema_name, array_to_string(list(n_name order by n_name), ',') as tables from region join nation on n_regionkey = r_regionkey group by 1")
def browse_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _names(spark, sf_dir).select(F.col("catalog").alias("schema_name"), F.col("schema_name").alias("name"), F.lit(None).cast("string").alias("description"))
    return catalog.browse(tables).select("schema_name", F.array_join(F.transform("tables", lambda t: t["name"]), ",").alias("tables"))


@BOOK.add("""
select r_name, case when len(n) = 1 then n[1] else array_to_string(n[1:len(n) - 1], ', ') || ' and ' || n[-1] end as joined
from (select r_name, list(n_name order by n_name) as n from region join nation on n_regionkey = r_regionkey group by 1)
""")
def names_with_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = _names(spark, sf_dir).groupBy(F.col("catalog").alias("r_name")).agg(F.array_sort(F.collect_list("schema_name")).alias("n"))
    return grouped.select("r_name", text.joined_with_last(F.col("n"), " and ").alias("joined"))


PARSED = """
case p_partkey % 4 when 0 then 'ref(''model.' || p_partkey || ''')' when 1 then 'ref("' || p_name || '")' when 2 then '{' || p_type || ',' || p_size || ',' || p_brand || '}'
     else case when p_size > 25 then 'VIEW' else '{}' end end"""


@BOOK.add(f"""
select p_partkey, s, nullif(regexp_extract(s, '^ref\\([''"]([A-Za-z0-9_.]+)[''"]\\)$', 1), '') as r, case when s = '{{}}' then 0 else cast(len(string_split(s, ',')) as integer) end as n, case s when 'VIEW' then 'view' else 'table' end as k
from (select p_partkey, {PARSED} as s from part)
""")
def small_parsers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References, array literals and kinds of data sets read out of texts."""
    key, said = F.col("p_partkey"), lambda c: F.col(c).cast("string")
    reference = F.concat(F.lit("ref('model."), said("p_partkey"), F.lit("')"))
    literal = F.concat(F.lit("{"), "p_type", F.lit(","), said("p_size"), F.lit(","), "p_brand", F.lit("}"))
    quoted, other = F.concat(F.lit('ref("'), "p_name", F.lit('")')), F.when(F.col("p_size") > 25, "VIEW").otherwise("{}")
    s = F.when(key % 4 == 0, reference).when(key % 4 == 1, quoted).when(key % 4 == 2, literal).otherwise(other)
    rows = table(spark, sf_dir, "part").select("p_partkey", s.alias("s"))
    s = F.col("s")
    return rows.select("p_partkey", "s", text.ref_target(s).alias("r"), F.size(text.array_literal(s)).alias("n"), catalog.dataset_kind(s).alias("k"))


@BOOK.add("select 'Model ' || p_name || ' in database shop and schema ' || p_brand || ', with unique id model.' || p_partkey as model, 'Column ' || p_type || ' in model model.' || p_partkey as model_column, 'Metric ' || p_name || ' with id m' || p_partkey || case when p_size > 20 then ', depending on semantic model s' || p_size else '' end as metric from part")
def dbt_chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.lit("model."), F.col("p_partkey").cast("string"))
    semantic = F.when(F.col("p_size") > 20, F.concat(F.lit("s"), F.col("p_size").cast("string")))
    return table(spark, sf_dir, "part").select(
        chunking.model_text(F.col("p_name"), F.lit("shop"), F.col("p_brand"), key).alias("model"),
        chunking.model_column_text(F.col("p_type"), key).alias("model_column"),
        chunking.metric_text(F.col("p_name"), F.concat(F.lit("m"), F.col("p_partkey").cast("string")), semantic).alias("metric"),
    )


@BOOK.add("select 'Column [name = ' || c || ', type = INT64, number of values = ' || n || '] in parquet file orders.parquet' as embeddable_text from (select 'o_orderkey' as c, count(*) as n from orders union all select 'o_custkey', count(*) from orders)")
def parquet_chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parquet_footer.columns(parquet_footer.row_groups(spark, f"{sf_dir}/orders.parquet")).where("physical_type = 'INT64' and column_name like '%key'")
    return found.select(chunking.parquet_column_text(F.col("column_name"), F.col("physical_type"), F.col("num_values"), F.col("file_name")).alias("embeddable_text"))


@BOOK.add("""
with f as (select 'k' || (l_orderkey % 40) as constraint_name, l_linenumber as position, 'c' || l_linenumber as c, 'r' || l_linenumber as r from lineitem where l_orderkey < 40)
select constraint_name, position, c as from_column, r as to_column from f
""")
def aligned_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two arrays of a key unfolded side by side with their position."""
    f = table(spark, sf_dir, "lineitem").where("l_orderkey < 40").select(F.concat(F.lit("k"), (F.col("l_orderkey") % 40).cast("string")).alias("constraint_name"), F.struct(F.col("l_linenumber").alias("p"), F.concat(F.lit("c"), F.col("l_linenumber").cast("string")).alias("c"), F.concat(F.lit("r"), F.col("l_linenumber").cast("string")).alias("r")).alias("x"))
    keys = f.groupBy("constraint_name").agg(F.array_sort(F.collect_list("x")).alias("x")).select("constraint_name", F.col("x.p").alias("p"), F.col("x.c").alias("c"), F.col("x.r").alias("r"))
    flat = keys.select("constraint_name", F.explode(F.arrays_zip("p", "c", "r")).alias("z"))
    return flat.select("constraint_name", F.col("z.p").alias("position"), F.col("z.c").alias("from_column"), F.col("z.r").alias("to_column"))
