"""Ordering, measures, catalog statistics, partitions, paged chunks, sketches and footers on small fixtures."""

import base64
import json
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from weftline.domain import Domain
from weftline.operators import catalog, joins, measures, ordering, paged, perf, profiling, sketches
from weftline.operators import catalog_statistics as stats
from weftline.sources import introspection, parquet_footer

# Ordering


def test_numbered_with_nulls_and_ties(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice([None, None, 1, 2, 3])) for k in range(500)]
    table = spark.createDataFrame(rows, "id int, v int").repartition(5)
    found = {r.id: r.place for r in ordering.numbered(table, [F.col("v").isNull().asc(), F.asc("v"), F.asc("id")], "place").collect()}
    expected = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0]))
    assert found == {k: place for place, (k, _) in enumerate(expected)}
    assert ordering.numbered(table.limit(0), [F.asc("id")], "place").count() == 0


def test_runs_without_a_start_are_spread(spark):
    runs = spark.range(2000).selectExpr("cast(id as string) as run_id", "cast(null as timestamp) as start_dt")
    out = perf.numbered_runs(runs)
    assert sorted(r.run_index for r in out.collect()) == list(range(2000))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "windowspecdefinition(_day" not in plan and plan.count("Window [") <= 2  # over ranges, not over runs


@pytest.mark.parametrize("k", [0, 1, 3, 7, 100])
def test_top_with_ties(spark, k):
    rng = random.Random(k)
    rows = [(i, rng.choice([None, 1, 2, 3]), rng.choice([None, 0.5, 1.5])) for i in range(40)]
    table = spark.createDataFrame(rows, "id int, a int, b double")
    key = lambda r: (r[1] is None, -(r[1] or 0), r[2] is None, r[2] or 0)
    first = sorted(rows, key=key)
    expected = {r[0] for r in rows if k and key(r) <= key(first[min(k, len(rows)) - 1])}
    assert {r.id for r in ordering.top_with_ties(table, [("a", True), ("b", False)], k).collect()} == expected
    assert ordering.top_with_ties(table.limit(0), [("a", True)], k).count() == 0


def test_latest_groups_and_ranks(spark):
    table = spark.createDataFrame([("a", 1), ("a", 9), ("b", 5), ("c", 9), ("d", None), (None, 99)], "g string, t int")
    assert sorted(r.g for r in ordering.latest_groups(table, "g", "t", 2).collect()) == ["a", "a", "c"]
    ranked = ordering.ranked_with_ties(spark.createDataFrame([("a", 1), ("a", 1), ("a", 0), ("b", 2)], "g string, v int"), ["g"], [("v", True)], 1)
    assert sorted((r.g, r.v) for r in ranked.collect()) == [("a", 1), ("a", 1), ("b", 2)]


def test_as_of_numbers_with_null_keys_and_a_hot_key(spark):
    rng = random.Random(2)
    left = [(i, rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([None, *range(100)])) for i in range(400)]
    right = [(rng.choice(["hot", "hot", "c", None]), rng.choice([None, *range(100)]), i) for i in range(300)]
    out = joins.as_of(spark.createDataFrame(left, "id bigint, k string, t int"), spark.createDataFrame(right, "k string, at int, v bigint"), ["k"], "t", "at", "id", ["v"], tie="v")
    found = {r.id: r.v for r in out.collect()}
    for i, k, t in left:
        before = [(at, v) for kk, at, v in right if k is not None and t is not None and kk == k and at is not None and at <= t]
        assert found[i] == (max(before)[1] if before else None)


def test_repeated_spans_count_once(spark):
    chain = [("r", f"s{i}", f"s{i - 1}" if i else None) for i in range(12)]
    spans = spark.createDataFrame(chain * 2, "run_id string, span_id string, parent_span_id string")
    assert sorted((r.depth, r.span_id) for r in perf.span_depths(spans).collect()) == [(i, f"s{i}") for i in range(12)]


# Measures


def test_measures(spark):
    with pytest.raises(ValueError):
        measures.Measure("x", "mode")
    with pytest.raises(ValueError):
        measures.Measure("x", "percentile")
    rows = spark.createDataFrame([("a", 1.0, True), ("a", 3.0, False), (None, 5.0, True), (None, None, None), ("b", None, None)], "g string, v double, ok boolean")
    declared = [{"name": "v", "agg": "sum"}, {"name": "good", "agg": "sum_boolean", "expr": "ok"}, {"name": "mid", "agg": "median", "expr": "v"}, {"name": "low", "agg": "percentile", "expr": "v", "agg_params": {"percentile": 0.5, "use_discrete_percentile": True}}, {"name": "near", "agg": "percentile", "expr": "v", "agg_params": {"percentile": 0.5, "use_approximate_percentile": True}}]
    found = {r.g: (r.v, r.good, r.mid, r.low, r.near) for r in measures.compiled(rows, declared, ["g"]).collect()}
    assert found == {"a": (4.0, 1, 2.0, 1.0, 1.0), None: (5.0, 1, 5.0, 5.0, 5.0), "b": (None, 0, None, None, None)}
    (total,) = measures.compiled(rows, declared, []).collect()
    assert (total.v, total.mid, total.low) == (9.0, 3.0, 3.0)
    assert [r.mid for r in measures.compiled(rows.limit(0), declared[2:3], []).collect()] == [None]


# Catalog statistics


def test_postgresql_statistics(spark):
    rows = [
        ("s", "t", "status", 0.0, 2.0, "{active,inactive}", "{0.7,0.3}", None),
        ("s", "t", "category", 0.2, -0.02, "{A,B}", "{0.5,0.3}", None),
        ("s", "t", "value", None, 0.0, "broken", "{x}", "{1,50,100}"),
        ("s", "gone", "c", 0.5, 9.0, "{a}", "{1}", "{}"),
    ]
    columns = spark.createDataFrame(rows, "schema_name string, table_name string, column_name string, null_frac double, n_distinct double, most_common_vals string, most_common_freqs string, histogram_bounds string")
    found = {r.column_name: r for r in stats.from_postgresql(columns, spark.createDataFrame([("s", "t", 100)], "schema_name string, table_name string, row_count bigint")).collect()}
    tops = {c: r.top_values and [(v.value, v.frequency) for v in r.top_values] for c, r in found.items()}
    assert tops == {"status": [("active", 70), ("inactive", 30)], "category": [("A", 50), ("B", 30)], "value": None, "c": None}
    assert (found["status"].distinct_count, found["category"].distinct_count, found["value"].distinct_count) == (2, 2, None)
    assert (found["category"].null_count, found["category"].non_null_count, found["value"].null_count) == (20, 80, None)
    assert (found["value"].min_value, found["value"].max_value, found["value"].cardinality_bucket) == ("1", "100", "unknown")
    assert (found["c"].total_row_count, found["c"].distinct_count, found["c"].min_value) == (None, None, None)


def test_mysql_statistics_join_the_model(spark):
    coded = lambda s: "base64:type254:" + base64.b64encode(s.encode()).decode()
    rows = [
        ("s", "t", "name", json.dumps({"histogram-type": "singleton", "null-values": 0.25, "buckets": [[coded("ä"), 0.25], [coded("b"), 0.75]]})),
        ("s", "t", "price", json.dumps({"histogram-type": "equi-height", "null-values": 0.0, "buckets": [[1.5, 10.5, 0.5, 4], [11, 50.0, 1.0, 30]]})),
        ("s", "t", "empty", json.dumps({"histogram-type": "equi-height", "buckets": []})),
        ("s", "t", "torn", "{"),
        ("s", "other", "c", json.dumps({"histogram-type": "singleton", "buckets": [["base64:type:!", 1.0]]})),
    ]
    columns = spark.createDataFrame(rows, "schema_name string, table_name string, column_name string, histogram_json string")
    sizes = spark.createDataFrame([("s", "t", 8)], "schema_name string, table_name string, row_count bigint")
    found = stats.from_mysql(columns, sizes)
    by = {r.column_name: r for r in found.collect()}
    assert by.keys() == {"name", "price", "empty", "c"}
    assert [(v.value, v.frequency) for v in by["name"].top_values] == [("b", 4), ("ä", 2)]
    assert (by["name"].min_value, by["name"].max_value, by["name"].distinct_count, by["name"].null_count, by["name"].non_null_count) == ("ä", "b", 2, 2, 6)
    assert (by["price"].distinct_count, by["price"].cardinality_bucket, by["price"].min_value, by["price"].max_value) == (None, "20-49", "1.5", "50.0")
    assert (by["empty"].cardinality_bucket, by["empty"].min_value, by["c"].total_row_count, by["c"].min_value) == ("0", None, 0, None)
    tables = spark.createDataFrame([("s", "t", [("name", "varchar"), ("other", "int")])], "schema_name string, name string, columns array<struct<name:string,type:string>>")
    joined = {r.column_name: r for r in stats.with_statistics(tables, found, sizes).collect()}
    assert (joined["name"].total_row_count, joined["name"].row_count, joined["other"].total_row_count, joined["other"].row_count) == (8, 8, None, 8)


# Catalog assembly


def test_partitions_belong_to_their_parent(spark):
    parts = introspection.components(spark, "athena", lambda q: spark.createDataFrame([], "x string"))
    relations = spark.createDataFrame([("s", n, "table", None) for n in ("sales", "sales_2023", "sales_2024")], parts["relations"].schema)
    columns = spark.createDataFrame([("s", n, 1, "id", "int", "no", "7", None, None) for n in ("sales", "sales_2023")], parts["columns"].schema)
    rows = [("s", "sales", "range partitioned", p, c, child) for p, c in ((1, "day"), (2, "id")) for child in ("sales_2024", "sales_2023")] + [("s", "bare", "hash partitioned", 1, None, None)]
    tables = {r.name: r for r in catalog.assembled_tables(**(parts | {"relations": relations, "columns": columns, "partitions": spark.createDataFrame(rows, parts["partitions"].schema)})).collect()}
    assert tables.keys() == {"sales", "bare"}
    assert tables["sales"].partition_info.asDict() == {"strategy": "range partitioned", "columns": ["day", "id"], "partition_tables": ["sales_2023", "sales_2024"]}
    assert tables["bare"].partition_info.partition_tables == [] and tables["sales"].columns[0].default_expression == "7"


def test_details_of_keys_and_indexes(spark):
    foreign = spark.createDataFrame([("s", "t", "f", 1, "a", "s", "u", "b", None, None, False, None)], "schema_name string, table_name string, constraint_name string, position int, from_column string, ref_schema string, ref_table string, to_column string, on_update string, on_delete string, enforced boolean, validated boolean")
    (key,) = catalog.assembled_foreign_keys(foreign).collect()
    assert (key.enforced, key.validated) == (False, True)
    (key,) = catalog.assembled_foreign_keys(foreign.drop("enforced", "validated")).collect()
    assert (key.enforced, key.validated) == (True, True)
    index = spark.createDataFrame([("s", "t", "i", 1, "a DESC", "no", "btree", "a > 0")], "schema_name string, table_name string, index_name string, position int, expr string, is_unique string, method string, predicate string")
    assert [r.predicate for r in catalog.assembled_indexes(index).collect()] == ["a > 0"]


@pytest.mark.parametrize("dialect", ["postgresql", "mssql", "mysql"])
def test_every_catalog_query_gives_its_contract(dialect):
    """No server is here: the names that each statement gives out are those of the contract."""
    for name, query in introspection.DIALECTS[dialect].items():
        wanted = [c.split()[0] for c in introspection.CONTRACT[name].split(", ")]
        given = query.split(" from ")[0].replace("\n", " ").replace("`", "")
        assert "schema_name" in given and any(f"as {c}" in given or f".{c}" in given or f" {c}" in given for c in wanted)
        assert query.count("(") == query.count(")")
    if dialect == "postgresql":
        assert all("relispartition" in q for n, q in introspection.DIALECTS[dialect].items() if n != "partitions")


# Paged chunks


def folded(caption, headers, rows, budget):
    """One table's texts, with all of it at hand."""
    named = [f"TABLE: {caption}"]
    whole = "\n".join([*named, "| " + " | ".join(headers) + " |", "|" + "-|" * len(headers), *("| " + " | ".join(c.strip() for c in r) + " |" for r in rows)])
    if paged.tokens_of(whole) <= budget:
        return [whole]
    base = "\n".join([*named, "COLUMNS: " + " | ".join(headers)]) + "\nROWS:\n"
    out, held = [], []
    for r in rows:
        line = "- " + " | ".join(c.strip() for c in r)
        if paged.tokens_of(base + "\n".join([*held, line])) <= budget:
            held.append(line)
        elif held:
            out.append(base + "\n".join(held))
            held = [line]
        else:
            out.append((base + line)[:6000] + "\n…[TRUNCATED]…")
    return out + ([base + "\n".join(held)] if held else [])


def test_table_chunks_equal_a_loop(spark):
    rng = random.Random(4)
    tables = {}
    for t in range(12):
        n = rng.choice([1, 2, 30])
        tables[t] = [(str(k), " ".join(rng.choice(["word", "über", "a-b", "x"]) for _ in range(rng.choice([0, 1, 5, 40, 90])))) for k in range(n)]
    tables[12] = [("0", "y" * 7000 + " z" * 200), ("1", "end")]
    flat = [(t, k, f"cap {t}", ["id", "text"], list(r)) for t, rows in tables.items() for k, r in enumerate(rows)]
    rng.shuffle(flat)
    schema = "doc int, row_no int, caption string, headers array<string>, cells array<string>"
    out = paged.table_chunks(spark.createDataFrame(flat, schema).repartition(4), ["doc"], 60)
    found = {}
    for r in sorted(out.collect(), key=lambda r: (r.doc, r.chunk_index)):
        found.setdefault(r.doc, []).append(r.embeddable_text)
    assert found == {t: folded(f"cap {t}", ["id", "text"], rows, 60) for t, rows in tables.items()}
    assert paged.table_chunks(spark.createDataFrame([], schema), ["doc"], 60).count() == 0
    odd = spark.createDataFrame([(None, 1, None, None, None), (None, 2, None, ["a"], [None, "x"])], schema)
    assert [(r.doc, r.chunk_index) for r in paged.table_chunks(odd, ["doc"], 60).collect()] == [(None, 0)]
    paged.register(spark)
    spark.createDataFrame(flat, schema).createOrReplaceTempView("printed_rows")
    assert spark.sql("select * from table_chunks(TABLE(printed_rows), 60)").count() == sum(map(len, found.values()))


def test_text_chunks(spark):
    items = spark.createDataFrame([(1, "Head", "a b  c"), (2, "Head", " ".join(map(str, range(25)))), (3, None, None), (4, "", "x"), (5, "Only heading", " ")], "doc int, heading string, body string")
    found = {(r.doc, r.chunk_index): r.embeddable_text for r in paged.text_chunks(items, ["doc"], 10, 2).collect()}
    assert found[1, 0] == "Head\na b c" and found[4, 0] == "x"
    assert [found[2, k] for k in range(3)] == ["Head\n" + " ".join(map(str, range(s, min(s + 10, 25)))) for s in (0, 8, 16)]
    assert {d for d, _ in found} == {1, 2, 4}


# Sketches


def test_sketches_add_up(spark):
    table = spark.range(20_000).selectExpr("id", "id % 700 as g", "if(id % 4 = 0, null, concat('s', id % 3000)) as s", "cast(id as double) / 7 as x")
    whole = {r.column_name: r for r in sketches.estimated(sketches.sketched(table, "w")).collect()}
    halves = [sketches.sketched(table.where(f"id % 2 = {k}"), str(k)) for k in (0, 1)]
    merged = {r.column_name: r for r in sketches.estimated(sketches.merged(halves)).collect()}
    for c, true in (("id", 20_000), ("g", 700), ("s", table.select("s").distinct().count() - 1), ("x", 20_000)):
        assert whole[c].non_null_count == merged[c].non_null_count and whole[c].min_text == merged[c].min_text and whole[c].max_text == merged[c].max_text
        for found in (whole[c], merged[c]):
            assert abs(found.distinct_count - true) <= 0.03 * true
    for p, q in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99)):
        assert abs(merged["id"][p] - q * 20_000) <= 0.02 * 20_000
    assert merged["id"].max_text == "19999" and merged["s"].p50 is None and merged["s"].null_count == 5000


def test_sampled_sketches_scale(spark, tmp_path):
    table = spark.range(50_000).selectExpr("id", "if(id % 5 = 0, null, id) as v")
    found = {r.column_name: r for r in sketches.estimated(sketches.adaptive(table, "t"), total=50_000).collect()}
    assert abs(found["v"].null_count - 10_000) <= 1500 and found["id"].row_count == 50_000
    with pytest.raises(Exception, match="rates"):
        sketches.merged([sketches.sketched(table, "a"), sketches.sketched(table, "b", 0.5)]).collect()
    table.write.parquet(str(tmp_path / "data" / "t.parquet"))
    domain = Domain.create(spark, str(tmp_path / "d"))
    (tmp_path / "d" / "src" / "s.yaml").write_text(f"type: parquet\npath: {tmp_path / 'data'}\nprofiling: sampled\n")
    assert [r.status for r in domain.build()] == ["OK"]
    assert {s["column_name"] for s in domain.context("s.yaml")["tables"][0]["stats"]} == {"id", "v"}


# Footers


def test_footers_and_zone_maps(spark, tmp_path):
    for k in range(3):
        pq.write_table(pa.table({"id": list(range(100 * k, 100 * k + 100)), "s": ["x", None] * 50}), tmp_path / f"f{k}.parquet", row_group_size=40)
    groups = parquet_footer.row_groups(spark, str(tmp_path))
    assert groups.count() == 3 * 3 * 2
    assert "binaryFile" not in groups._jdf.queryExecution().toString()
    found = {r.column_name: r for r in parquet_footer.ranges(groups).collect()}
    assert (found["id"].least, found["id"].most, found["id"].num_values, found["s"].null_count) == (0.0, 299.0, 300, 150)
    assert sorted(tuple(r) for r in parquet_footer.holding(groups, "id", 95, 139).collect()) == [("f0.parquet", 2), ("f1.parquet", 0)]
    assert parquet_footer.holding(groups, "id", 1000).count() == 0 and parquet_footer.holding(groups, "id").count() == 9


def test_profiles_still_exact(spark):
    assert profiling.profile(spark.range(5).toDF("a"), "t").first().distinct_count == 5


def test_sums_of_fractions_do_not_depend_on_the_order_of_rows(spark):
    declared = [{"name": "s", "agg": "sum", "expr": "v"}, {"name": "a", "agg": "average", "expr": "v"}, {"name": "big", "agg": "sum", "expr": "v * 1e30"}]
    (one,) = measures.compiled(spark.createDataFrame([(0.1,)] * 10 + [(None,)], "v double").coalesce(1), declared, []).collect()
    assert (one.s, one.a) == (1.0, 0.1)  # added one after another: 0.9999999999999999
    assert one.big == pytest.approx(1e30)
    none, some = measures.compiled(spark.createDataFrame([(1, None), (2, float("inf"))], "g int, v double"), declared, ["g"]).orderBy("g").collect()
    assert (none.s, none.a, some.s) == (None, None, float("inf"))
    lines = spark.createDataFrame([(0.07,)] * 20 + [(0.02,)] * 30, "v double")
    assert len({measures.compiled(lines.repartition(n), declared, []).first().s for n in (1, 3, 7)}) == 1


def test_percentiles_count_little_beyond_their_ranks_and_distinct_values_apart(spark, monkeypatch):
    rows = spark.range(20_000).select((F.col("id") % 2).alias("g"), F.pmod(F.xxhash64("id"), F.lit(100_000)).cast("double").alias("v"), (F.col("id") % 7).alias("k"))
    declared = [{"name": "n", "agg": "count", "expr": "v"}, {"name": "kinds", "agg": "count_distinct", "expr": "k"}, {"name": "mid", "agg": "median", "expr": "v"}, {"name": "p9", "agg": "percentile", "expr": "v", "agg_params": {"percentile": 0.9, "use_discrete_percentile": True}}]
    counted, running = [], measures.running
    monkeypatch.setattr(measures, "running", lambda counts, keys, value: counted.append(counts.count()) or running(counts, keys, value))
    same = lambda: sorted(tuple(r) for r in measures.compiled(rows, declared, ["g"]).collect())
    found = same()
    values = {g: sorted(r.v for r in rows.where(F.col("g") == g).collect()) for g in (0, 1)}
    assert found == [(g, 10_000, 7, (v[4999] + v[5000]) / 2, v[8999]) for g, v in values.items()]
    assert len(counted) == 2 and max(counted) < 400  # of 20,000 values
    monkeypatch.setattr(measures.F, "percentile_approx", lambda c, points, accuracy: F.array(F.max(c), F.max(c)))  # a sketch that is far off
    assert same() == found
