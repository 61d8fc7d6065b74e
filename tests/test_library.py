import json
import random
import sqlite3
from datetime import datetime, timedelta

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from weftline.domain import FAILED, OK, SKIPPED, Domain, rendered
from weftline.operators import catalog, joins, perf, profiling, search, store
from weftline.sources import databases, files, parquet_footer
from weftline.streaming import windows


def test_profile_of_users(spark):
    users = spark.createDataFrame([(1, "Alice", 1), (2, "Bob", 1), (3, "Charlie", 0), (4, "Alice", 1), (5, "Dave", 1)], "user_id int, name string, is_active int")
    rows = {r.column_name: r for r in profiling.profile(users, "users").collect()}
    assert (rows["user_id"].distinct_count, rows["user_id"].cardinality_bucket, rows["user_id"].min_text, rows["user_id"].max_text) == (5, "5-9", "1", "5")
    assert (rows["name"].exact_distinct, rows["is_active"].exact_distinct) == (4, 2)
    top = profiling.top_values(users, "is_active").collect()
    assert [(r.value, r.frequency) for r in top] == [("1", 4), ("0", 1)]


def test_profile_of_an_empty_table(spark):
    row = profiling.profile(spark.createDataFrame([], "a int"), "t").first()
    assert (row.row_count, row.cardinality_bucket, row.percent_null) == (0, "0", None)


def test_bm25_order(spark):
    chunks = spark.createDataFrame([(1, "customer customer profile analysis"), (2, "customer profile"), (3, "warehouse inventory status"), (4, None), (5, "")], "id int, t string")
    assert {r.id for r in search.keyword_search(chunks, "customer profile", "id", "t").collect()} == {1, 2}
    assert search.keyword_search(chunks, "...", "id", "t").count() == 0


def test_fusion_keeps_both_sides(spark):
    v = spark.createDataFrame([(1, 0.1), (2, 0.2)], "id int, vector_distance double")
    k = spark.createDataFrame([(2, 3.0), (3, 2.0)], "id int, bm25_score double")
    rows = search.fuse(v, k, "id").collect()
    assert [r.id for r in rows] == [2, 1, 3]
    assert rows[0].rrf_score == pytest.approx(1 / 62 + 1 / 61)


def test_rules():
    with pytest.raises(ValueError):
        catalog.Rule()
    assert catalog.Rule(schemas="a").schemas == ["a"]


def test_as_of_is_the_latest_before(spark):
    left = spark.createDataFrame([(1, "a", 10), (2, "a", 5), (3, "b", 7)], "id bigint, k string, t int")
    right = spark.createDataFrame([("a", 4, "x"), ("a", 10, "y"), ("a", 11, "z")], "k string, at int, v string")
    got = {r.id: r.v for r in joins.as_of(left, right, ["k"], "t", "at", "id", ["v"]).collect()}
    assert got == {1: "y", 2: "x", 3: None}


def test_as_of_over_slices_ties_and_nulls(spark):
    r = random.Random(5)
    when = lambda: r.choice([None, *[datetime(2024, 1, 1) + timedelta(hours=7 * i) for i in range(40)]])
    lefts = [(i, r.choice(["hot", "hot", "b", None]), when()) for i in range(60)]
    rights = [(r.choice(["hot", "hot", "b", None]), when(), i) for i in range(25)]
    left, right = spark.createDataFrame(lefts, "id bigint, k string, t timestamp_ntz"), spark.createDataFrame(rights, "k string, at timestamp_ntz, v bigint")

    def wanted(k, t, slack):
        held = [(at, v) for key, at, v in rights if None not in (k, t, key, at) and key == k and at <= t]
        return max(held)[1] if held and t - max(held)[0] <= slack else None

    for age, slack in ((None, timedelta.max), (F.expr("interval 12 hours"), timedelta(hours=12))):
        for unit in ("day", "month", None):
            got = {x.id: x.v for x in joins.as_of(left, right, ["k"], "t", "at", "id", ["v"], tie="v", max_age=age, slice=unit).collect()}
            assert got == {i: wanted(k, t, slack) for i, k, t in lefts}


def test_versions(spark, tmp_path):
    held = store.ChunkStore(spark, str(tmp_path / "index"))
    chunks = spark.createDataFrame([(1, "t", None, "a b", None, "a b")], "chunk_id bigint, full_type string, chunk_type string, embeddable_text string, display_text string, keyword_index_text string")
    vectors = spark.createDataFrame([(1, [1.0, 2.0])], "chunk_id bigint, vec array<float>")
    held.persist(chunks, "s", "SHA-256", "h1", vectors, "own", "m", 2)
    held.persist(chunks, "s", "SHA-256", "h2")
    with pytest.raises(ValueError):
        held.persist(chunks, "s", "SHA-256", "h2")
    with pytest.raises(ValueError):
        held.persist(chunks, "s", "SHA-256", "h3", vectors, "own", "m", 3)
    assert held.is_indexed("s", "SHA-256", "h1") and not held.is_indexed("s", "SHA-256", "h3")
    assert held.chunks.count() == 2 and held.vectors("own", "m").count() == 1
    assert store.current(held.chunks, spark.createDataFrame([("s", "h1"), ("s", "h1")], "datasource_id string, hash string")).count() == 1
    held.delete("s", "h1")
    assert [r.hash for r in held.hashes.collect()] == ["h2"]


def chunk_rows(spark, *texts):
    return spark.createDataFrame([(i, "t", "c", t, t, t) for i, t in enumerate(texts)], "chunk_id bigint, full_type string, chunk_type string, embeddable_text string, display_text string, keyword_index_text string")


def test_store_override_leaves_one_set_of_rows(spark, tmp_path):
    held = store.ChunkStore(spark, str(tmp_path / "index"))
    vectors = spark.createDataFrame([(0, [1.0, 2.0])], "chunk_id bigint, vec array<float>")
    held.persist(chunk_rows(spark, "a", "b"), "s", "SHA-256", "h", vectors, "own", "m", 2)
    held.persist(chunk_rows(spark, "c", "d"), "s", "SHA-256", "h", vectors, "own", "m", 2, override=True)
    assert sorted(r.display_text for r in held.chunks.collect()) == ["c", "d"] and held.vectors("own", "m").count() == 1
    with pytest.raises(ValueError):
        held.persist(chunk_rows(spark, "e"), "s", "SHA-256", "h")
    held.persist(chunk_rows(spark, "f"), "s", "SHA-256", "h2")
    assert held.vacuum() == 2 and held.chunks.count() == 3
    held.delete("s", "h")
    assert [r.display_text for r in held.chunks.collect()] == ["f"] and held.vectors("own", "m").count() == 0
    held.persist(chunk_rows(spark, "g"), "s", "SHA-256", "h")
    assert sorted(r.display_text for r in held.chunks.collect()) == ["f", "g"]


def test_store_write_that_breaks_off_leaves_nothing(spark, tmp_path):
    held = store.ChunkStore(spark, str(tmp_path / "index"))
    bad = spark.createDataFrame([(0, [1.0])], "chunk_id bigint, vec array<float>")
    with pytest.raises(ValueError):
        held.persist(chunk_rows(spark, "a", "b"), "s", "SHA-256", "h", bad, "own", "m", 2)
    assert held.chunks.count() == 0 and not held.is_indexed("s", "SHA-256", "h")
    held.persist(chunk_rows(spark, "a", "b"), "s", "SHA-256", "h")
    assert held.chunks.count() == 2 and held.vacuum() == 1 and held.chunks.count() == 2


def test_span_depths_of_deep_trees_and_rings(spark):
    rows = [("r", f"s{i}", f"s{i - 1}" if i else None) for i in range(150)] + [("r", "x", "y"), ("r", "y", "x"), ("q", "s5", "s4")]
    found = {(r.run_id, r.span_id): (r.depth, r.path) for r in perf.span_depths(spark.createDataFrame(rows, "run_id string, span_id string, parent_span_id string")).collect()}
    assert len(found) == 151 and found["r", "s149"] == (149, "/".join(f"s{i}" for i in range(150))) and found["q", "s5"] == (0, "s5")


def test_runs_are_numbered_over_days(spark):
    from datetime import datetime, timedelta

    rows = [(f"r{i:03}", datetime(2024, 1, 1) + timedelta(hours=7 * (i % 40)) if i % 9 else None) for i in range(90)]
    got = {r.run_id: r.run_index for r in perf.numbered_runs(spark.createDataFrame(rows, "run_id string, start_dt timestamp")).collect()}
    order = sorted(rows, key=lambda r: (r[1] is None, r[1] or datetime.max, r[0]))
    assert got == {r[0]: i for i, r in enumerate(order)}


def test_perf_log(spark, tmp_path):
    rows = [
        {"type": "run_start", "ts": "2024-01-01T00:00:00", "run_id": "r", "operation": "build"},
        {"type": "span", "run_id": "r", "span_id": "a", "name": "x", "t_start_ms": 1.0, "duration_ms": 2.0, "status": "ok", "attrs": {"chunk_count": "2"}},
        {"type": "span", "run_id": "r", "span_id": "b", "parent_span_id": "a", "name": "y", "t_start_ms": 1.5, "duration_ms": 4.0, "status": "error"},
        {"type": "span", "run_id": "r", "span_id": "c", "parent_span_id": "gone", "name": "y", "t_start_ms": 2.0, "duration_ms": 6.0, "status": "ok"},
        {"type": "run_end", "run_id": "q", "status": "ok", "duration_ms": 9.0},
    ]
    log = tmp_path / "log"
    log.mkdir()
    (log / "p.jsonl").write_text("\n".join([*map(json.dumps, rows), "", "not json", "[1]"]))
    starts, ends, spans = perf.split_records(files.perf_records(spark, str(log)))
    runs = {r.run_id: (r.operation, r.status) for r in perf.runs(starts, ends).collect()}
    assert runs == {"r": ("build", "unknown"), "q": ("unknown", "ok")}
    assert {r.span_id: r.depth for r in perf.span_depths(spans).collect()} == {"a": 0, "b": 1, "c": 0}
    totals = {r.name: r for r in perf.step_totals(spans.withColumn("operation", F.lit("build")), perf.datasource_metrics(spans)).collect()}
    assert (totals["y"].total_ms, totals["y"].any_error, totals["x"].ms_per_chunk) == (10.0, True, 1.0)
    streamed = windows.run_available(windows.step_totals_stream(spark, str(log)), "perf_totals", checkpoint=str(tmp_path / "cp"))
    assert {r.name: r.span_count for r in streamed.collect()} == {"x": 1, "y": 2}


def test_parquet_footers(spark, tmp_path):
    pq.write_table(pa.table({"id": pa.array(range(5001), pa.int64()), "name": [f"n{i}" for i in range(5001)]}), tmp_path / "f.parquet", row_group_size=4000)
    rows = {r.column_name: r for r in parquet_footer.columns(parquet_footer.row_groups(spark, str(tmp_path))).collect()}
    assert (rows["id"].num_values, rows["id"].row_groups, rows["id"].first_stats_max) == (5001, 2, "3999")


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as c:
        c.execute("create table T (Id integer, Name text, Price real)")
        c.executemany("insert into T values (?, ?, ?)", [(i, f"n{i}", i / 2) for i in range(100)])
    df = databases.read_sqlite(spark, path, "T")
    assert df.columns == ["id", "name", "price"] and df.agg(F.sum("id"), F.sum("price")).first()[:] == (4950, 2475.0)
    with pytest.raises(ValueError):
        databases.Connection("nope").url()
    assert databases.Connection("postgresql", "h", database="d").url() == "jdbc:postgresql://h:5432/d"


def test_dbt(spark, tmp_path):
    nodes = {
        "model.a": {"unique_id": "model.a", "resource_type": "model", "name": "a", "database": "d", "schema": "s", "config": {"materialized": "table"}, "columns": {"x": {"name": "x", "data_type": "int"}}, "depends_on": {"nodes": []}},
        "test.t": {"unique_id": "test.t", "resource_type": "test", "attached_node": "model.a", "column_name": "x", "config": {"severity": "ERROR"}, "test_metadata": {"name": "relationships", "kwargs": {"to": "ref('b')", "field": "y"}}},
    }
    metrics = {"m": {"unique_id": "m", "name": "m", "depends_on": {"nodes": ["model.a", "semantic_model.z"]}}}
    path = tmp_path / "manifest.json"
    path.write_text(json.dumps({"nodes": nodes, "metrics": metrics, "semantic_models": {}}))
    types = tmp_path / "catalog.json"
    types.write_text(json.dumps({"nodes": {"model.a": {"columns": {"x": {"type": "BIGINT", "name": "x"}}}}}))
    m = files.manifest(spark, str(path))
    model = files.dbt_models(m, files.catalog(spark, str(types))).first()
    assert (model.id, model.materialization, model.columns[0].data_type) == ("model.a", "table", "BIGINT")
    constraint = files.dbt_constraints(m).first().constraints[0]
    assert (constraint.type, constraint.is_enforced, constraint.target_model) == ("relationships", True, "b")
    assert files.dbt_metrics(m).first().depends_on_semantic_model == "semantic_model.z"


def test_env_templates():
    assert rendered("a {{ env_var('X', 'd') }}", {}) == "a d"
    with pytest.raises(KeyError):
        rendered("{{ env_var('X') }}", {})


def test_domain_end_to_end(spark, tmp_path):
    shop = tmp_path / "shop"
    shop.mkdir()
    pd.DataFrame({"customer_id": [1, 2], "name": ["a", "b"]}).to_parquet(shop / "customers.parquet")
    d = Domain.create(spark, str(tmp_path / "d"))
    (d.root / "src" / "shop.yaml").write_text(f"type: parquet\npath: {shop}\nprofiling: true\nconstraints: {{customers: {{primary_key: [customer_id]}}}}\n")
    (d.root / "src" / "off.yaml").write_text("type: parquet\nenabled: false\n")
    (d.root / "src" / "bad.yaml").write_text("type: nothing\n")
    (d.root / "src" / "files" / "note.md").write_text("warehouse inventory " * 40)
    assert {r.datasource_id: r.status for r in d.build()} == {"shop.yaml": OK, "off.yaml": SKIPPED, "bad.yaml": FAILED, "files/note.md": OK}
    assert {r.status for r in d.index(["shop.yaml", "files/note.md"])} == {OK}
    assert {r.status for r in d.index(["shop.yaml"])} == {SKIPPED}
    best = d.search("customers primary key", limit=3).first()
    assert best.datasource_id == "shop.yaml"
    assert d.search("warehouse inventory", mode="keyword").first().datasource_id == "files/note.md"
    assert d.search("customers", mode="keyword", chunk_types=["column"]).where("chunk_type <> 'column'").count() == 0
    assert d.run_sql("shop.yaml", "SELECT count(*) AS n FROM customers").first().n == 2
    assert d.browse("shop.yaml") == {"customers": None}
    with pytest.raises(ValueError, match="customers"):
        d.table_details("shop.yaml", "nope")
    assert "# ===== shop.yaml =====" in d.contexts()
    d.enrich(lambda node: f"about {node['name']}", ["shop.yaml"])
    assert d.browse("shop.yaml") == {"customers": "about customers"}
    assert {r.status for r in d.check(["shop.yaml"])} == {"VALID"} and {r.status for r in d.check(["bad.yaml"])} == {"INVALID"}
