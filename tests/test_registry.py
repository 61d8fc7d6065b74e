import json
from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from weftline.domain import FAILED, OK, Domain
from weftline.operators import catalog, perf, recorder
from weftline.operators.store import ModelRegistry
from weftline.sources import introspection
from weftline.sources.registry import Kind, Registry, built_in


@dataclass
class Numbers:
    """Numbers up to a bound."""

    upto: int
    step: float = 1.0


def numbers(spark, config):
    return {"numbers": spark.range(config.upto)}


def test_a_name_is_taken_once():
    kinds = Registry([Kind("numbers", Numbers, numbers)])
    with pytest.raises(ValueError, match="already"):
        kinds.add(Kind("NUMBERS", Numbers))
    assert kinds["Numbers"].config is Numbers and kinds.names() == ["numbers"]
    with pytest.raises(ValueError, match="'other'"):
        kinds["other"]
    assert {"parquet", "spark", "sqlite", "postgresql", "bigquery"} <= set(built_in(introspection.DIALECTS).names())


def test_settings_are_checked():
    kind = Kind("numbers", Numbers, numbers)
    assert kind.typed({"type": "numbers", "upto": 3, "step": 2, "profiling": True, "constraints": None}) == Numbers(3, 2)
    with pytest.raises(ValueError, match="bound is unknown, upto is missing"):
        kind.typed({"type": "numbers", "bound": 1})
    with pytest.raises(ValueError, match="step must be number, upto must be integer"):
        kind.typed({"upto": True, "step": "x"})


def test_schemas():
    shape = Kind("numbers", Numbers).schema()
    assert shape["properties"]["upto"] == {"type": "integer"} and shape["required"] == ["type", "upto"] and shape["properties"]["type"] == {"const": "numbers"}
    jdbc = built_in(["mysql"]).schemas()["mysql"]
    assert jdbc["properties"]["port"] == {"type": ["integer", "null"]} and jdbc["properties"]["options"] == {"type": "object"} and jdbc["required"] == ["type"]
    json.dumps(jdbc)


def test_a_domain_takes_other_kinds(spark, tmp_path):
    kinds = built_in(introspection.DIALECTS)
    kinds.add(Kind("numbers", Numbers, numbers))
    d = Domain.create(spark, str(tmp_path / "d"), kinds=kinds)
    (d.root / "src" / "n.yaml").write_text("type: numbers\nupto: 4\n")
    (d.root / "src" / "bad.yaml").write_text("type: numbers\nupto: many\n")
    (d.root / "src" / "note.md").write_text("a note")
    found = {r.datasource_id: r for r in d.build()}
    assert (found["n.yaml"].status, found["bad.yaml"].status) == (OK, FAILED) and "upto must be integer" in found["bad.yaml"].note
    assert d.browse("n.yaml") == {"numbers": None} and d.run_sql("n.yaml", "select count(*) as n from numbers").first().n == 4
    with pytest.raises(ValueError, match="no tables"):
        d.browse("note.md")


def test_models(spark, tmp_path):
    models = ModelRegistry(spark, str(tmp_path / "models"))
    assert models.get("own", "m") is None and models.delete("own", "m") == 0
    assert models.create("own", "Nomic:v1.5", 768).table_name == "embedding_own_nomic_v1_5"
    with pytest.raises(ValueError, match="already"):
        models.create("own", "Nomic:v1.5", 768)
    with pytest.raises(ValueError, match="no name"):
        models.create("own", "x", 3, "vectors; drop")
    assert models.ensure("own", "Nomic:v1.5", 768).dim == 768
    with pytest.raises(ValueError, match="768 components, not 3"):
        models.ensure("own", "Nomic:v1.5", 3)
    assert models.delete("own", "Nomic:v1.5") == 1 and models.get("own", "Nomic:v1.5") is None
    assert models.create("own", "Nomic:v1.5", 3).dim == 3 and models.models.count() == 1


def test_records_become_runs_and_spans(spark, tmp_path):
    path = tmp_path / "logs" / "perf.jsonl"

    @recorder.recorded("step", attrs=lambda n: {"n": n, "datasource_id": "s1"})
    def step(n):
        with recorder.span("inner"):
            recorder.set_attributes(chunk_count=n)

    @recorder.recorded("odd", attrs=lambda: 1 / 0, datasource_id=lambda: [][0])
    def odd():
        raise KeyError("x")

    step(0)  # outside a run nothing is recorded
    with recorder.run(path, "build", who="me"):
        step(7)
        recorder.set_attributes(lost=1)
    with pytest.raises(KeyError), recorder.run(path, "index"):
        odd()
    with recorder.run(tmp_path / "logs" / "perf.jsonl" / "no", "build"):
        step(1)  # a log that can't be opened leaves the work alone
    starts, ends, spans = perf.split_records(spark.read.schema(perf.RECORD).json(str(path)))
    runs = {r.operation: r for r in perf.runs(starts, ends).collect()}
    assert (runs["build"].status, runs["index"].status) == ("ok", "error") and runs["build"].run_ms >= 0
    rows = {r.name: r for r in spans.collect()}
    assert set(rows) == {"step", "inner", "odd"} and rows["inner"].parent_span_id == rows["step"].span_id and rows["step"].parent_span_id is None
    assert rows["inner"].datasource_id == "s1" and rows["step"].attrs == {"n": "7"} and rows["inner"].attrs == {"chunk_count": "7"}
    assert (rows["odd"].status, rows["odd"].error_type, rows["odd"].datasource_id) == ("error", "KeyError", None)


def test_choices_of_runs(spark):
    found = spark.createDataFrame([("r1", "build", "ok"), ("r2", "build", "error"), ("r3", None, "ok")], "run_id string, operation string, status string")
    spans = spark.createDataFrame([("r1", "a"), ("r1", None), ("r2", "b"), ("r3", "a"), (None, "a")], "run_id string, datasource_id string")
    counts = lambda **k: tuple(df.count() for df in perf.selected(found, spans, **k))
    assert counts() == (2, 3, 3) and counts(statuses=["ok"]) == (1, 2, 2) and counts(sources=["a"], operations=[]) == (2, 3, 1) and counts(operations=["none"]) == (0, 0, 0)


def test_attributes_and_order(spark):
    rows = spark.createDataFrame([(1, '{"a": 1, "b": {"c": "x"}}', "5.9"), (2, "[1]", "no"), (3, None, None), (4, "not json", "2")], "id int, attrs string, duration_ms string").withColumn("t_start_ms", F.lit(1.7))
    assert sorted(r.name for r in perf.attribute_names(rows).collect()) == ["a", "b"]
    flat = perf.with_ends(perf.flat_attributes(rows, ["a", "b.c"])).orderBy("id").collect()
    assert [(r["attr.a"], r["attr.b.c"], r.t_end_ms) for r in flat] == [("1", "x", 6), (None, None, None), (None, None, None), (None, None, 3)]
    table = spark.createDataFrame([("p", 1.0, None), ("q", 2.0, 9.0), ("r", None, None), ("a", 1.0, 0.5)], "name string, s1 double, s2 double")
    assert [(r.name, r.largest) for r in perf.by_largest(table, "name", ["s1", "s2"]).collect()] == [("q", 9.0), ("a", 1.0), ("p", 1.0), ("r", None)]


DATA_SET = """
create schema {d};
create table {d}.TABLES as select '{d}' as table_schema, t as table_name, k as table_type from (values ('people', 'BASE TABLE'), ('visits', 'CLONE'), ('v', 'VIEW')) x(t, k);
create table {d}.COLUMNS as select '{d}' as table_schema, t as table_name, o as ordinal_position, c as column_name, 'INT64' as data_type, 'YES' as is_nullable, 'NULL' as column_default, g as is_generated, p as is_partitioning_column
  from (values ('people', 1, 'a', 'NEVER', 'NO'), ('people', 2, 'b', 'ALWAYS', 'YES'), ('visits', 1, 'x', 'NEVER', 'NO'), ('visits', 2, 'y', 'NEVER', 'NO')) v(t, o, c, g, p);
create table {d}.COLUMN_FIELD_PATHS as select 'people' as table_name, 'a' as field_path, 'first' as description;
create table {d}.TABLE_CONSTRAINTS as select '{d}' as constraint_schema, n as constraint_name, k as constraint_type, 'NO' as enforced from (values ('people.pk', 'PRIMARY KEY'), ('visits.fk', 'FOREIGN KEY')) v(n, k);
create table {d}.KEY_COLUMN_USAGE as select '{d}' as constraint_schema, '{d}' as table_schema, * from (values
  ('people.pk', 'people', 'a', 1, null), ('people.pk', 'people', 'b', 2, null), ('visits.fk', 'visits', 'y', 1, 2), ('visits.fk', 'visits', 'x', 2, 1)) v(constraint_name, table_name, column_name, ordinal_position, position_in_unique_constraint);
create table {d}.CONSTRAINT_COLUMN_USAGE as select 'visits.fk' as constraint_name, '{d}' as table_schema, 'people' as table_name, c as column_name from (values ('a'), ('b')) v(c);
"""


def test_catalogs_of_data_sets(spark):
    import duckdb

    stub = duckdb.connect()
    for d in ("one", "two"):
        stub.execute(DATA_SET.format(d=d))

    def read(query):
        if query == introspection.PARTS["bigquery"]:
            return spark.createDataFrame([("one",), ("two",), ("INFORMATION_SCHEMA",)], "part string")
        cursor = stub.execute(query.replace(".INFORMATION_SCHEMA.", "."))
        return introspection.local_rows(spark, [c[0] for c in cursor.description], cursor.fetchall())

    rows = catalog.assembled_tables(**introspection.components(spark, "bigquery", read)).collect()
    tables = {(r.schema_name, r.name): r for r in rows}
    assert len(tables) == 6 and {n: r.kind for (s, n), r in tables.items() if s == "two"} == {"people": "table", "visits": "clone", "v": "view"}
    people, visits = tables["one", "people"], tables["one", "visits"]
    assert people.primary_key == ["a", "b"] and [(c.name, c.generated, c.description, c.default_expression) for c in people.columns] == [("a", None, "first", None), ("b", "computed", None, None)]
    assert people.partition_info.columns == ["b"] and visits.foreign_keys[0].referenced_table == "one.people"
    assert [(m.from_column, m.to_column) for m in visits.foreign_keys[0].mapping] == [("y", "b"), ("x", "a")]
    assert introspection.components(spark, "bigquery", read, ["two"])["relations"].select("schema_name").distinct().collect()[0][0] == "two"
    assert introspection.components(spark, "snowflake", read, [])["relations"].isEmpty()
    with pytest.raises(ValueError, match="x;y"):
        introspection.components(spark, "snowflake", read, ["x;y"])
