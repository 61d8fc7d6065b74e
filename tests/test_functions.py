import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.functions import stats, text, vectors
from weftline.operators.chunking import table_row_batches
from weftline.operators.sql import READ_ONLY, UNKNOWN, WRITE, classify, run_sql
from weftline.plans.metadata import STATEMENTS


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("n, name", [(None, "unknown"), (-1, "unknown"), (0, "0"), (1, "1"), (4, "2-4"), (5, "5-9"), (19, "10-19"), (20, "20-49"), (99, "50-99"), (100, "100-999"), (1000, "1000+")])
def test_buckets(spark, n, name):
    assert one(spark, stats.cardinality_bucket(F.lit(n).cast("bigint"))) == name


def test_small_statistics(spark):
    assert one(spark, stats.exact_distinct(F.lit(19))) == 19
    assert one(spark, stats.exact_distinct(F.lit(20))) is None
    assert one(spark, stats.percent(F.lit(1), F.lit(0))) is None
    assert [stats.sample_rate(n) for n in (None, 0, 9_999, 10_000, 1_000_000, 100_000_000)] == [0.1, 0.1, 1.0, 0.1, 0.01, 0.001]
    assert stats.extrapolated_nulls(100, 90, 0.1, 1000) == (900, 100)
    assert stats.distinct_from_ratio(-0.5, 100) == 50


def test_truncation(spark):
    assert one(spark, text.truncated(F.lit("x" * 330))) == "x" * 256 + "…[truncated, 256/330]"
    assert one(spark, text.truncated(F.lit("x" * 256))) == "x" * 256


@settings(max_examples=15, deadline=None)
@given(st.integers(0, 40), st.integers(2, 9), st.integers(1, 8))
def test_windows_like_a_loop(spark, n, size, overlap):
    if overlap >= size:
        with pytest.raises(ValueError):
            text.windows(F.array(), size, overlap)
        return
    items, expected, start = list(range(n)), [], 0
    while True:
        expected.append((start, items[start : start + size]))
        if start + size >= n:
            break
        start += size - overlap
    got = one(spark, text.windows(F.array(*[F.lit(i) for i in items]) if items else F.array().cast("array<int>"), size, overlap))
    assert [(w.start, w.window) for w in got] == expected


def test_twelve_tokens(spark):
    got = one(spark, text.windows(F.sequence(F.lit(1), F.lit(12)), 5, 2))
    assert len(got) == 4


def test_globs(spark):
    assert one(spark, text.glob_match(F.lit("Sales_1"), "sales_[0-9]"))
    assert not one(spark, text.glob_match(F.lit("presales_1"), "sales_?"))
    assert not one(spark, text.glob_match(F.lit("Sales"), "sales", case_sensitive=True))


def test_small_parsers(spark):
    assert one(spark, text.ref_target(F.lit("ref('a.b')"))) == "a.b"
    assert one(spark, text.ref_target(F.lit("x ref('a')"))) is None
    assert one(spark, text.array_literal(F.lit("{a,b}"))) == ["a", "b"]
    assert one(spark, text.array_literal(F.lit("{}"))) == []
    assert [one(spark, text.coerced_bool(F.lit(v))) for v in ("YES", "0", "maybe")] == [True, False, True]
    parts = lambda xs: F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<string>")
    assert [one(spark, text.joined_with_last(parts(p), " and ")) for p in ([], ["a"], ["a", "b", "c"])] == ["", "a", "a, b and c"]


def test_cosine(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert one(spark, vectors.cosine_distance(v(1, 0), v(0, 2))) == 1.0
    assert one(spark, vectors.cosine_distance(v(0, 0), v(0, 2))) is None


@pytest.mark.parametrize("sql, kind", STATEMENTS)
def test_statement_kinds(sql, kind):
    assert classify(sql) == kind


def test_run_sql_gate(spark):
    assert run_sql(spark, "SELECT :a AS a;", {"a": 3}).first().a == 3
    assert run_sql(spark, "SELECT ? AS a", [4]).first().a == 4
    for bad in ("DROP TABLE x", "", "SELECT 1; SELECT 2", "FROM x INSERT INTO y SELECT *"):
        with pytest.raises(PermissionError):
            run_sql(spark, bad)
    assert {READ_ONLY, WRITE, UNKNOWN} == {k for _, k in STATEMENTS}


def test_row_batches():
    out = table_row_batches(["a" * 4, "b" * 4, "c" * 4], "H\n", 12)
    assert out == ["H\naaaa\nbbbb", "H\ncccc"]
    long = table_row_batches(["z" * 7000], "H\n", 10)
    assert long[0].endswith("…[TRUNCATED]…") and re.match(r"H\nz{6000}…", long[0])


# Words and stems from the published description of the algorithm.
STEMS = "caresses:caress ponies:poni feed:feed agreed:agre plastered:plaster motoring:motor sing:sing troubled:troubl hopping:hop falling:fall filing:file happy:happi sky:sky relational:relat rational:ration digitizer:digit hopefulness:hope sensibiliti:sensibl triplicate:triplic electriciti:electr goodness:good allowance:allow adjustable:adjust replacement:replac adoption:adopt probate:probat rate:rate cease:ceas controll:control roll:roll"


@pytest.mark.parametrize("pair", STEMS.split())
def test_stems(pair):
    from weftline.functions.stem import stem

    word, expected = pair.split(":")
    assert stem(word) == expected


def test_stemmed_search(spark):
    from weftline.functions.stem import index_text, query_text
    from weftline.operators.search import keyword_search

    chunks = spark.createDataFrame([(1, "The hopping customers"), (2, "of the"), (3, None)], "id int, t string").withColumn("t", index_text(F.col("t")))
    assert [r.id for r in keyword_search(chunks, query_text("a customer hops"), "id", "t").collect()] == [1]


def test_word_chunks_split_a_text_once(spark):
    from weftline.operators.chunking import word_chunks

    chunks = word_chunks(spark.createDataFrame([(1, " ".join(map(str, range(130)))), (2, ""), (3, None)], "id int, text string"), "id", "text", 60, 10)
    assert chunks._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1  # not once for each window
    found = [(r.id, r.chunk_index, len(r.chunk_content.split())) for r in chunks.orderBy("id", "chunk_index").collect()]
    assert found == [(1, 0, 60), (1, 50, 60), (1, 100, 30), (2, 0, 0)]


def test_recursion_has_no_limit_of_rows(spark, monkeypatch):
    from weftline.operators import sql
    from weftline.operators.sql import run_recursive

    monkeypatch.setattr(sql, "SENT", 100)

    spark.range(1, 4096).createOrReplaceTempView("nodes")
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "1000")  # a million by default, which ended Spark's own statement
    try:
        rows = run_recursive(spark, "select id as k, 0 as d from nodes where id = 1", "select id, d + 1 from {level} join nodes on floor(id / 2) = k where id > 1")
        assert rows.groupBy("d").count().orderBy("d").collect() == [(d, 2**d) for d in range(12)]
        from weftline.plans.registry import QUERIES

        assert QUERIES["sql_recursive_cte"](spark, "/root/testdata/sf0.1").count() == 15_000
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", before)
    with pytest.raises(RecursionError):
        run_recursive(spark, "select 1 as k", "select k from {level}", levels=3)
    with pytest.raises(PermissionError):
        run_recursive(spark, "select 1 as k", "drop table {level}")
