"""The stored inverted index against scores from the texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from weftline.domain import Domain, queries, query_mode
from weftline.operators import postings, search


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"w{c}" for c in "abcdefghijklmnopqrstuvwxyz"] + ["the"] * 30
    return [(i, None if i % 97 == 5 else " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 8, 40, 200])))) for i in range(n)]


@pytest.fixture
def small_slots(monkeypatch):
    monkeypatch.setattr(postings, "SLOT", 8)
    monkeypatch.setattr(postings, "FIRST", 2)


@pytest.mark.parametrize("named", [1000, 3])
def test_index_equals_texts(spark, tmp_path, small_slots, monkeypatch, named):
    monkeypatch.setattr(postings, "NAMED", named)
    docs = spark.createDataFrame(corpus(600, 1), "id bigint, t string")
    index = postings.Postings(spark, str(tmp_path / "i"))
    index.append(docs.where("id < 400"), "id", "t", "one")
    index.append(docs.where("id >= 400"), "id", "t", "two")
    for question in ("wa the", "wz", "the", "wa wb wc the", "nothing here", "", "wa WA wa"):
        mine = [(r.id, round(r.bm25_score, 9)) for r in index.search(question, 15).collect()]
        texts = [(r.id, round(r.bm25_score, 9)) for r in search.keyword_search(docs, question, "id", "t", 15).collect()]
        assert [s for _, s in mine] == [s for _, s in texts]
        assert set(mine) ^ set(texts) <= {x for x in mine + texts if x[1] == mine[-1][1]}
    allowed = docs.where("id % 7 = 0").select("id")
    mine = [r.id for r in index.search("wa the", 10, allowed=allowed).collect()]
    scores = search.bm25_scores(docs, "wa the", "id", "t").join(allowed, "id", "left_semi")
    assert mine == [r.id for r in scores.orderBy(F.desc(F.round("bm25_score", 9)), "id").limit(10).collect()]


def test_a_question_reads_its_terms_only(spark, tmp_path):
    index = postings.Postings(spark, str(tmp_path / "i"))
    index.append(spark.createDataFrame(corpus(50, 2), "id bigint, t string"), "id", "t", "one")
    plan = index.search("wa wb", 5)._jdf.queryExecution().executedPlan().toString()
    reads = [x for x in plan.splitlines() if "FileScan" in x and "bucket" in x]
    assert reads and all("PartitionFilters: [bucket" in x and "In(term, [wa,wb])" in x and "In(slot" in x for x in reads)
    columns = {c.split("#")[0] for x in plan.splitlines() if "FileScan" in x for c in re.search(r"FileScan parquet \[([^\]]*)\]", x)[1].split(",")}
    assert columns <= {"term", "slot", "docs", "version", "bucket", "n", "total"}


def test_versions(spark, tmp_path):
    """Only visible versions count, in scores too, and an update leaves the others' files as they are."""
    index = postings.Postings(spark, str(tmp_path / "i"))
    docs = spark.createDataFrame(corpus(90, 3), "id bigint, t string")
    index.append(docs.where("id < 60"), "id", "t", "one")
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "i" / "postings" / "version=one").rglob("*.parquet")}
    index.append(docs.where("id >= 30"), "id", "t", "two")
    assert before == {p: p.stat().st_mtime_ns for p in (tmp_path / "i" / "postings" / "version=one").rglob("*.parquet")}
    two = spark.createDataFrame([("two",)], "version string")
    mine = [(r.id, round(r.bm25_score, 9)) for r in index.search("wa the", 20, two).collect()]
    texts = [(r.id, round(r.bm25_score, 9)) for r in search.keyword_search(docs.where("id >= 30"), "wa the", "id", "t", 20).collect()]
    assert sorted(mine) == sorted(texts)


def test_empty_index_and_empty_texts(spark, tmp_path):
    index = postings.Postings(spark, str(tmp_path / "i"))
    assert index.search("wa", 5).count() == 0
    index.append(spark.createDataFrame([], "id bigint, t string"), "id", "t", "none")
    index.append(spark.createDataFrame([(1, None), (2, "")], "id bigint, t string"), "id", "t", "blank")
    assert index.search("wa", 5).count() == 0


def test_a_changed_file_gets_a_new_index(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([(1, "wa")], "id bigint, t string").write.parquet(path)
    first = postings.built_from(spark, str(tmp_path), spark.read.parquet(path), "id", "t")
    assert postings.built_from(spark, str(tmp_path), spark.read.parquet(path), "id", "t").root == first.root
    spark.createDataFrame([(2, "wa wa")], "id bigint, t string").write.mode("append").parquet(path)
    second = postings.built_from(spark, str(tmp_path), spark.read.parquet(path), "id", "t")
    assert second.root != first.root and [r.id for r in second.search("wa", 5).collect()] == [2, 1]


def test_query_modes(spark, tmp_path):
    assert [query_mode(x) for x in ("Rewrite", "instruct", "other", None, "")] == ["rewrite", "instruct", "raw", "raw", "raw"]
    entities = lambda q: '"Prague": "Location"'
    assert queries("q", "hybrid") == ("q", "q")
    assert queries("q", "hybrid", "rewrite", entities) == ('q\n"Prague": "Location"',) * 2
    keyword, embedded = queries("q", "hybrid", "instruct")
    assert keyword == "q" and embedded.startswith("Instruct: ") and embedded.endswith("\nQuery:q")
    assert queries("q", "keyword", "instruct") == ("q", "q")
    assert queries("q", "vector", "rewrite", lambda q: 1 / 0) == ("q", "q")
    with pytest.raises(ValueError):
        queries("q", "hybrid", "rewrite")
    with pytest.raises(ValueError):
        queries("q", "hybrid", "loud")

    asked = []

    def embed(texts):
        asked.extend(texts)
        return [[1.0] + [0.0] * 63 for _ in texts]

    domain = Domain.create(spark, str(tmp_path / "d"), embed=embed, entities=lambda q: "harbour")
    (tmp_path / "d" / "src" / "a.txt").write_text("ships in the harbour")
    (tmp_path / "d" / "src" / "b.txt").write_text("mountains far away")
    domain.build()
    domain.index()
    asked.clear()
    assert domain.search("boats", mode="keyword").count() == 0
    assert [r.datasource_id for r in domain.search("boats", mode="keyword", query_mode="rewrite").collect()] == ["a.txt"]
    assert asked == []
    domain.search("boats", query_mode="rewrite").collect()
    domain.search("boats", query_mode="instruct").collect()
    assert asked[0] == "boats\nharbour" and asked[1].startswith("Instruct: ")


def test_a_build_makes_no_row_of_a_word(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"{chr(97 + i % 26)}{chr(97 + k % 26)} the" for k in range(400))) for i in range(200)], "id bigint, t string")
    index = postings.Postings(spark, str(tmp_path / "i"))
    with monkeypatch.context() as m:
        m.setattr(postings.F, "explode", None)  # words are counted within their slot
        index.append(docs, "id", "t", "one")
    assert index.postings.where("term = 'the'").agg(F.sum("n"), F.max("max_tf")).first()[:] == (200, 400)


def test_terms_are_runs_of_letters_in_any_bytes(spark, tmp_path):
    texts = ["", None, "Ab1ab", "ÀabÀ K", "x" * 3000, "12 34", "ab", "end", "z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id bigint, t string")
    index = postings.Postings(spark, str(tmp_path / "i"))
    index.append(docs, "id", "t", "one")
    found = {(r.term, d.id): (d.tf, d.dl) for r in index.postings.collect() for d in r.docs}
    assert found == {("ab", 2): (2, 2), ("ab", 3): (1, 2), ("k", 3): (1, 2), ("x" * 3000, 4): (1, 1), ("ab", 6): (1, 1), ("end", 7): (1, 1), ("z", 8): (1, 1)}
    assert [(r.n, r.total) for r in index.sizes.collect()] == [(9, 8)]
