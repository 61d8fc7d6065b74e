"""Queries of the retrieval operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import chunking, postings, search, store
from weftline.plans.book import Book, table
from weftline.session import shared_base

BOOK = Book()
TEXT = "thing enau ntnt"
PROBE = 7  # the embedding whose vector is the query

TOKENS = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z]+'), lambda x: x <> '')"
BM25 = f"""
t as (select doc_id, {TOKENS} as t from documents),
dl as (select doc_id, len(t) as dl from t),
stats as (select count(*) as n, avg(dl) as avgdl from dl),
tf as (select doc_id, term, count(*) as tf from (select doc_id, unnest(t) as term from t) where term in ('thing', 'enau', 'ntnt') group by all),
df as (select term, count(*) as df from tf group by term),
bm25 as (
  select doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) as bm25_score
  from tf join df using (term) join dl using (doc_id) cross join stats group by doc_id
)"""
VECTORS = f"""
q as (select list_transform(embedding, lambda x: x::double) as q from embeddings where vec_id = {PROBE}),
d as (select vec_id as doc_id, 1 - list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q))) as vector_distance
      from (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings) cross join q)"""


def probe(spark: SparkSession, sf_dir: str) -> list[float]:
    row = table(spark, sf_dir, "embeddings").where(F.col("vec_id") == PROBE).select("embedding").first()
    return row.embedding


def indexed(spark: SparkSession, sf_dir: str) -> postings.Postings:
    return postings.built_from(spark, shared_base(spark), table(spark, sf_dir, "documents"), "doc_id", "text")


@BOOK.add(f"with {BM25} select doc_id, round(bm25_score, 6) as bm25_score from bm25 order by bm25_score desc, doc_id limit 30")
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the stored index of the documents; a change to their files makes a new one."""
    found = indexed(spark, sf_dir).search(TEXT, 30)
    return found.select(F.col("id").alias("doc_id"), F.round("bm25_score", 6).alias("bm25_score"))


@BOOK.add(f"with {VECTORS} select doc_id as vec_id, round(vector_distance, 6) as vector_distance from d where vector_distance < 0.75 order by d.vector_distance, doc_id limit 10")
def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.vector_search(table(spark, sf_dir, "embeddings"), probe(spark, sf_dir), "vec_id", "embedding", 10)
    return found.withColumn("vector_distance", F.round("vector_distance", 6))


@BOOK.add(f"with {BM25} select doc_id, round(bm25_score, 6) as bm25_score from bm25 order by bm25_score desc, doc_id limit 30")
def bm25_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without an index: every text is read."""
    found = search.keyword_search(table(spark, sf_dir, "documents"), TEXT, "doc_id", "text", 30)
    return found.withColumn("bm25_score", F.round("bm25_score", 6))


@BOOK.add("""
select term, count(*) as df, cast(sum(n) as bigint) as occurrences, max(n) as max_tf
from (select doc_id, term, count(*) as n from (select doc_id, unnest(list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z]+'), lambda x: x <> '')) as term from documents) group by all) group by term
""")
def term_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency, occurrences and largest frequency of every term, from the stored index."""
    held = indexed(spark, sf_dir).postings
    times = F.aggregate("docs", F.lit(0).cast("bigint"), lambda s, d: s + d["tf"])
    return held.groupBy("term").agg(F.sum("n").alias("df"), F.sum(times).alias("occurrences"), F.max("max_tf").alias("max_tf"))


@BOOK.add(f"""
with {BM25}, {VECTORS},
v as (select doc_id, vector_distance, row_number() over (order by vector_distance, doc_id) as vr from d where vector_distance < 0.75 qualify vr <= 30),
k as (select doc_id, bm25_score, row_number() over (order by bm25_score desc, doc_id) as kr from bm25 qualify kr <= 30)
select doc_id, round(vector_distance, 6) as vector_distance, round(bm25_score, 6) as bm25_score,
       round(coalesce(1.0::double / (60 + vr), 0) + coalesce(1.0::double / (60 + kr), 0), 8) as rrf_score
from v full join k using (doc_id)
order by coalesce(1.0::double / (60 + vr), 0) + coalesce(1.0::double / (60 + kr), 0) desc, vr nulls last, kr limit 10
""")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: keyword and vector candidates of the documents, fused."""
    vectors = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")
    n = search.candidate_limit(10)
    keyword = indexed(spark, sf_dir).search(TEXT, n).withColumnRenamed("id", "doc_id")
    found = search.fuse(search.vector_search(vectors, probe(spark, sf_dir), "doc_id", "embedding", n), keyword, "doc_id", 10)
    return found.select("doc_id", F.round("vector_distance", 6).alias("vector_distance"), F.round("bm25_score", 6).alias("bm25_score"), F.round("rrf_score", 8).alias("rrf_score"))


@BOOK.add("""
with v as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings),
q as (select vec_id as query_id, v as q from v where vec_id % 100 = 0),
d as (select query_id, vec_id, 1 - list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q))) as dist from v cross join q)
select query_id, cast(row_number() over (partition by query_id order by dist, vec_id) as integer) as rank, vec_id, round(dist, 6) + 0.0 as vector_distance from d qualify rank <= 10
""")
def vector_batch_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return search.batch_vector_search(vectors, queries, "vec_id", "embedding", 10).withColumn("vector_distance", F.round("vector_distance", 6))


CHUNKS = r"""
with w as (select doc_id, string_split_regex(text, '\s+') as w from documents where text is not null),
s as (select doc_id, w, unnest(range(0, case when len(w) <= {size} then 1 else cast(ceil((len(w) - {size}) / {step}.0) as bigint) + 1 end)) * {step} as chunk_index from w)
select doc_id, cast(chunk_index as integer) as chunk_index, array_to_string(list_slice(w, chunk_index + 1, chunk_index + {size}), ' ') as chunk_content from s
"""


@BOOK.add(CHUNKS.format(size=300, step=250))
def chunk_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.word_chunks(table(spark, sf_dir, "documents"), "doc_id", "text")


@BOOK.add(CHUNKS.format(size=60, step=50))
def chunk_words_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.word_chunks(table(spark, sf_dir, "documents"), "doc_id", "text", 60, 10)


@BOOK.add(r"""
with t as (select doc_id, string_split_regex(text, '\s+') as w from documents),
s as (select doc_id, w, unnest(range(0, case when len(w) <= 128 then 1 else cast(ceil((len(w) - 128) / 112.0) as bigint) + 1 end)) * 112 as start from t)
select doc_id, cast(start as integer) as start, cast(len(list_slice(w, start + 1, start + 128)) as integer) as n from s
""")
def chunk_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.functions.text import words

    tokens = table(spark, sf_dir, "documents").select("doc_id", words(F.col("text")).alias("t"))
    return chunking.token_chunks(tokens, "doc_id", "t", 128, 16).select("doc_id", "start", F.size("tokens").alias("n"))


@BOOK.add("""
with v as (select source as datasource_id, sha256(lang) as hash, doc_id from documents),
allowed as (select datasource_id, max(hash) as hash from v group by datasource_id)
select v.datasource_id, v.hash, v.doc_id from v join allowed using (datasource_id, hash)
""")
def current_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's documents of its current version only, here the language of the largest hash."""
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("datasource_id"), store.content_hash(F.col("lang")).alias("hash"), "doc_id")
    allowed = rows.groupBy("datasource_id").agg(F.max("hash").alias("hash"))
    return store.current(rows, allowed).select("datasource_id", "hash", "doc_id")


@BOOK.add("select doc_id, sha256(text) as hash from documents")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", store.content_hash(F.col("text")).alias("hash"))
