"""Retrieval: exact vector search, BM25 keyword search, hybrid reciprocal-rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import tokens
from weftline.functions.vectors import cosine_distance
from weftline.session import written

K1, B = 1.2, 0.75
RRF = 60
MAX_DISTANCE = 0.75
LIMIT = 10
BLOCK, QUERIES = 8192, 512  # vectors and queries that a task of a batch search compares


def candidate_limit(limit: int) -> int:
    """How many candidates each side of a hybrid search gives."""
    return max(limit, 3 * limit)


def bm25_scores(chunks: DataFrame, query: str, id_col: str, text_col: str) -> DataFrame:
    """(id, bm25_score) of the chunks that hold a query term.

    Statistics are over all chunks; filters on the result come after. Each chunk's length
    and term counts are worked out once and written, some numbers a chunk; statistics and
    scores read those. Only one row of statistics is gathered, whatever the corpus.
    """
    terms = sorted({t for t in _query_terms(query)})
    none = chunks.select(F.col(id_col), F.lit(None).cast("double").alias("bm25_score")).where("false")
    if not terms:
        return none
    held = chunks.select(F.col(id_col), tokens(F.col(text_col)).alias("t"))
    counts = written(held.select(id_col, F.size("t").alias("dl"), *[_times("t", w).alias(f"tf{i}") for i, w in enumerate(terms)]))
    stats = counts.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    scored = counts.where(" or ".join(f"tf{i} > 0" for i in range(len(terms)))).crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"tf{i}").cast("double"), F.col(f"df{i}")
        idf = F.log((F.col("n") - df + 0.5) / (df + 0.5) + 1)
        weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
        score = score + F.when(tf > 0, idf * weight).otherwise(0.0)
    return scored.select(id_col, score.alias("bm25_score"))


def _times(tokens: str, term: str):
    return F.size(tokens) - F.size(F.array_remove(tokens, term))


def _query_terms(query: str) -> list[str]:
    import re

    return re.findall("[a-z]+", query.lower())


def keyword_search(chunks: DataFrame, query: str, id_col: str, text_col: str, limit: int = LIMIT) -> DataFrame:
    """Best chunks by BM25; ties go to the smaller id."""
    return bm25_scores(chunks, query, id_col, text_col).orderBy(F.desc("bm25_score"), id_col).limit(limit)


def vector_distances(vectors: DataFrame, query: list[float], vector_col: str) -> DataFrame:
    """``vectors`` with vector_distance, rows at MAX_DISTANCE or beyond left out."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.withColumn("vector_distance", cosine_distance(F.col(vector_col), q)).where(F.col("vector_distance") < MAX_DISTANCE)


def vector_search(vectors: DataFrame, query: list[float], id_col: str, vector_col: str, limit: int = LIMIT) -> DataFrame:
    """Nearest vectors by cosine distance; ties go to the smaller id. Planned as a distributed top-k, not a sort."""
    return vector_distances(vectors, query, vector_col).select(id_col, "vector_distance").orderBy("vector_distance", id_col).limit(limit)


def batch_vector_search(vectors: DataFrame, queries: DataFrame, id_col: str, vector_col: str, limit: int) -> DataFrame:
    """(query_id, rank, id, vector_distance) for a stated query set against all vectors.

    queries: (query_id, query). Both sides are dealt into blocks, and a task compares one
    block with one other by a matrix product and gives out each query's best of it, so
    neither side is broadcast and no pair is a row. Null vectors and those of length 0 or
    of another width than the query have no distance and aren't found; ties go to the smaller id.
    """
    kind = dict(vectors.dtypes)[id_col]
    asked = dict(queries.dtypes)["query_id"]
    n_left, n_right = (-(-max(1, df.count()) // size) for df, size in ((vectors, BLOCK), (queries, QUERIES)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    v = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), deal(id_col, n_left).alias("i"), every(n_right).alias("j"))
    q = queries.select("query_id", F.col("query").cast("array<double>").alias("q"), deal("query_id", n_right).alias("j")).select("*", every(n_left).alias("i"))

    def nearest(left, right):
        import numpy as np
        import pandas as pd

        out = []
        for width in {len(x) for x in right["q"] if x is not None}:
            rows, ask = (f[[x is not None and len(x) == width for x in f[c]]] for f, c in ((left, "v"), (right, "q")))
            if not width or not len(rows) or not len(ask):
                continue
            a, b = np.array(rows["v"].tolist(), float), np.array(ask["q"].tolist(), float)
            with np.errstate(all="ignore"):
                far = 1 - (b @ a.T) / np.outer(np.sqrt((b * b).sum(axis=1)), np.sqrt((a * a).sum(axis=1)))
            ids = rows["id"].to_numpy()
            for name, row in zip(ask["query_id"], far, strict=True):
                at = np.flatnonzero(~np.isnan(row))
                if len(at) > limit:  # all that tie with the last of the best stay
                    at = at[row[at] <= np.partition(row[at], limit - 1)[limit - 1] + 1e-12]
                out += [(name, ids[k], row[k]) for k in at]
        return pd.DataFrame(out, columns=["query_id", "id", "vector_distance"])

    found = v.groupBy("i", "j").cogroup(q.groupBy("i", "j")).applyInPandas(nearest, f"query_id {asked}, id {kind}, vector_distance double")
    best = Window.partitionBy("query_id").orderBy("vector_distance", "id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)
    return ranked.select("query_id", F.col("rank"), F.col("id").alias(id_col), "vector_distance")


def fuse(vector: DataFrame, keyword: DataFrame, id_col: str, limit: int = LIMIT) -> DataFrame:
    """Reciprocal-rank fusion of two ranked candidate lists by a full outer join.

    The lists are bounded by the candidate limit, so ranking them in one task is fine.
    Ties: vector rank first, then keyword rank.
    """
    v = vector.withColumn("vector_rank", F.row_number().over(Window.orderBy("vector_distance", id_col)))
    k = keyword.withColumn("bm25_rank", F.row_number().over(Window.orderBy(F.desc("bm25_score"), id_col)))
    part = lambda rank: F.coalesce(1.0 / (F.lit(float(RRF)) + F.col(rank)), F.lit(0.0))
    fused = v.join(k, id_col, "full_outer").withColumn("rrf_score", part("vector_rank") + part("bm25_rank"))
    order = [F.desc("rrf_score"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("bm25_rank")]
    return fused.select(id_col, "vector_distance", "bm25_score", "rrf_score", "vector_rank", "bm25_rank").orderBy(*order).limit(limit).drop("vector_rank", "bm25_rank")


def hybrid_search(chunks: DataFrame, vectors: DataFrame, text: str, query: list[float], id_col: str, text_col: str, vector_col: str, limit: int = LIMIT) -> DataFrame:
    """Both searches at the candidate limit, fused."""
    n = candidate_limit(limit)
    return fuse(vector_search(vectors, query, id_col, vector_col, n), keyword_search(chunks, text, id_col, text_col, n), id_col, limit)
