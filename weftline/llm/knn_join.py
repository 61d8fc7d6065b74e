"""Exact top-k by inner product as a Voronoi kNN join.

Vectors become integers, and equal vectors one class (its smallest ids are kept, as many
as can ever matter). Queries and data are grouped by their nearest pivot. From each
group's summary (size, radius, largest norm) and from the queries' scores with a bounded
sample of the data, every query group gets a score that at least k data vectors of other
ids are sure to reach; a data vector is copied to a query group only if its upper bound,
by distance or by angle, reaches that score. Each group is solved locally, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm._common import cut

PIVOTS = (16, 1024)  # the square root of the number of distinct vectors, within these
SAMPLE, SAMPLE_BYTES = 4096, 8 << 20  # distinct vectors, and their bytes, that the sure scores are looked up in
SCALE = 256.0
WHOLE = float(1 << 52)  # doubles from here on are whole
BLOCK = 4096  # data vectors, and queries, that meet in one task at a time
SALT = 64


def integer_vectors(table: DataFrame, id_col: str, vector_col: str, scale: float = SCALE) -> DataFrame:
    """(id, v array<double>): floor(scale * x) of each component, exact as a double.

    Left out: null vectors, vectors with a component that is null, NaN, infinite or
    infinite once scaled, and rows with a null id. Empty vectors stay.
    """
    x = F.transform(vector_col, lambda c: c.cast("double") * scale)
    fine = F.forall(x, lambda y: F.coalesce(F.abs(y) < float("inf"), F.lit(False)))
    v = F.transform(x, lambda y: F.when(F.abs(y) < WHOLE, F.floor(y).cast("double")).otherwise(y))
    return table.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & fine).select(F.col(id_col).cast("bigint").alias("id"), v.alias("v"))


def smallest_ids(vectors: DataFrame, n: int) -> DataFrame:
    """(v, ids): the n smallest ids of each distinct vector, first within salts, so no task meets a whole class."""
    salted = Window.partitionBy("v", "salt").orderBy("id")
    part = vectors.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALT))).withColumn("r", F.row_number().over(salted)).where(F.col("r") <= n)
    return part.groupBy("v").agg(F.slice(F.array_sort(F.collect_list("id")), 1, n).alias("ids"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as float64 rows, shorter ones filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy().astype(np.float64)
    out = np.zeros((len(column), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def low_bits(x: np.ndarray) -> np.ndarray:
    """Whole doubles as integers modulo 2^64."""
    small = np.abs(x) < 2.0**63
    rest = np.fmod(np.where(small, 0, x), 2.0**64)  # a multiple of 2^11, so the sum below is exact
    return np.where(small, np.where(small, x, 0).astype(np.int64), np.where(rest < 0, rest + 2.0**64, rest).astype(np.uint64).view(np.int64))


def inner_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """All integer inner products as int64; one beyond 64 bits counts as the largest or smallest."""
    top, width = np.iinfo(np.int64), max(1, q.shape[1])
    with np.errstate(over="ignore", invalid="ignore"):
        near, error = q @ x.T, np.abs(q) @ np.abs(x).T * (width * 2.0**-52)
        if error.max(initial=0) * 2.0**52 < width * 2.0**53:
            return near.astype(np.int64)  # every partial sum is a whole double
        out = low_bits(q) @ low_bits(x).T  # exact wherever the product fits
        inside = np.abs(near) + error < 2.0**63
        beyond = np.abs(near) - error >= 2.0**63
    out[beyond] = np.where(near[beyond] > 0, top.max, top.min)
    for i, j in zip(*np.nonzero(~(inside | beyond))):
        exact = sum(int(a) * int(b) for a, b in zip(q[i].tolist(), x[j].tolist()))
        out[i, j] = min(max(exact, top.min), top.max)
    return out


def voronoi(classes: DataFrame, pivots: np.ndarray, sample: tuple[np.ndarray, np.ndarray] | None = None, most: int = 0) -> DataFrame:
    """Adds cell, dist (to the pivot), angle (to it), norm and sure: a score that ``most`` rows of the sample (vectors, their numbers of rows) reach, -infinity without one."""
    width = pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half, lengths = (pivots**2).sum(axis=1) / 2, np.linalg.norm(pivots, axis=1)
        for batch in batches:
            x = matrix(batch.column("v"), width)
            with np.errstate(over="ignore", invalid="ignore"):
                norm = np.sqrt((x**2).sum(axis=1))
                cell = (half - x @ pivots.T).argmin(axis=1) if len(x) else np.zeros(0, np.int64)
                dist = np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1))
                angle = angles((x * pivots[cell]).sum(axis=1), norm * lengths[cell])
                sure = np.full(len(x), -np.inf)
                if sample is not None and len(x) and sample[1].sum() >= most:
                    scores = x @ sample[0].T
                    order = np.argsort(-scores, axis=1)
                    at = (np.cumsum(sample[1][order], axis=1) >= most).argmax(axis=1)
                    sure = scores[np.arange(len(x)), order[np.arange(len(x)), at]] - 1e-9 * norm * np.linalg.norm(sample[0], axis=1).max()
            arrays = [*batch.columns, pa.array(cell, pa.int32()), *map(pa.array, (dist, angle, norm, np.where(np.isnan(sure), -np.inf, sure)))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "cell", "dist", "angle", "norm", "sure"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema.fields)
    return classes.mapInArrow(run, f"{fields}, cell int, dist double, angle double, norm double, sure double")


def angles(product: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Angles from inner products and products of norms; 0 where a norm is 0, which no bound needs to know better."""
    return np.arccos(np.clip(np.where(norms > 0, product / np.where(norms > 0, norms, 1), 1), -1, 1))


def summaries(cells: DataFrame) -> dict[int, tuple[int, float, float, float, float, int]]:
    """Of each cell: rows, radius, largest norm, widest angle, least sure score and distinct vectors; at most one row a pivot."""
    of = [F.sum("size"), F.max("dist"), F.max("norm"), F.max("angle"), F.min("sure"), F.count("*")]
    return {r[0]: tuple(r[1:]) for r in cells.groupBy("cell").agg(*(c.alias(f"c{i}") for i, c in enumerate(of))).collect()}


def sure_scores(queries: dict, data: dict, pivots: np.ndarray, k: int) -> dict[int, float]:
    """For each query cell a score that k data vectors reach for each of its queries.

    For q within U of pivot a and x within R of pivot p: q.x >= a.p - U|p| - |q|R. The
    queries' own sure scores may be better.
    """
    cells = sorted(data)
    rows, radius = (np.array([data[p][i] for p in cells], float) for i in (0, 1))
    lengths, out = np.linalg.norm(pivots[cells], axis=1) if cells else np.zeros(0), {}
    for a, (_, u, longest, _, own, _) in queries.items():
        low = pivots[cells] @ pivots[a] - u * lengths - longest * radius if cells else np.zeros(0)
        order = np.argsort(-low)
        enough = np.cumsum(rows[order]) >= k
        bound = low[order][enough.argmax()] if enough.any() else -np.inf
        out[a] = max(own, bound if np.isfinite(bound) else -np.inf)
    return out


def may_reach(x: np.ndarray, pivots: np.ndarray, cells: list[int], queries: dict, sure: dict[int, float]) -> np.ndarray:
    """(vectors, query cells): whether a query of the cell may score as high with the vector as its sure score.

    For q within U of pivot a, at an angle of at most A to it and no longer than L:
    q.x <= a.x + U|x|, and q.x <= L|x| cos(angle(a, x) - A) where that angle is wider than A.
    """
    anchors, least = pivots[cells], np.array([sure[c] for c in cells])
    reach, longest, wide = (np.array([queries[c][i] for c in cells], float) for i in (1, 2, 3))
    with np.errstate(over="ignore", invalid="ignore"):
        norm = np.sqrt((x**2).sum(axis=1))[:, None]
        product = x @ anchors.T
        by_distance = product + norm * reach
        apart = np.maximum(0, angles(product, norm * np.linalg.norm(anchors, axis=1)) - wide)
        by_angle = norm * longest * np.cos(apart)
        by_angle = np.where(by_angle < 0, np.inf, by_angle)  # a short query scores higher there
        slack = np.where(np.isfinite(least), 1e-6 * (1 + np.abs(least)), 0) + 1e-9 * norm * longest
        return ~(np.minimum(by_distance, by_angle) < least - slack)  # what isn't known stays


def query_groups(sizes: list[int], block: int) -> list[tuple[int, int]]:
    """(first group, number of groups) of each cell's queries: small cells share a group of at most ``block``, a larger one has several to itself."""
    spans, n, room = [], 0, 0
    for size in sizes:
        if size <= room:
            spans.append((n - 1, 1))
            room -= size
        else:
            count = -(-size // block)
            spans.append((n, count))
            n += count
            room = block - size if count == 1 else 0
    return spans


def top_k(table: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", n_pivots: int | None = None, scale: float = SCALE, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, id, score): each query's k best rows of ``table`` but its own id, all if fewer.

    Ties go to the smaller id. Vectors of unlike lengths score over their common prefix.
    Rows left out by ``integer_vectors`` take no part on either side; rows that repeat both
    id and integer vector count once, unlike vectors of an id are candidates each, and a
    query has the smallest of its vectors; scores beyond 64 bits count as the largest or
    smallest long; empty tables give an empty result.
    """
    spark = table.sparkSession
    rows = cut(integer_vectors(table, id_col, vector_col, scale).distinct())
    # so many of a list's rows can be a query's own: lists hold as many more than k
    most = k + (rows.groupBy("id").count().agg(F.max("count")).first()[0] or 1)
    data = cut(smallest_ids(rows, most).withColumn("size", F.size("ids")))
    asked = integer_vectors(queries, id_col, vector_col, scale).groupBy("id").agg(F.min("v").alias("v"))
    width = max(1, data.agg(F.max(F.size("v"))).first()[0] or 1, asked.agg(F.max(F.size("v"))).first()[0] or 1)
    n_pivots = n_pivots or max(PIVOTS[0], min(PIVOTS[1], int(data.count() ** 0.5)))
    # the distinct vectors of smallest hash, a bounded number; the first of them are the pivots
    chosen = data.orderBy(F.xxhash64("v"), "v").limit(max(n_pivots, min(SAMPLE, SAMPLE_BYTES // (8 * width)))).select("v", "size").toArrow()
    sample = (matrix(chosen.column("v"), width), chosen.column("size").to_numpy()) if chosen.num_rows else (np.zeros((1, width)), np.zeros(1, np.int64))
    pivots = sample[0][:n_pivots]

    asked_classes = cut(asked.groupBy("v").agg(F.min("id").alias("class"), F.count("*").alias("size")))
    query_cells, data_cells = cut(voronoi(asked_classes, pivots, sample, most)), cut(voronoi(data, pivots))
    q_sum, d_sum = summaries(query_cells), summaries(data_cells)
    sure = sure_scores(q_sum, d_sum, pivots, most)
    cells = sorted(q_sum)
    spans = query_groups([q_sum[c][5] for c in cells], block)
    shared = sorted(set(spans))  # a cell at most each, however many groups of queries there are
    members = [[i for i, span in enumerate(spans) if span == one] for one in shared]

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each span of query groups that may need the vector for one of its cells."""
        first, count = np.array(shared, np.int32).T
        for batch in batches:
            may = may_reach(matrix(batch.column("v"), width), pivots, cells, q_sum, sure)
            row, span = np.nonzero(np.stack([may[:, m].any(axis=1) for m in members], axis=1))
            taken = batch.select(["v", "ids"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(first[span]), pa.array(count[span]), *taken.columns], names=["first", "count", "v", "ids"])

    if not cells or not d_sum:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint").withColumnRenamed("vec_id", id_col)
    spread = max(1, -(-sum(n[0] for n in d_sum.values()) // block))
    needed = data_cells.select("v", "ids").mapInArrow(replicate, "first int, count int, v array<double>, ids array<bigint>")
    groups = F.explode(F.sequence("first", F.col("first") + F.col("count") - 1))
    near = cut(needed.select(groups.alias("part"), "v", "ids", F.pmod(F.xxhash64("ids"), F.lit(spread)).alias("salt")))
    of_cell = lambda i: F.create_map(*[F.lit(x) for c, span in zip(cells, spans) for x in (c, span[i])])[F.col("cell")]
    blocks = query_cells.withColumn("part", (of_cell(0) + F.pmod(F.xxhash64("class"), of_cell(1))).cast("int"))
    # a group of queries goes to every salt that holds data for it
    salts = near.select("part", "salt").distinct()
    there = blocks.join(salts, "part").select(F.col("part").alias("p"), F.col("salt").alias("s"), "class", "v")

    def solve(key, left: pa.Table, right: pa.Table) -> pa.Table:
        q, classes = matrix(left.column("v"), width), left.column("class").to_pylist()
        x, ids = matrix(right.column("v"), width), right.column("ids").to_pylist()
        rows = []
        if len(q) and len(x):
            for name, line in zip(classes, inner_products(q, x)):
                # as many classes in order of score, and all that tie with the last
                cutoff = np.partition(line, -most)[-most] if len(line) > most else line.min()
                best = sorted(((-int(line[j]), i) for j in np.flatnonzero(line >= cutoff) for i in ids[j]))[:most]
                rows.extend((name, i, -s) for s, i in best)
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("class", "vec_id", "score"), zip(*rows) if rows else ((), (), ()))})

    found = there.groupBy("p", "s").cogroup(near.groupBy("part", "salt")).applyInArrow(solve, "class bigint, vec_id bigint, score bigint")
    order = [F.desc("score"), F.asc("vec_id")]
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("class").orderBy(*order))).where(F.col("r") <= most)
    # each member of a query class takes the class's list without itself
    lists = best.groupBy("class").agg(F.array_sort(F.collect_list(F.struct(F.bitwise_not("score").alias("reversed"), "vec_id"))).alias("best"))
    members = asked.join(asked_classes.select("v", "class"), "v").select("id", "class")
    own = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("id")), 1, k)
    out = members.join(lists, "class").select(F.col("id").alias("query_id"), F.posexplode(own).alias("place", "b"))
    return out.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias(id_col), F.bitwise_not(F.col("b.reversed")).alias("score"))
