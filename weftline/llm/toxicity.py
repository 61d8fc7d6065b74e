"""Toxicity by cumulative-link ordinal regression over sparse text features.

Grades run from 0 (clean) up. P(grade <= j) = sigmoid(theta_j - w.x): one weight vector
for all ordered thresholds. Features are words and word beginnings that the labelled
texts show to go with toxicity, valued by their logarithmic count in the whole text, so
clean texts have next to none and long ones gain nothing by their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm._common import blocks, cut, small_batches, utf8

LABELLED = 8_000  # labelled documents of each label that training takes at most
FEATURES = 4_096
LEAST = 5  # toxic labelled documents that must hold a feature
BEGINNINGS = (4, 5, 6)
BLOCK_BYTES = 2 << 20
CACHED_WORDS = 100_000
REJECTED = 0.25  # probability of a grade above clean from which a text is rejected
#: Whatever isn't a letter.
APART = r"[^\pL]+"


def words_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, the place there of each word of the texts one after another, number of words of each text); words are runs of letters, lower-cased; bytes that aren't UTF-8 part words."""
    clear = pc.replace_substring_regex(pc.utf8_lower(utf8(texts)), APART, " ")
    parted = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(clear))
    flat = parted.flatten().dictionary_encode()
    return flat.dictionary.to_pylist(), flat.indices.to_numpy(), np.diff(parted.offsets.to_numpy())


def word_features(word: str) -> list[str]:
    """A word and its beginnings (marked by a star)."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)] if word else []


def severest(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic): one row a labelled document."""
    return labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, toxic), written: the labels of documents that are there; others count nowhere. Ids alone move."""
    return cut(severest(labels).join(docs.select(F.col("doc_id").alias("_there")), F.col("doc_id") == F.col("_there"), "left_semi"))


def label_weights(known: DataFrame, limit: int) -> dict[bool, float]:
    """What a sampled document that is toxic, or isn't, stands for: how many there are over how many are in the sample."""
    kinds = known.groupBy((F.col("toxic") != 0).alias("bad")).agg(F.count("*").alias("n"))
    return {r.bad: r.n / min(limit, r.n) for r in kinds.collect()}


def sample(docs: DataFrame, known: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` labelled documents of either kind, those of the smallest hash of the id, one text each; (id, text, toxic).

    Of several texts of an id that of the smallest hash counts, so an id that repeats gives one row.
    """
    picked = [known.where(kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit) for kind in ("toxic = 0", "toxic <> 0")]
    # 2 * limit ids and marks at most
    rows = docs.select("doc_id", "text").join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")
    return rows.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "toxic")


def telling_features(texts: DataFrame, least: int = LEAST, limit: int = FEATURES) -> list[str]:
    """The features that go with the toxic label most surely: counted over the sample, chosen by the log-odds ratio, which must be higher for one that a clean text holds too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {}
            words, codes, sizes = words_of(batch.column("text"))
            for own, toxic in zip(np.split(codes, np.cumsum(sizes)[:-1]), batch.column("toxic").to_pylist()):
                for f in {f for i in set(own.tolist()) for f in word_features(words[i])}:
                    counts.setdefault(f, [0, 0])[1 if toxic else 0] += 1
            clean, bad = (pa.array((n[i] for n in counts.values()), pa.int64(), size=len(counts)) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(counts, pa.string(), size=len(counts)), clean, bad], names=["feature", "clean", "bad"])

    sizes = texts.agg(F.count_if(F.col("toxic") == 0).alias("clean"), F.count_if(F.col("toxic") != 0).alias("bad")).first()
    counted = texts.mapInArrow(run, "feature string, clean bigint, bad bigint").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad"))
    odds = F.log((F.col("bad") + 0.5) / (sizes.bad - F.col("bad") + 0.5)) - F.log((F.col("clean") + 0.5) / (sizes.clean - F.col("clean") + 0.5))
    spread = F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("clean") + 0.5))
    sure = counted.where(F.col("bad") >= least).withColumn("z", odds / spread).withColumn("odds", odds).where((F.col("z") > 2) & (F.col("odds") > F.when(F.col("clean") == 0, 3).otherwise(5)))
    return [r.feature for r in sure.orderBy(F.desc("z"), "feature").limit(limit).collect()]


class Vectoriser:
    """Log counts of known features; looks each distinct word up once a worker."""

    def __init__(self, features: list[str]):
        self.index = {f: i for i, f in enumerate(features)}
        self.words: dict[str, tuple[int, ...]] = {}

    def block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, feature, value) of a block's non-zero values, by text and feature."""
        words, codes, sizes = words_of(texts)
        if len(self.words) > CACHED_WORDS:
            self.words.clear()
        known, index = self.words, self.index
        hits = []
        for w in words:
            hit = known.get(w)
            if hit is None:
                hit = known[w] = tuple(index[f] for f in word_features(w) if f in index)
            hits.append(hit)
        lengths = np.fromiter(map(len, hits), np.int64, len(hits))
        flat = np.fromiter((f for hit in hits for f in hit), np.int64, int(lengths.sum()))
        row = np.repeat(np.arange(len(sizes)), sizes)
        row, codes = (x[lengths[codes] > 0] for x in (row, codes))
        each = lengths[codes]
        inside = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        feature = flat[np.repeat((np.cumsum(lengths) - lengths)[codes], each) + inside]
        key, n = np.unique(np.repeat(row, each) * max(1, len(index)) + feature, return_counts=True)
        return key // max(1, len(index)), key % max(1, len(index)), np.log1p(n)


class CumulativeLink:
    """Proportional odds: ordered thresholds, shared weights."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    @classmethod
    def fit(cls, of: np.ndarray, at: np.ndarray, x: np.ndarray, grades: np.ndarray, n_features: int, levels: int, l2: float = 1e-3, rounds: int = 2500, rate: float = 0.1, weights: np.ndarray | None = None) -> CumulativeLink:
        """Maximum likelihood with an L2 penalty by Adam; thresholds are a first one and positive steps, so they stay ordered. (of, at, x): row, feature and value of each non-zero. A row counts by its weight over the mean weight (none: all alike)."""
        balance = np.ones(len(grades)) if weights is None else weights / weights.mean()
        share = np.array([((grades <= j) * balance).mean() for j in range(levels - 1)]).clip(1e-3, 1 - 1e-3)
        start = np.log(share / (1 - share))
        p = np.concatenate((np.zeros(n_features), start[:1], np.log(np.maximum(np.diff(start), 1e-2))))
        m, v = np.zeros_like(p), np.zeros_like(p)
        n = len(grades)
        sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        for t in range(1, rounds + 1):
            w, theta = p[:n_features], np.cumsum(np.append(p[n_features], np.exp(p[n_features + 1 :])))
            score = np.bincount(of, weights=w[at] * x, minlength=n)
            edges = np.concatenate(([-np.inf], theta, [np.inf]))
            upper, lower = sigmoid(edges[grades + 1] - score), sigmoid(edges[grades] - score)
            upper, lower = np.where(grades == levels - 1, 1.0, upper), np.where(grades == 0, 0.0, lower)
            likely = np.maximum(upper - lower, 1e-9)
            du, dl = upper * (1 - upper) / likely * balance, lower * (1 - lower) / likely * balance
            g_score = (du - dl) / n
            g_theta = np.bincount(grades, weights=-du / n, minlength=levels)[: levels - 1] + np.bincount(np.maximum(grades - 1, 0), weights=dl * (grades > 0) / n, minlength=levels)[: levels - 1]
            tail = np.cumsum(g_theta[::-1])[::-1]  # each threshold holds all steps before it
            grad = np.concatenate((np.bincount(at, weights=g_score[of] * x, minlength=n_features) + l2 * w / max(1, n_features), tail[:1], tail[1:] * np.exp(p[n_features + 1 :])))
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        return cls(p[:n_features], np.cumsum(np.append(p[n_features], np.exp(p[n_features + 1 :]))))

    def predict(self, of: np.ndarray, at: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
        """(n, grades): probability of each grade of n rows."""
        score = np.bincount(of, weights=self.weights[at] * x, minlength=n)
        below = 1 / (1 + np.exp(-np.clip(self.thresholds - score[:, None], -40, 40)))
        return np.diff(np.column_stack((np.zeros(n), below, np.ones(n))), axis=1)


class ToxicityModel:
    """Grades 0 clean, 1 mild, 2 marked, 3 heavy; None as model where the labels show no toxicity."""

    LEVELS = 4

    def __init__(self, features: list[str], model: CumulativeLink | None):
        self.features, self.model = features, model


def train(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> ToxicityModel:
    """Fit on at most ``limit`` labelled documents of either kind, weighted to the labels' true mix.

    A label of 0 is clean, any other toxic. Labels beyond 1 are severities and are the
    grades, three at most. Where labels only say toxic or not, toxic documents are graded
    by how much telling vocabulary they hold (the sum of its log counts): its thirds are
    grades 1 to 3. Labels of unknown documents and null labels are left out; where a
    document has several labels the severest counts; a labelled document counts once, however
    many rows repeat it; without toxic labels every text is clean.
    """
    # the texts of a bounded sample, read several times
    known = labelled(docs, labels)
    texts = cut(sample(docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text")), known, limit))
    features = telling_features(texts)
    if not features:
        return ToxicityModel([], None)
    shown = Vectoriser(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, at, x = shown.block(batch.column("text"))
            ends = pa.array(np.searchsorted(of, np.arange(batch.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (at, x)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), *lists], names=["doc_id", "toxic", "at", "value"])

    # sparse rows of a bounded sample
    rows = texts.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(run, "doc_id bigint, toxic int, at array<bigint>, value array<double>").collect()
    rows.sort(key=lambda r: (r.doc_id, r.toxic, r.at, r.value))
    of = np.repeat(np.arange(len(rows)), [len(r.at) for r in rows])
    at, x = np.array([i for r in rows for i in r.at], np.int64), np.array([v for r in rows for v in r.value], np.float64)
    label = np.array([r.toxic for r in rows])
    toxic = label != 0
    if not toxic.any():
        return ToxicityModel([], None)
    if label.max() > 1:
        grades = np.where(toxic, np.clip(label, 1, ToxicityModel.LEVELS - 1), 0)
    else:
        evidence = np.bincount(of, weights=x, minlength=len(rows))
        grades = np.where(toxic, 1 + np.searchsorted(np.quantile(evidence[toxic], [1 / 3, 2 / 3]), evidence, side="right"), 0)
    stands_for = label_weights(known, limit)
    weights = np.array([stands_for[bool(t)] for t in toxic])
    return ToxicityModel(features, CumulativeLink.fit(of, at, x, grades, len(features), ToxicityModel.LEVELS, weights=weights))


def graded(model: tuple[Vectoriser, CumulativeLink | None], texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(probability of each grade of each text, whether it holds any feature)."""
    vectors, fitted = model
    n = len(texts)
    if fitted is None:
        return np.eye(1, ToxicityModel.LEVELS).repeat(n, axis=0), np.zeros(n, bool)
    of, at, x = vectors.block(texts)
    return fitted.predict(of, at, x, n), np.bincount(of, minlength=n) > 0


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", least: float = REJECTED) -> DataFrame:
    """One row per document: (id, severity, grade, p_toxic, rejected).

    severity is the expected grade, grade the likeliest, rejected says that a grade
    above 0 has at least the probability ``least``, on the evidence of some feature. Of
    equally likely grades the milder one is given. Null and empty texts are clean; repeated rows each give a row; other columns are ignored. Whole texts are read.
    """
    from pyspark.sql import types as T

    shared = docs.sparkSession.sparkContext.broadcast((Vectoriser(model.features), model.model))  # FEATURES entries at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text", BLOCK_BYTES):
                p, some = graded(shared.value, part.column("text"))
                toxic = 1 - p[:, 0]
                arrays = [part.column("id"), pa.array(p @ np.arange(p.shape[1])), pa.array(p.argmax(axis=1), pa.int32()), pa.array(toxic), pa.array((toxic >= least) & some)]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "severity", "grade", "p_toxic", "rejected"])

    schema = T.StructType.fromDDL("id bigint, severity double, grade int, p_toxic double, rejected boolean")
    picked = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return small_batches(picked).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, model: ToxicityModel, least: float = REJECTED) -> DataFrame:
    """The rows that aren't rejected, all columns; decided row by row, so nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast((Vectoriser(model.features), model.model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text", BLOCK_BYTES):
                p, some = graded(shared.value, pc.fill_null(part.column("text"), ""))
                yield part.filter(pa.array(~some | (1 - p[:, 0] < least), pa.bool_()))

    return small_batches(docs).mapInArrow(run, docs.schema)
