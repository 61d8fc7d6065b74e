"""A stored inverted index: keyword search that reads the postings of its terms and no text.

Documents are dealt into slots of texts of similar size; all of a document's postings lie in its
slot. A row of the index is one term in one slot: how many of the slot's documents hold it,
the largest frequency, the shortest of them, and the documents themselves. The rows are
kept in folders by version and by a hash of the term, so a version is appended without
touching others and a question reads its terms' folders only.

BM25 depends on all visible versions (their number of documents, mean length and document
frequencies), so nothing of it is stored: the largest frequency and the shortest length
bound what a term can add in a slot under any of these statistics. A search scores the most
promising slots first and then reads only those whose bound reaches the k-th score found.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.search import B, K1, LIMIT, _query_terms

BUCKETS = 32  # folders of a version by term hash
SLOT, SLOT_BYTES = 512, 8 << 20  # documents and bytes of a slot, about
TASK_BYTES = 32 << 20  # bytes of text for each task of a build, where that gives more tasks than the session has shuffle partitions
FIRST = 16  # slots that are scored first
NAMED = 1000  # slots that a filter names; beyond, they are joined
SLACK = 1 - 1e-9  # sums of the same numbers in another order


def bucket(term: Column, buckets: int) -> Column:
    return (F.crc32(term.cast("binary")) % buckets).cast("int")


def weight(tf: Column, dl: Column, mean: Column | float) -> Column:
    """The part of a BM25 term that grows with the frequency and falls with the length."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))


def impact(idf: dict[str, float], tf: Column, dl: Column, mean: float) -> Column:
    """What the row's term adds to a document of this frequency and length."""
    rarity = reduce(lambda out, t: out.when(F.col("term") == t[0], F.lit(t[1])), idf.items(), F.when(F.lit(False), F.lit(0.0)))
    return rarity * weight(tf.cast("double"), dl, mean)


def dealt(rows: DataFrame, tasks: int, *keys) -> DataFrame:
    """Rows dealt by keys over the session's shuffle partitions, or over ``tasks`` where that is more."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, *keys) if tasks > least else rows.repartition(*keys)


def inverted(key: tuple, docs: pa.Table) -> pa.Table:
    """A slot's rows of the index, from its documents' lower-cased texts; terms are runs of a-z."""
    texts = docs["text"].combine_chunks().cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    letter = raw - np.uint8(97) < 26
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    starts = ends[:-1][ends[:-1] < len(raw)]
    begins[starts] = letter[starts]
    begins = np.flatnonzero(begins)
    places = np.append(np.cumsum(letter, dtype=np.int32)[begins] - 1, np.count_nonzero(letter)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(begins), pa.py_buffer(places), pa.py_buffer(raw[letter])).dictionary_encode()
    doc = ends.searchsorted(begins, side="right") - 1
    lengths = np.bincount(doc, minlength=len(texts)).astype(np.int32)
    pairs, tf = np.unique(words.indices.to_numpy().astype(np.int64) * len(texts) + doc, return_counts=True)
    term, doc = pairs // len(texts), pairs % len(texts)
    first = np.flatnonzero(np.diff(term, prepend=-1))
    lists = pa.array(np.append(first, len(term)), pa.int32())
    least = np.minimum.reduceat(lengths[doc], first) if len(first) else lengths[:0]
    most = np.maximum.reduceat(tf, first) if len(first) else tf[:0]
    columns = {
        "term": words.dictionary.take(pa.array(term[first])), "slot": pa.array(np.full(len(first), key[0].as_py()), pa.int64()),
        "n": pa.array(np.diff(np.append(first, len(term))), pa.int64()), "max_tf": pa.array(most, pa.int64()), "min_dl": pa.array(least, pa.int64()),
        "id": pa.ListArray.from_arrays(lists, docs["id"].combine_chunks().take(pa.array(doc))),
        "tf": pa.ListArray.from_arrays(lists, pa.array(tf, pa.int32())), "dl": pa.ListArray.from_arrays(lists, pa.array(lengths[doc], pa.int32())),
    }
    return pa.table(columns)


class Postings:
    """The index under a folder: ``postings`` by version and bucket, ``sizes`` by version.

    ids are unique within a version, of one type (``id_type``). A version's row in
    ``sizes`` is written last and makes it visible; a caller with its own commit marker
    names the versions it wants.
    """

    def __init__(self, spark: SparkSession, root: str, id_type: str = "bigint", buckets: int = BUCKETS):
        self.spark, self.root, self.id_type, self.buckets = spark, root.rstrip("/"), id_type, buckets

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], schema)
            raise

    @property
    def postings(self) -> DataFrame:
        return self._read("postings", f"term string, slot bigint, n bigint, max_tf bigint, min_dl bigint, docs array<struct<id:{self.id_type},tf:bigint,dl:bigint>>, version string, bucket int")

    @property
    def sizes(self) -> DataFrame:
        """(n, total, version): documents of each version and their length in terms."""
        return self._read("sizes", "n bigint, total bigint, version string")

    def append(self, chunks: DataFrame, id_col: str, text_col: str, version: str) -> None:
        """Add a version's documents. Only its own folders are written.

        A slot is a class of texts of similar size and a hash of the id; how many slots a class
        has follows from its number of documents and their bytes, so no slot is much larger than
        ``SLOT`` or ``SLOT_BYTES`` and no term, however common, is gathered beyond a slot. Texts
        are shuffled once, to their slots, and inverted there; what is shuffled then is the
        slots' rows, not a row a word.
        """
        size = F.octet_length(F.coalesce(F.col(text_col), F.lit("")))
        named = F.floor(2 * F.log2(size + 1)).cast("int").alias("class")  # two for each power of two
        classes = chunks.groupBy(named).agg(F.count("*").alias("n"), F.sum(size).alias("bytes")).collect()
        placed = chunks.select(F.col(id_col).cast(self.id_type).alias("id"), F.col(text_col).alias("_text"), named)
        slots = reduce(lambda out, c: out.when(F.col("class") == c["class"], F.lit(max(-(-c.n // SLOT), -(-c.bytes // SLOT_BYTES)))), classes, F.when(F.lit(False), F.lit(1)))
        slot = F.col("class").cast("bigint") * (1 << 32) + F.pmod(F.xxhash64("id"), slots.cast("bigint"))
        held = placed.select("id", F.lower(F.coalesce("_text", F.lit(""))).cast("binary").alias("text"), slot.alias("slot"))
        tasks = -(-sum(c.bytes for c in classes) // TASK_BYTES)
        rows = dealt(held, tasks, "slot").groupBy("slot").applyInArrow(inverted, f"term string, slot bigint, n bigint, max_tf bigint, min_dl bigint, id array<{self.id_type}>, tf array<int>, dl array<int>")
        folders = rows.withColumns({"version": F.lit(version), "bucket": bucket(F.col("term"), self.buckets)})
        files = max(4, -(-tasks // self.buckets))  # of each bucket
        ordered = dealt(folders, tasks, "bucket", F.pmod(F.xxhash64("term", "slot"), F.lit(files))).sortWithinPartitions("bucket", "term", "slot")
        docs = F.arrays_zip("id", "tf", "dl").cast(f"array<struct<id:{self.id_type},tf:bigint,dl:bigint>>")
        out = ordered.select("term", "slot", "n", "max_tf", "min_dl", docs.alias("docs"), "version", "bucket")
        out.write.mode("append").partitionBy("version", "bucket").parquet(f"{self.root}/postings")
        words = F.aggregate(F.col("docs.tf"), F.lit(0).cast("bigint"), lambda s, tf: s + tf)
        total = self.postings.where(F.col("version") == version).agg(F.coalesce(F.sum(words), F.lit(0)).alias("total")).first().total
        size = (sum(c.n for c in classes), total, version)
        self.spark.createDataFrame([size], "n bigint, total bigint, version string").coalesce(1).write.mode("append").partitionBy("version").parquet(f"{self.root}/sizes")

    def search(self, question: str, limit: int = LIMIT, versions: DataFrame | None = None, allowed: DataFrame | None = None) -> DataFrame:
        """(id, bm25_score) of the best documents; ties go to the smaller id.

        versions: (version) of what is visible, all by default; statistics are over all of
        it. allowed: (id) of the documents that may be found, which doesn't change scores.
        """
        visible = (self.sizes if versions is None else self.sizes.join(versions.select("version"), "version", "left_semi")).groupBy("version").agg(F.max("n").alias("n"), F.max("total").alias("total"))
        terms = sorted(set(_query_terms(question)))
        none = self.spark.createDataFrame([], f"id {self.id_type}, bm25_score double")
        if not terms:
            return none
        wanted = sorted({zlib.crc32(t.encode()) % self.buckets for t in terms})
        held = self.postings.where(F.col("bucket").isin(wanted) & F.col("term").isin(terms)).join(visible.select("version"), "version", "left_semi")
        found = held.groupBy("term").agg(F.sum("n").alias("df"), F.lit(None).cast("bigint").alias("total"))
        sizes = visible.agg(F.lit(None).cast("string").alias("term"), F.sum("n").alias("df"), F.sum("total").alias("total"))
        stats = {r.term: r for r in found.unionByName(sizes).collect()}  # a row a term of the question, and one
        whole = stats.pop(None)
        if not stats:
            return none
        mean = whole.total / whole.df
        idf = {t: F.log((F.lit(float(whole.df)) - r.df + 0.5) / (F.lit(float(r.df)) + 0.5) + 1) for t, r in stats.items()}
        bounds = held.groupBy("version", "slot").agg(F.sum(impact(idf, F.col("max_tf"), F.col("min_dl"), mean)).alias("bound"))

        def scored(rows: DataFrame) -> DataFrame:
            each = rows.select("term", "version", F.explode("docs").alias("d")).select("term", "version", "d.*")
            out = each.groupBy("version", "id").agg(F.sum(impact(idf, F.col("tf"), F.col("dl"), mean)).alias("bm25_score"))
            out = out if allowed is None else out.join(allowed.select("id"), "id", "left_semi")
            return out.select("id", "bm25_score").orderBy(F.desc("bm25_score"), "id").limit(limit)

        def named(slots) -> Column:
            return F.col("slot").isin(sorted({s.slot for s in slots})) & F.struct("version", "slot").isin([F.struct(F.lit(s.version), F.lit(s.slot)) for s in slots])

        first = bounds.orderBy(F.desc("bound"), "version", "slot").limit(FIRST).collect()
        reached = sorted(r.bm25_score for r in scored(held.where(named(first))).collect())  # limit rows
        least = reached[0] * SLACK if len(reached) == limit else 0.0
        rest = bounds.where(F.col("bound") >= least)
        slots = rest.limit(NAMED + 1).collect()
        if len(slots) > NAMED:
            return scored(held.join(rest.select("version", "slot"), ["version", "slot"], "left_semi"))
        return scored(held.where(named(slots)))


def built_from(spark: SparkSession, root: str, table: DataFrame, id_col: str, text_col: str, buckets: int = BUCKETS) -> Postings:
    """The index of a table's files, built where there is none yet; files that changed get an index of their own."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    signs = []
    for name in sorted(table.inputFiles()):
        file = path(name)
        status = file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(file)
        signs.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    digest = f"{zlib.crc32('|'.join(signs).encode()):08x}{zlib.adler32('|'.join(signs).encode()):08x}"
    index = Postings(spark, f"{root.rstrip('/')}/postings-{digest}-{id_col}-{text_col}", dict(table.dtypes)[id_col], buckets)
    if index.sizes.isEmpty():
        index.append(table, id_col, text_col, f"v{digest}")
    return index
