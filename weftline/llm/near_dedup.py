"""Near-duplicate components: banded MinHash candidates, sequential Bayesian verification, exact check.

Documents with the same shingle set are one class from the start. A class's signature
is cut into bands; classes that share a band are candidates. Candidate signatures are
compared in batches of hashes: a pair goes as soon as the posterior probability that
its similarity reaches the threshold falls below the chosen miss probability. The
survivors are checked on their full shingle sets.

No group emits all its pairs. In the first round each band bucket compares its members
with one of them only; further rounds take another member of a bucket's largest
component as the centre for those that lie outside it. What remains are buckets whose
members still lie in different components; there the members are dealt out in blocks,
and tasks compare blocks of different components on full sets in memory, giving out
fewer links than they have members. A pair that is left out lies in one component
already, so the components are those of all candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftline.llm._common import blocks, cut, cut_alone, cut_at, drop, small_batches

WORDS, PERCENT = 5, 80
BANDS, ROWS = 40, 5  # at similarity 0.8 a pair shares no band with probability 1.3e-7
BATCH = 20  # hashes compared at a time
MISS = 1e-6
BLOCK_BYTES = 2 << 20
STARS = 2  # rounds of comparison with one member of each bucket
SHARE = 256  # partners that meet one copy of a centre's signature or set, about
GROUP = 512  # members of a bucket that meet in one task at most, on either side
SET_BYTES = 16 << 20  # and bytes of their sets, about
BITS = 1 << 25  # bits of the id filter; its rows are 4 MB together at most

M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * M2
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text.

    A-Z are lower-cased; words are runs of anything but blank and \\t to \\r. With fewer
    words than the width the whole sequence is one shingle; without words there is none.
    Texts are bytes, valid UTF-8 or not.
    """
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(texts.cast(pa.binary()).view(pa.string())))
    parted = pc.ascii_split_whitespace(trimmed)
    flat = parted.flatten().dictionary_encode()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, flat.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(flat.dictionary))
    words = hashes[flat.indices.to_numpy()]
    offsets = parted.offsets.to_numpy() - parted.offsets[0].as_py()
    rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for i in range(width if len(rolled) else 0):
        rolled = mixed(rolled * M1 + words[i : i + len(rolled)])
    empty = pc.equal(pc.binary_length(trimmed), 0).to_pylist()
    out = []
    for s, e, none in zip(offsets[:-1].tolist(), offsets[1:].tolist(), empty):
        if none:
            out.append(np.empty(0, np.uint64))
        elif e - s >= width:
            out.append(np.unique(rolled[s : e - width + 1]))
        else:
            h = np.full(1, e - s, np.uint64)
            for w in words[s:e]:
                h = mixed(h * M1 + w)
            out.append(h)
    return out


def multipliers(n: int, seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 62, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """n minima for each non-empty set, of its hashes times n odd numbers; uint32 of shape (sets, n)."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out, buffer = np.empty((len(sets), n), np.uint32), np.empty_like(flat)
    for j, a in enumerate(multipliers(n)):
        np.multiply(flat, a, out=buffer)
        out[:, j] = np.minimum.reduceat(buffer, starts) >> np.uint64(32)
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key a band, which also depends on the band's number."""
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(signature), 1))
    parts = signature.reshape(len(signature), bands, rows).astype(np.uint64)
    for i in range(rows):
        key = mixed(key * M1 + parts[:, :, i])
    return key.view(np.int64)


FEATURES = "h bigint, n_shingles bigint, key binary, bands array<bigint>, sig binary"


def features(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, h, n_shingles, key, bands, sig) from (doc_id, h, text): the set's size and digest, its band keys and 16 bits of each minimum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text", BLOCK_BYTES):
                sets = shingle_sets(part.column("text"), width)
                full = [s for s in sets if len(s)]
                keys, sigs, held = [None] * len(sets), [None] * len(sets), [None] * len(sets)
                if full:
                    signature = signatures(full, bands * rows)
                    banded, short = band_keys(signature, bands, rows), signature.astype("<u2")
                    at = 0
                    for i, s in enumerate(sets):
                        if len(s):
                            keys[i], held[i], sigs[i] = xxhash.xxh3_128_digest(s.tobytes()), banded[at], short[at].tobytes()
                            at += 1
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("h"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(held, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                    names=["doc_id", "h", "n_shingles", "key", "bands", "sig"],
                )

    return small_batches(docs).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {FEATURES}")


def least_matches(percent: int, n: int, miss: float = MISS) -> list[tuple[int, int]]:
    """(hashes compared, matches needed to go on) after each batch.

    With a uniform prior the posterior of the similarity after m of t matches is
    Beta(m + 1, t - m + 1), so it reaches s with the probability that a binomial
    variable of t + 1 trials at s is at most m.
    """
    s, out = percent / 100, []
    for t in range(BATCH, n + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += comb(t + 1, m) * s**m * (1 - s) ** (t + 1 - m)
        out.append((t, m))
    return out


def surviving(left: np.ndarray, right: np.ndarray, needed: list[tuple[int, int]]) -> np.ndarray:
    """Indices of the pairs of signatures that no batch prunes."""
    alive, matches, done = np.arange(len(left)), np.zeros(len(left), np.int64), 0
    for t, m in needed:
        matches += (left[alive, done:t] == right[alive, done:t]).sum(axis=1)
        ok = matches >= m
        alive, matches, done = alive[ok], matches[ok], t
        if not len(alive):
            break
    return alive


def needed(table: DataFrame, id_col: str, ids: DataFrame, *also: str) -> DataFrame:
    """The rows of ``table`` whose id, with the columns ``also``, is among ``ids`` (the column id, those columns and others, which are added).

    A bitmap of hashed ids of fixed size is broadcast first, so that most other rows go
    before the shuffle; where it fills up it only stops saving.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(BITS)) + 1
    at = F.bitmap_bit_position(place(F.col("id")))
    bits = ids.groupBy(F.bitmap_bucket_number(place(F.col("id"))).alias("_part")).agg(F.bitmap_construct_agg(at).alias("_bits"))
    position = F.bitmap_bit_position(place(F.col(id_col)))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("bigint")
    likely = table.join(F.broadcast(bits), F.bitmap_bucket_number(place(F.col(id_col))) == F.col("_part")).where(F.getbit(byte, (position % 8).cast("int")) == 1)
    # an inner join with distinct ids: Spark would move a semi join below the filter
    return likely.select(*table.columns).join(ids.withColumnRenamed("id", id_col).distinct(), [id_col, *also])


def with_partners(pairs: DataFrame, table: DataFrame, payload: str) -> DataFrame:
    """(a, b, left, right): the payloads of both members of each pair; table: (cid, payload), one row a cid.

    A centre a may have very many partners: its payload is dealt out once for every
    SHARE of them, so that neither a task nor the network has it once a pair.
    """
    right = pairs.join(table.select(F.col("cid").alias("b"), F.col(payload).alias("right")), "b")
    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / SHARE).alias("shares"))
    left = shares.join(table.select(F.col("cid").alias("a"), F.col(payload).alias("left")), "a")
    left = left.select("a", "left", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    dealt = right.join(shares, "a").withColumn("share", F.pmod(F.xxhash64("b"), F.col("shares"))).drop("shares")
    return dealt.join(left, ["a", "share"]).select("a", "b", "left", "right")


def similar(pairs: DataFrame, classes: DataFrame, percent: int, n_hashes: int, miss: float) -> DataFrame:
    """The (a, b) whose signatures survive the Bayesian comparison."""
    pairs = cut(pairs)
    sigs = needed(classes.select("cid", "sig"), "cid", pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    thresholds = least_matches(percent, n_hashes, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(batch.num_rows, n_hashes) for c in ("left", "right"))
                keep = pa.array(surviving(left, right, thresholds))
                yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep)], names=["a", "b"])

    return with_partners(pairs, cut(sigs), "sig").mapInArrow(run, "a bigint, b bigint")


def built(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(cid, held) for the classes (cid, least, h): their sorted shingle hashes, from the row of that id and text hash."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text", BLOCK_BYTES):
                held = [s.tobytes() for s in shingle_sets(part.column("text"), width)]
                yield pa.RecordBatch.from_arrays([part.column("cid"), pa.array(held, pa.binary())], names=["cid", "held"])

    ids = wanted.select(F.col("least").alias("id"), "h", "cid")
    rows = needed(docs.select("doc_id", "h", "text"), "doc_id", ids, "h")
    return rows.select("doc_id", "h", "cid", "text").distinct().select("cid", "text").mapInArrow(build, "cid bigint, held binary")


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The (a, b) whose full sets share enough: 100 * intersection >= percent * union."""
    pairs = cut(pairs.distinct())
    wanted = needed(classes.select("cid", "least", "h"), "cid", pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    sets = cut(built(docs, cut(wanted), width))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column("left"), batch.column("right"))):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                if enough(shared(p, q), len(p), len(q), percent):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at)], names=["a", "b"])

    return with_partners(pairs, sets, "held").mapInArrow(check, "a bigint, b bigint")


def shared(p: np.ndarray, q: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(p) > len(q):
        p, q = q, p
    return int(np.count_nonzero(q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p))


def enough(both, n, m, percent: int):
    return 100 * both >= percent * (n + m - both)


def relabelled(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The edges between the labels' roots; nodes without a label are their own."""
    for c in "ab":
        edges = edges.join(labels.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")), c, "left")
    return edges.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))


def composed(labels: DataFrame, parent: DataFrame) -> DataFrame:
    """The labels, whose roots (and nodes new to them) now have the roots that ``parent`` says."""
    up = parent.select(F.col("node").alias("own"), F.col("root").alias("top"))
    moved = labels.join(up, F.col("root") == F.col("own"), "left").select("node", F.coalesce("top", "root").alias("root"))
    return moved.unionByName(parent).groupBy("node").agg(F.min("root").alias("root"))


def within_two(edges: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Labels that also join what lies within two of the edges, between the labels' roots, of one smallest node; equal ones are surely reachable, unlike ones may be."""
    edges = (edges if labels is None else relabelled(edges, labels)).where("a <> b")
    ways = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = ways.groupBy(F.col("a").alias("b")).agg(F.least(F.min("b"), F.first("a")).alias("root"))
    parent = ways.join(near, "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("root"))
    return cut(parent if labels is None else composed(labels, parent))


def components(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame | None:
    """(node, root) for every node of the edges (a, b) and of earlier labels: root is the smallest node reachable; None without edges and labels.

    Each round points every node at its smallest neighbour, follows the pointers to
    their ends by doubling, and goes on with the edges between different ends.
    """
    if labels is not None:
        edges = relabelled(edges, labels)
    edges = cut(edges.select("a", "b").where("a <> b").distinct())
    while not edges.isEmpty():
        ways = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = cut(ways.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
        while True:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("top"))
            higher = cut(parent.join(up, "root").select("node", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")))
            parent = higher.select("node", "root")
            if higher.where("moved").isEmpty():
                break
        labels = parent if labels is None else cut(composed(labels, parent))
        edges = cut(relabelled(edges, parent).where("a <> b").distinct())
    return labels


def labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Adds the root of each cid."""
    if labels is None:
        return members.withColumn("root", F.col("cid"))
    return members.join(labels.select(F.col("node").alias("cid"), "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))


def one_document(live: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges between the classes of each id that stands in rows of several sets."""
    keys = live.select("doc_id", "key", F.xxhash64("key").alias("h"))
    ids = cut(keys.groupBy("doc_id").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("doc_id"))
    rows = keys.join(ids, "doc_id").select("doc_id", "key").distinct().join(classes.select("key", "cid"), "key").select("doc_id", "cid")
    return rows.groupBy("doc_id").agg(F.min("cid").alias("a")).join(rows.withColumnRenamed("cid", "b"), "doc_id").select("a", "b")


def unsettled(buckets: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(bucket, cid, root) of the buckets whose members lie in several components, one of those with the same members."""
    rows = cut(labelled(buckets.select("bucket", "cid"), labels))
    shape = rows.groupBy("bucket").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("cid")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(7), "cid")).alias("h2")
    )
    kept = shape.where("lo <> hi and n > 2").groupBy("n", "h1", "h2").agg(F.min("bucket").alias("bucket")).select("bucket")
    return rows.join(kept, "bucket")


def star(members: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of one member of each bucket's largest component, another one each turn, and every member outside it."""
    own = members.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64(F.lit(turn), "cid").alias("h"), "cid")).alias("first"))
    top = own.groupBy("bucket").agg(F.max(F.struct("n", "root", "first.cid")).alias("top"))
    away = members.join(top, "bucket").where(F.col("root") != F.col("top.root"))
    return away.select(F.col("top.cid").alias("a"), F.col("cid").alias("b")).distinct()


def spanning(
    cid: np.ndarray, root: np.ndarray, sig: np.ndarray, sets: list[np.ndarray], side: np.ndarray | None, percent: int, thresholds: list[tuple[int, int]], elsewhere: list[frozenset] | None = None
) -> list[tuple[int, int]]:
    """Confirmed links that join all components of the members which any link between them joins; fewer than members.

    side: compare only members of unlike sides. elsewhere: the buckets of each member that
    come before this one; a pair that shares one of them meets there and isn't compared
    here. Pairs that known roots or a link found before have joined aren't compared either;
    all others are, first by signature batches, then on full sets.
    """
    label = np.unique(root, return_inverse=True)[1]
    sizes, found = np.array([len(s) for s in sets]), []
    for i in range(len(cid)):
        others = np.flatnonzero(side) if side is not None else np.arange(i + 1, len(cid))
        if side is not None and side[i]:
            continue
        others = others[label[others] != label[i]]
        others = others[100 * np.minimum(sizes[others], sizes[i]) >= percent * np.maximum(sizes[others], sizes[i])]
        if len(others):
            others = others[surviving(np.broadcast_to(sig[i], (len(others), sig.shape[1])), sig[others], thresholds)]
        for j in others.tolist():
            if label[j] != label[i] and (elsewhere is None or elsewhere[i].isdisjoint(elsewhere[j])) and enough(shared(sets[i], sets[j]), sizes[i], sizes[j], percent):
                found.append((int(cid[i]), int(cid[j])))
                label[label == label[j]] = label[i]
    return found


def across(members: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int, n_hashes: int, miss: float, group: int) -> DataFrame:
    """Confirmed links (a, b) between different components that share a bucket; members: (bucket, cid, root).

    In a bucket of more than ``group`` members, or of more set bytes than a block may
    have, the largest component is dealt to blocks of its own, and so are the others; a
    task takes one block of each kind, or two of the others. So the work follows members
    times strays, not members squared, and a task gives out fewer links than it has members.
    Full sets of a pair that shares several buckets are compared in the first of them only.
    """
    members = cut(members)
    buckets = members.groupBy("cid").agg(F.collect_list("bucket").alias("buckets"))  # one a band at most
    weighed = members.join(needed(classes.select("cid", "n_shingles"), "cid", members.select(F.col("cid").alias("id")).distinct()), "cid")
    own = weighed.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.sum(F.col("n_shingles") * 8).alias("bytes"))
    shape = own.groupBy("bucket").agg(F.max(F.struct("n", "bytes", "root")).alias("top"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    n_blocks = lambda n, size: F.greatest(F.ceil(n / group), F.ceil(size / SET_BYTES))
    small = (F.col("n") <= group) & (F.col("bytes") <= SET_BYTES)
    shape = shape.select(
        "bucket",
        F.col("top.root").alias("main"),
        F.when(small, 0).otherwise(n_blocks(F.col("top.n"), F.col("top.bytes"))).alias("main_blocks"),
        F.when(small, 1).otherwise(n_blocks(F.col("n") - F.col("top.n"), F.col("bytes") - F.col("top.bytes"))).alias("stray_blocks"),
    )
    rows = cut(members.join(shape, "bucket"))
    wanted = cut(needed(classes.select("cid", "least", "h", "sig"), "cid", rows.select(F.col("cid").alias("id")).distinct()))
    marks = cut(wanted.select("cid", "sig").join(built(docs, wanted, width), "cid").join(buckets, "cid"))
    is_main = (F.col("root") == F.col("main")) & (F.col("main_blocks") > 0)
    block = F.pmod(F.xxhash64("cid"), F.when(is_main, F.col("main_blocks")).otherwise(F.col("stray_blocks")))
    all_main, all_stray = (F.transform(F.sequence(F.lit(1), F.col(c)), lambda x: (x - 1).cast("bigint")) for c in ("main_blocks", "stray_blocks"))
    # groups: (m, s) with m >= 0 a block of the main component and s of the others; (-1 - i, j) two blocks i <= j of the others
    to_main = F.transform(all_stray, lambda s: F.struct(F.col("block").alias("m"), s.alias("s")))
    with_main = F.when(F.col("main_blocks") > 0, F.transform(all_main, lambda m: F.struct(m.alias("m"), F.col("block").alias("s")))).otherwise(F.array().cast("array<struct<m:bigint,s:bigint>>"))
    with_others = F.transform(all_stray, lambda s: F.struct((-1 - F.least(s, F.col("block"))).alias("m"), F.greatest(s, F.col("block")).alias("s")))
    dealt = rows.withColumn("is_main", is_main).withColumn("block", block)
    dealt = dealt.withColumn("groups", F.when(F.col("is_main"), to_main).otherwise(F.concat(with_main, with_others)))
    dealt = dealt.select("bucket", "cid", "root", "is_main", "block", F.explode("groups").alias("g")).join(marks, "cid")
    thresholds = least_matches(percent, n_hashes, miss)

    def compare(key, frame):
        import pandas as pd

        sig = np.frombuffer(b"".join(frame["sig"]), "<u2").reshape(len(frame), n_hashes)
        sets = [np.frombuffer(x, np.uint64) for x in frame["held"]]
        bucket, m, s = map(int, key)
        # two unlike blocks of the others meet across only: within a block they meet where it is alone
        side = frame["is_main"].to_numpy() if m >= 0 else None if -1 - m == s else (frame["block"] == s).to_numpy()
        before = [frozenset(b[b < bucket].tolist()) for b in map(np.asarray, frame["buckets"])]
        found = spanning(frame["cid"].to_numpy(), frame["root"].to_numpy(), sig, sets, side, percent, thresholds, before)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    columns = ("cid", "root", "is_main", "block", "sig", "held", "buckets")
    return dealt.select("bucket", F.col("g.m").alias("m"), F.col("g.s").alias("s"), *columns).groupBy("bucket", "m", "s").applyInPandas(compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, miss: float = MISS, group: int = GROUP) -> DataFrame:
    """One row per document: (id, n_shingles, component_id, kept).

    component_id is the smallest id reachable over links; the document of that id is
    kept. Null and empty texts have no shingles and no links. A row with a null id takes
    no part: its component_id is null and it is kept. Rows that repeat an id are one
    document: what is linked with any of their texts is linked with all. An id may be a
    struct, such as a row's key. Texts are compared as bytes, valid UTF-8 or not. Other columns
    are ignored; very long texts are compared whole; an empty table gives an empty result.
    """
    own = F.col(id_col) if isinstance(docs.schema[id_col].dataType, StructType) else F.col(id_col).cast("bigint")
    picked = docs.select(own.alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    picked = picked.select("doc_id", F.xxhash64("text").alias("h"), "text")
    wide, at = cut_at(features(picked, width, bands, rows))
    held = cut(wide.select("doc_id", "n_shingles", "key"))
    live = wide.where("doc_id is not null and key is not null")
    # equal sets have equal signatures, so any row's will do; the written numbers stay as they are
    first = [F.first(c).alias(c) for c in ("n_shingles", "bands", "sig")]
    classes = live.groupBy("key").agg(F.min(F.struct("doc_id", "h")).alias("row"), *first).select("key", F.col("row.doc_id").alias("least"), "row.h", "n_shingles", "bands", "sig")
    classes = cut(classes.withColumn("cid", F.monotonically_increasing_id()))
    drop(docs.sparkSession, at)  # the classes have what is read from here on
    live = held.where("doc_id is not null and key is not null")
    n = bands * rows

    edges, labels = cut_alone(lambda: one_document(live, classes)), None
    banded = classes.select("cid", F.explode("bands").alias("bucket"))
    met = banded.groupBy("bucket").agg(F.min("cid").alias("centre"), F.count("*").alias("n")).where("n > 1")
    buckets = cut(banded.join(met.select("bucket", "centre"), "bucket"))
    stars = buckets.where("cid <> centre").select(F.col("centre").alias("a"), F.col("cid").alias("b")).distinct()
    for turn in range(STARS):
        found = cut_alone(lambda: confirmed(similar(stars, classes, percent, n, miss), classes, picked, width, percent))  # noqa: B023
        edges, labels = edges.unionByName(found), within_two(found, labels)
        buckets = cut_alone(lambda: unsettled(buckets, labels))  # noqa: B023
        if buckets.isEmpty():
            break
        stars = star(buckets, turn)
    else:
        edges = edges.unionByName(cut_alone(lambda: across(buckets, classes, picked, width, percent, n, miss, group)))
    labels = components(edges, labels)

    ends = labelled(classes.select("key", "cid", "least"), labels)
    tops = ends.groupBy("root").agg(F.min("least").alias("component"))
    joined = held.select("doc_id", "n_shingles", "key").join(ends.join(tops, "root").select("key", "component"), "key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return joined.select(F.col("doc_id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
