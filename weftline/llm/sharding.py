"""Two-pass external shuffle into shards, with DataFrame functions only.

Pass one scatters the records uniformly into memory-sized buckets by a seeded hash.
Pass two shuffles each bucket with Spark's seeded Fisher-Yates ``shuffle``. The buckets
one after another are a random order of all records, which is dealt to the shards in
turn: the law is ``rows``, shard sizes differ by one record at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm._common import cut

BUCKET_BYTES = 32 << 20
BUCKET_ROWS = 20_000
LAW = "rows"
ADDED = ("law", "shard", "slot", "grown_shard")


def bucket_count(records: int, size: int, bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Buckets so that each is expected to hold at most the given rows and bytes."""
    return max(1, -(-records // bucket_rows), -(-size // bucket_bytes))


def in_order(rows: F.Column, record: F.Column, records: DataFrame) -> F.Column:
    """A list of records in an order of their content; maps, which have none, go by their text."""
    if "map<" not in records.select(record.alias("r")).schema.simpleString():
        return F.array_sort(rows)
    text = lambda x: F.to_json(F.struct(x.alias("r")))
    return F.array_sort(rows, lambda a, b: F.when(text(a) < text(b), -1).when(text(a) > text(b), 1).otherwise(0))


def shuffled(records: DataFrame, id_col: str, n_buckets: int, seed: int) -> DataFrame:
    """(bucket, place, record): every record with its place in its shuffled bucket.

    The bucket is a hash of the seed, the id and the record's copy number, so rows that
    repeat an id spread like all others. Each bucket is sorted before it is shuffled,
    so that a task which runs again gives the same order.
    """
    columns = [c for c in records.columns if c != id_col]
    record = F.struct(F.col(id_col), *[F.col(f"`{c}`") for c in columns])
    # spread by the record's position too: one id may stand in very many rows
    copy = F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20))
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), copy), F.lit(n_buckets)).cast("int")
    # a bucket is a partition: whole texts of several would meet in one task if the bucket were hashed again
    scattered = records.select(bucket.alias("bucket"), record.alias("record")).repartitionById(n_buckets, F.col("bucket"))
    gathered = scattered.groupBy("bucket").agg(in_order(F.collect_list("record"), record, records).alias("records"))
    ordered = gathered.sortWithinPartitions("bucket").select("bucket", F.shuffle("records", F.lit(seed)).alias("records"))
    return ordered.select("bucket", F.posexplode("records").alias("place", "record"))


def shard(records: DataFrame, n_shards: int, id_col: str = "doc_id", size_col: str = "size", seed: int = 17) -> DataFrame:
    """All columns of ``records`` with law, shard, slot and grown_shard.

    Rows with null ids or null columns are records like all others; repeated rows each
    get a slot of their own; an empty table gives an empty result. The input's columns
    named like the added ones are replaced. Only the number of buckets' rows is
    accumulated in order, two numbers a bucket.
    """
    records = records.drop(*[c for c in ADDED if c in records.columns and c not in (id_col, size_col)])
    total = records.agg(F.count("*").alias("n"), F.coalesce(F.sum(size_col), F.lit(0)).alias("size")).first()
    n_buckets = bucket_count(total.n, total.size)
    placed = cut(shuffled(records, id_col, n_buckets, seed))  # the second pass reads what the first has written

    # where each bucket begins: sums within groups of buckets, then over the groups
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("group", F.floor(F.col("bucket") / 1000))
    groups = sizes.groupBy("group").agg(F.sum("n").alias("group_n"))
    group_start = F.sum("group_n").over(Window.orderBy("group")) - F.col("group_n")
    within = F.sum("n").over(Window.partitionBy("group").orderBy("bucket")) - F.col("n")
    starts = sizes.withColumn("within", within).join(groups.withColumn("group_start", group_start), "group")
    starts = starts.select("bucket", (F.col("within") + F.col("group_start")).alias("start"))

    position = F.col("start") + F.col("place")
    return placed.join(starts, "bucket").select(
        "record.*",
        F.lit(LAW).alias("law"),
        (position % n_shards).cast("int").alias("shard"),
        F.floor(position / n_shards).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(records: DataFrame, path: str, n_shards: int, id_col: str = "doc_id", size_col: str = "size", seed: int = 17, max_rows: int = 1_000_000) -> None:
    """Write whole records as Parquet folders ``shard=N``, in slot order, in files of at most ``max_rows`` records.

    A shard is written by as many tasks as it has spans of max_rows slots, none of which holds more.
    """
    out = shard(records, n_shards, id_col, size_col, seed).withColumn("span", F.floor(F.col("slot") / max_rows))
    out.repartition("shard", "span").sortWithinPartitions("shard", "span", "slot").drop("span").write.partitionBy("shard").parquet(path)


def sized(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The whole documents with size: the text's UTF-8 bytes (null: none) plus 1. A column of that name is replaced."""
    return docs.withColumn("size", (F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) + 1).cast("bigint"))


def digests(records: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32) and the columns of ``shard``, where there, from the text that each row holds; the checksum of a null text is that of no bytes."""
    checksum = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).cast("bigint").alias("text_crc32")
    return records.select(F.col(id_col), F.col("size"), checksum, *[c for c in ADDED if c in records.columns])


def document_records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32) of each document, without its text."""
    return digests(sized(docs.select(id_col, text_col), text_col), id_col, text_col)
