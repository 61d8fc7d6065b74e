"""From raw documents to packed training sequences.

Five stages, each over all that the one before has kept: toxic documents go, documents
without an identifiable language go, of equal texts one stays, of near-duplicates one
stays, and what is left is packed. Every stage but the last returns the columns of its
input, and decides row by row: a row without a doc_id, or with one that others have too,
goes or stays by itself.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import exact_dedup, language_id, near_dedup, packing, toxicity
from weftline.llm._common import cut, read
from weftline.session import reachable


def row_key(*columns: str) -> F.Column:
    """What tells a row from others, and orders rows by doc_id with null ids last; ``columns`` are what its stage decides by."""
    own = F.col("doc_id").cast("bigint")
    return F.struct(own.isNull().alias("none"), own.alias("doc_id"), F.xxhash64(*columns).alias("h"))


def without(docs: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """The rows of ``docs`` whose ``row_key`` of ``columns`` isn't among the column key of ``keys``.

    The keys are written first, so Spark knows their size when it plans the join: within
    its broadcast threshold the documents aren't shuffled, beyond it they are.
    """
    gone = cut(keys.select(F.col("key.doc_id").alias("gone"), F.col("key.h").alias("h")).distinct()).alias("other")
    own = F.col("own.doc_id").cast("bigint")
    same = (F.xxhash64(*(F.col(f"own.{c}") for c in columns)) == F.col("other.h")) & own.eqNullSafe(F.col("other.gone"))
    return docs.alias("own").join(gone, same, "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without toxic evidence, or with a probability of a grade above clean below toxicity.REJECTED, stay."""
    return toxicity.keep_clean(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found with enough certainty stay."""
    by = ("text", "lang", "source")
    found = language_id.identify(language_id.of_documents(docs, row_key(*by)))
    return without(docs, found.where("not kept").withColumnRenamed("id", "key"), *by)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays."""
    return exact_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at a similarity of 0.8 on five-word shingles the one with the smallest doc_id stays."""
    found = near_dedup.near_duplicates(docs.select(row_key("text").alias("key"), "text"), "key")
    return without(docs, found.where("not kept"), "text")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All remaining documents in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unidentified),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("packing", pack_sequences),
]

#: The first two stages apply trained models, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again."""
    reachable(spark)
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
