"""Exact dedup over a cuckoo-filter index of live digests.

The index holds a fingerprint of the digest of each live text in buckets of four, with
the text itself stored in the same bucket. A fingerprint hit is verified against that
content; a later row of the same text replaces the live entry by a deletion and an
insertion; when an insertion overflows, the index is rebuilt at twice the size from the
stored keys. Each map task first runs its own rows through such an index, so a text
that a third of all rows share crosses the network once a task; then the texts are dealt
by their digest to shards that are sized to fit a task's memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm._common import blocks

SLOTS = 4
KICKS = 200
BLOCK_BYTES = 4 << 20
HELD_BYTES = 32 << 20  # of texts and entries that a map task's index holds before it is given out, about
SHARD_BYTES = 32 << 20  # of texts and entries that a shard is expected to hold, before copies go
ENTRY_BYTES = 400  # that an entry takes beside its text, about


class CuckooIndex:
    """Fingerprints of 16-byte digests in buckets of four, each beside the key, content and values it stands for.

    Every digest has two buckets: one from the digest, the other from the first and the
    fingerprint, so an entry can move knowing only itself. Texts of one digest that
    differ are entries of their own.
    """

    def __init__(self, buckets: int = 1024):
        self.size = 1 << max(2, (buckets - 1).bit_length())
        self.prints: list[list[int]] = [[] for _ in range(self.size)]
        self.stored: list[list[tuple[bytes, bytes, list]]] = [[] for _ in range(self.size)]
        self.resizes = 0

    @staticmethod
    def _print(key: bytes) -> int:
        return int.from_bytes(key[:2], "little") or 1

    def _first(self, key: bytes) -> int:
        return int.from_bytes(key[8:16], "little") & (self.size - 1)

    def _other(self, bucket: int, fingerprint: int) -> int:
        return (bucket ^ (fingerprint * 0x5BD1E995)) & (self.size - 1)

    def _place(self, key: bytes, content: bytes) -> tuple[int, int] | None:
        """Where a live text stands: the fingerprint only says where to look; key and content decide."""
        fingerprint, bucket = self._print(key), self._first(key)
        for b in (bucket, self._other(bucket, fingerprint)):
            if fingerprint in self.prints[b]:
                for i, (held, stored, _) in enumerate(self.stored[b]):
                    if held == key and stored == content:
                        return b, i
        return None

    def find(self, key: bytes, content: bytes = b"") -> list | None:
        """The values of a live text."""
        at = self._place(key, content)
        return self.stored[at[0]][at[1]][2] if at else None

    def insert(self, key: bytes, values: list, content: bytes = b"") -> None:
        entry, fingerprint, bucket = (key, content, values), self._print(key), self._first(key)
        other = self._other(bucket, fingerprint)
        bucket = bucket if len(self.prints[bucket]) <= len(self.prints[other]) else other
        for kick in range(KICKS):
            if len(self.prints[bucket]) < SLOTS:
                self.prints[bucket].append(fingerprint)
                self.stored[bucket].append(entry)
                return
            i = kick % SLOTS
            fingerprint, self.prints[bucket][i] = self.prints[bucket][i], fingerprint
            entry, self.stored[bucket][i] = self.stored[bucket][i], entry
            bucket = self._other(bucket, fingerprint)
        self._grow(entry)

    def delete(self, key: bytes, content: bytes = b"") -> bool:
        """Take a live text out; False where it isn't there."""
        at = self._place(key, content)
        if at:
            del self.stored[at[0]][at[1]], self.prints[at[0]][at[1]]
        return at is not None

    def _grow(self, homeless: tuple[bytes, bytes, list]) -> None:
        held, resizes = [*(e for bucket in self.stored for e in bucket), homeless], self.resizes
        self.__init__(self.size * 2)
        self.resizes = resizes + 1
        for key, content, values in held:
            self.insert(key, values, content)

    def entries(self) -> Iterator[tuple[bytes, list]]:
        for bucket in self.stored:
            for key, _, values in bucket:
                yield key, values

    def texts(self) -> Iterator[tuple[bytes, bytes, list]]:
        for bucket in self.stored:
            yield from bucket

    def add(self, key: bytes, content: bytes, i: int | None, n: int) -> bool:
        """Count n rows of a text whose largest id is i; whether the text is new here."""
        live = self.find(key, content)
        if live is None:
            self.insert(key, [i, n], content)
        elif i is not None and (live[0] is None or i > live[0]):
            self.delete(key, content)  # the newer row takes the older one's place
            self.insert(key, [i, live[1] + n], content)
        else:
            live[1] += n
        return live is None


def content_key(text: F.Column) -> F.Column:
    """SHA-256 and byte length of a text: the name under which rows find what the index says of their text."""
    return F.concat(F.unhex(F.sha2(text.cast("binary"), 256)), F.unhex(F.lpad(F.hex(F.octet_length(text)), 8, "0")))


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)


def indexed(batches: Iterator[pa.RecordBatch], limit: float, row) -> Iterator[list[tuple]]:
    """What an index over rows (text, id, n) holds at the end, and whenever it holds more than ``limit`` bytes: lists of row(digest, text, id, n)."""
    index, held = CuckooIndex(), 0

    def given_out() -> Iterator[list[tuple]]:
        rows, size = [], 0
        for key, content, (i, n) in index.texts():
            rows.append(row(key, content, i, n))
            size += len(content) + 64
            if size > BLOCK_BYTES:
                yield rows
                rows, size = [], 0
        yield rows

    for batch in batches:
        for part in blocks(batch, "text", BLOCK_BYTES):
            for content, i, n in zip(*(part.column(c).to_pylist() for c in ("text", "id", "n"))):
                if index.add(xxhash.xxh3_128_digest(content), content, i, n):
                    held += len(content) + ENTRY_BYTES
                if held > limit:
                    yield from given_out()
                    index, held = CuckooIndex(), 0
    yield from given_out()


def groups(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, keep_id, group_size): of each distinct text, named by its ``content_key``, the largest id and the number of rows.

    A null id counts as smaller than all others, a null text as empty.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), F.lit(1).cast("bigint").alias("n"))

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in indexed(batches, HELD_BYTES, lambda key, text, i, n: (key[:8], text, i, n)):
            yield _batch(held, ["digest", "text", "id", "n"], [pa.binary(), pa.binary(), pa.int64(), pa.int64()])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = lambda text: hashlib.sha256(text).digest() + (len(text) & 0xFFFFFFFF).to_bytes(4, "big")
        for held in indexed(batches, float("inf"), lambda key, text, i, n: (name(text), i, n)):
            yield _batch(held, ["key", "keep_id", "group_size"], [pa.binary(), pa.int64(), pa.int64()])

    size = rows.agg(F.sum(F.octet_length("text") + ENTRY_BYTES)).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    dealt = rows.mapInArrow(combine, "digest binary, text binary, id bigint, n bigint").repartition(shards, "digest")
    return dealt.select("text", "id", "n").mapInArrow(settle, "key binary, keep_id bigint, group_size bigint")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key): null texts count as empty."""
    return docs.select(F.col(id_col).cast("bigint").alias("id"), content_key(F.coalesce(F.col(text_col), F.lit(""))).alias("key"))


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id, keep_id, group_size, kept, text_sha256).

    Texts are equal when identical; the row with the largest id of each group is kept.
    Null texts count as empty; a null id is smaller than all others and kept only if
    alone; rows that repeat the kept id are all marked kept (they are the same row to
    this table); very long texts are compared whole; other columns are ignored; an empty
    table gives an empty result.
    """
    joined = keyed(docs, id_col, text_col).join(groups(docs, id_col, text_col), "key")  # skewed keys are split by adaptive execution: both sides come from plain exchanges
    return joined.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex(F.substring("key", 1, 32))).alias("text_sha256"),
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns; of rows that repeat the kept id and text, one."""
    # plain columns beside the whole row on both sides, so that the join's partitioning also serves the last step and no input column is touched
    keys = lambda i: [F.coalesce(i, F.lit(0).cast("bigint")).alias("id"), i.isNull().alias("no_id")]
    keep = groups(docs, id_col, text_col).select("key", *keys(F.col("keep_id")))
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    marked = docs.select(whole, content_key(F.coalesce(F.col(text_col), F.lit(""))).alias("key"), *keys(F.col(id_col).cast("bigint")))
    return marked.join(keep, ["key", "id", "no_id"], "left_semi").dropDuplicates(["key", "id", "no_id"]).select("row.*")
