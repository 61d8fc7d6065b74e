"""Packing of token sequences by cutting-stock column generation.

A document's ids are cut at multiples of the capacity; full pieces are sequences of
their own, and the rest lengths are the items of a cutting-stock problem. Its linear
program runs over patterns (how many items of each length class share a sequence):
the restricted master is solved by the simplex method, and a knapsack dynamic program
over the dual prices finds each new pattern. Only the histogram of length classes,
whose size is bounded by the capacity, comes to the driver. The rounded pattern counts
say which ranks of each class go into which sequence; the ranks come from each task's
own numbering and its counts by class, so no task ever holds a whole class.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm._common import blocks, cut, release, small_batches, utf8
from weftline.llm.bpe import MergeTable, replay_bytes
from weftline.llm.byte_bpe import gather

CAPACITY = 2048
SHORT = 64  # pieces up to this length have classes of their exact length and sequences of their own
UNIT = 16  # width in tokens of the classes beyond
BLOCK_BYTES = 8 << 20
CACHED_CHUNKS = 200_000

#: White space beyond ASCII, which the tokenizer also drops.
WIDE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


class WordBPE:
    """Ids of a lower-casing word-end BPE file, computed for all distinct chunks of a block at once.

    Chunks are what white space separates. Texts or chunks with anything beyond
    letters of the Latin, Greek and Cyrillic blocks, ASCII and plain case rules (and
    texts with a special token's string) go to the tokenizers library itself.
    """

    def __init__(self, path: str):
        import tokenizers

        self.library = tokenizers.Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.table = MergeTable.from_merges(vocab, [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges])
        shown = byte_letters()
        self.first = np.array([vocab[shown[b]] for b in range(256)], np.int32)
        self.final = np.array([vocab[shown[b] + "</w>"] for b in range(256)], np.int32)
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        kind = np.full(256, 3, np.int8)
        kind[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = 1
        kind[[*range(ord("0"), ord("9") + 1)]] = 2
        self.kind = kind
        letters = "".join(f"\\x{{{c:x}}}" for c in range(0xAA, ord("ԯ")) if chr(c).isalpha())
        self.odd = rf"[^\x00-\x26\x28-\x7f{letters}]"  # quotes, and what is neither ASCII nor such a letter
        self.chunks: dict[bytes, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def simple(self, chunks: list[bytes]) -> list[bool]:
        """Whether each chunk is plain enough for the merge replay."""
        return pc.invert(pc.match_substring_regex(pa.array(chunks, pa.binary()).cast(pa.string()), self.odd)).to_pylist()

    def learn(self, missing: list[bytes]) -> list[bytes]:
        """Ids of distinct chunks."""
        simple = self.simple(missing)
        out = [b"" if ok else self.whole(c.decode()) for c, ok in zip(missing, simple)]
        todo = [c for c, ok in zip(missing, simple) if ok]
        lengths = np.fromiter(map(len, todo), np.int64, len(todo))
        raw = np.frombuffer(b"".join(todo), np.uint8)
        if not len(raw):
            return out
        kind = self.kind[raw]
        begins = np.empty(len(raw), bool)  # a word is a run of letters, a digit, or a run of other marks
        begins[0] = True
        begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        begins[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
        at = np.flatnonzero(begins)
        sizes = np.diff(np.append(at, len(raw)))
        symbols = self.first[raw]
        ends = at + sizes - 1
        symbols[ends] = self.final[raw[ends]]
        ids, counts = self.table.replay(symbols, sizes)
        chunk_of = np.repeat(np.arange(len(todo)), lengths)[at]
        packed, place, done = ids.astype("<u4").tobytes(), 0, iter(np.bincount(chunk_of, weights=counts, minlength=len(todo)).astype(np.int64).tolist())
        for i, ok in enumerate(simple):
            if ok:
                n = 4 * next(done)
                out[i] = packed[place : place + n]
                place += n
        return out

    def encode_block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and their number for each text; bytes that aren't UTF-8 are replaced by U+FFFD."""
        if len(self.chunks) > CACHED_CHUNKS:
            self.chunks.clear()
        plain, odd = [], {}
        for i, raw in enumerate(utf8(texts).cast(pa.binary()).to_pylist()):
            if b"<|" in raw and self.special.search(raw.decode()) or not raw.isascii() and re.search("[Σİ]", raw.decode()):
                odd[i] = raw.decode()
                plain.append(b"")
            elif raw.isascii():
                plain.append(raw.lower())
            else:
                plain.append(WIDE.sub(" ", unicodedata.normalize("NFC", raw.decode())).lower().encode())
        parted = pc.ascii_split_whitespace(pa.array(plain, pa.binary()).cast(pa.string()))
        flat = parted.flatten().dictionary_encode()
        codes = flat.indices.to_numpy()
        common = np.bincount(codes, minlength=len(flat.dictionary)) > 1
        distinct = sliced(flat.dictionary)
        ids = list(map(self.chunks.get, distinct))
        missing = [i for i, x in enumerate(ids) if x is None]
        for i, x in zip(missing, self.learn([distinct[i] for i in missing])):
            ids[i] = x
            if common[i]:
                self.chunks[distinct[i]] = x
        out, sizes = gather(np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4, codes)
        ends = np.append(0, np.cumsum(sizes))[parted.offsets.to_numpy() - parted.offsets[0].as_py()]
        counts = np.diff(ends)
        if odd:
            parts = np.split(out, ends[1:-1])
            for i, text in odd.items():
                parts[i] = np.frombuffer(self.whole(text), "<u4")
                counts[i] = len(parts[i])
            out = np.concatenate(parts)
        return out, counts


def sliced(words: pa.StringArray) -> list[bytes]:
    """The words as bytes; many times faster than one Arrow scalar a word."""
    whole, ends = (words.buffers()[2] or pa.py_buffer(b"")).to_pybytes(), np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].tolist()
    return [whole[s:e] for s, e in zip(ends, ends[1:])]


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where printable, else 256 and up."""
    own = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordBPE:
    """One per Python worker, kept from task to task."""
    return WordBPE(path)


PIECES = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, kind bigint, task bigint, place bigint, packed binary"
BATCH_IDS = 1 << 20  # ids of a result batch, about
BATCH_SEQUENCES = 500
CODEC = "zstd"
SPAN = ["offset", "doc_id", "start", "length", "doc_tokens"]
STORED = f"sequence_id bigint, ids binary, pieces array<struct<{','.join(f'{n}:bigint' for n in SPAN)}>>"  # ids little-endian, 32 bits each, compressed
SEQUENCES = f"sequence_id bigint, ids array<int>, pieces array<struct<{','.join(f'{n}:bigint' for n in SPAN)}>>"


def piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[c.split()[0] for c in PIECES.split(", ")])


def pieces(docs: DataFrame, path: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise every whole text, append ``end_id`` and cut at multiples of ``capacity``; each piece holds its ids.

    packed are the ids, 32 bits each, compressed; kind is the piece's length class; within a task the pieces of each kind are numbered
    from 0 by place. A null text counts as empty and gives one piece, the end id; null ids stay null;
    repeated rows each give their pieces; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, task, places = tokenizer(path), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for part in blocks(batch, "text", BLOCK_BYTES):
                ids, counts = bpe.encode_block(part.column("text"))
                rows, at, size = [], 0, 0
                tail = np.array([end_id], "<i4")
                for doc, n in zip(part.column("doc_id").to_pylist(), counts.tolist()):
                    own = np.concatenate((ids[at : at + n].astype("<i4"), tail))
                    at += n
                    for s in range(0, n + 1, capacity):
                        piece = own[s : s + capacity]
                        kind = length_class(len(piece), capacity)
                        rows.append((doc, s, len(piece), n + 1, kind, task, places[kind], pa.compress(piece, CODEC, asbytes=True)))
                        places[kind] += 1
                        size += len(piece)
                        if size >= BATCH_IDS:
                            yield piece_batch(rows)
                            rows, size = [], 0
                if rows:
                    yield piece_batch(rows)
                ids = rows = None
        release()  # the worker waits for its next task with little memory

    picked = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return small_batches(picked).mapInArrow(run, PIECES)


def price(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack's best pattern for ascending sizes: dynamic program over the room."""
    best, took = np.zeros(room + 1), np.full(room + 1, -1, np.int64)
    fit = np.searchsorted(sizes, np.arange(room + 1), side="right").tolist()
    for r in range(int(sizes[0]), room + 1):
        gain = values[: fit[r]] + best[r - sizes[: fit[r]]]
        i = gain.argmax()
        if gain[i] > best[r - 1] + 1e-12:
            best[r], took[r] = gain[i], i
        else:
            best[r] = best[r - 1]
    pattern, r = np.zeros(len(sizes), np.int64), room
    while r > 0:
        if took[r] < 0:
            r -= 1
        else:
            pattern[took[r]] += 1
            r -= int(sizes[took[r]])
    return float(best[room]), pattern


def column_generation(sizes: np.ndarray, demand: np.ndarray, room: int, rounds: int = 6000) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is used, covering the demand exactly.

    sizes: item sizes in units; demand: items of each size. The master starts from the
    patterns of one size each; the simplex method swaps in the pattern of the best price
    until none is worth more than a sequence. The counts are rounded down and what is
    left is packed first-fit-decreasing, which adds at most a few sequences a class.
    """
    m = len(sizes)
    if not m:
        return []
    columns = [np.where(np.arange(m) == i, room // sizes[i], 0) for i in range(m)]
    inverse = np.diag([sizes[i] / 1.0 / (sizes[i] * (room // sizes[i])) for i in range(m)])
    x = inverse @ demand
    for _ in range(rounds):
        value, pattern = price(inverse.sum(axis=0), sizes, room)
        if value <= 1 + 1e-7:
            break
        step = inverse @ pattern
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        x = x - ratio[out] * step
        x[out] = ratio[out]
        inverse[out] /= step[out]
        others = np.arange(m) != out
        inverse[others] -= np.outer(step[others], inverse[out])
        columns[out] = pattern
    left, used = demand.astype(np.int64).copy(), []
    for i in np.argsort(-x):
        pattern = columns[i]
        need = pattern > 0
        n = min(int(x[i] + 1e-6), int((left[need] // pattern[need]).min())) if need.any() else 0
        if n > 0:
            used.append((pattern, n))
            left -= pattern * n
    order = np.argsort(-sizes)
    while left.any():  # the rest: the greedy pattern, as often as it fits
        pattern, r = np.zeros(m, np.int64), room
        for i in order:
            pattern[i] = min(left[i], r // sizes[i])
            r -= int(pattern[i] * sizes[i])
        need = pattern > 0
        n = int((left[need] // pattern[need]).min())
        used.append((pattern, n))
        left -= pattern * n
    return used


PLAN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("kind", "from_rank", "to_rank", "each", "first_sequence", "first_place")])


def length_class(length: int, capacity: int) -> int:
    """The length that a piece counts with: exact up to SHORT tokens, beyond rounded up to a multiple of UNIT; 0 for full pieces."""
    return 0 if length >= capacity else length if length <= SHORT else -(-length // UNIT) * UNIT


def pack(parts: DataFrame, capacity: int = CAPACITY, stored: bool = False) -> DataFrame:
    """The packed sequences: (sequence_id, ids, pieces), one row a sequence; ``stored`` gives ids as ``STORED`` has them.

    parts: rows of ``pieces``, written (they are read several times). Sequences are
    numbered from 0; ids are those of the pieces one after another; pieces says for each
    its offset, doc_id, start, length and doc_tokens. A kind's pieces are ranked by task
    and place; an empty table gives an empty result.
    """
    spark = parts.sparkSession
    by_task = cut(parts.groupBy("kind", "task").agg(F.count("*").alias("n")))
    histogram = {r.kind: r.n for r in by_task.groupBy("kind").agg(F.sum("n").alias("n")).collect()}  # one row a class

    # where a task's pieces of each kind begin: a row a task, which Spark broadcasts while it is small, so the ids move once
    before = by_task.withColumn("before", F.sum("n").over(Window.partitionBy("kind").orderBy("task")) - F.col("n"))
    starts = cut(before.groupBy("task").agg(F.map_from_entries(F.collect_list(F.struct("kind", "before"))).alias("starts")))
    ranked = parts.join(starts, "task").withColumn("rank", F.element_at("starts", F.col("kind")) + F.col("place")).drop("starts", "task", "place")

    sizes = np.array(sorted(k for k in histogram if k), np.int64)
    plan, at, sequences = [], {int(k): 0 for k in sizes}, histogram.get(0, 0)
    if sequences:
        plan.append((0, 0, sequences, 1, 0, 0))
    demand, short = np.array([histogram[int(k)] for k in sizes], np.int64), sizes <= SHORT
    # short pieces by exact lengths, longer ones by classes; either by the linear program
    used = [(sizes[short], *u) for u in column_generation(sizes[short], demand[short], capacity)]
    used += [(sizes[~short], *u) for u in column_generation(sizes[~short] // UNIT, demand[~short], capacity // UNIT)]
    for of, pattern, n in used:
        first = 0
        for k, each in zip(of.tolist(), pattern.tolist()):
            if each:
                plan.append((k, at[k], at[k] + n * each, each, sequences, first))
                at[k] += n * each
                first += each
        sequences += n
    # a few hundred classes with a few patterns each, whatever the number of documents
    steps = spark.createDataFrame(plan, PLAN)
    inside = F.col("rank") - F.col("from_rank")
    placed = (
        ranked.join(F.broadcast(steps), "kind")
        .where((F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank")))
        .withColumn("sequence_id", F.col("first_sequence") + F.floor(inside / F.col("each")))
        .withColumn("order", F.col("first_place") + inside % F.col("each"))
    )
    before_it = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("order")) - F.col("length")
    of_one = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "doc_tokens", "packed")))
    gathered = placed.withColumn("offset", before_it).groupBy("sequence_id").agg(of_one.alias("parts"))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, BATCH_SEQUENCES):
                batch = whole.slice(s, BATCH_SEQUENCES)
                lists, flat = batch.column("parts"), batch.column("parts").flatten()
                lengths = flat.field("length").to_numpy()
                ids = b"".join(pa.decompress(x, 4 * n, CODEC, asbytes=True) for x, n in zip(flat.field("packed").to_pylist(), lengths.tolist()))
                begins = lists.offsets.to_numpy() - lists.offsets[0].as_py()
                ends = np.append(0, np.cumsum(lengths))[begins].astype(np.int32)
                spans = pa.StructArray.from_arrays([flat.field(n) for n in SPAN], SPAN)
                if stored:
                    held = pa.array([pa.compress(ids[4 * a : 4 * b], CODEC, asbytes=True) for a, b in zip(ends.tolist(), ends[1:].tolist())], pa.binary())
                else:
                    held = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(ids, "<i4")))
                arrays = [batch.column("sequence_id"), held, pa.ListArray.from_arrays(pa.array(begins, pa.int32()), spans)]
                yield pa.RecordBatch.from_arrays(arrays, names=["sequence_id", "ids", "pieces"])

    return gathered.mapInArrow(assemble, STORED if stored else SEQUENCES)


DIGESTS = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def digests(sequences: DataFrame) -> DataFrame:
    """A row for each piece of each stored sequence; the checksum is that of the ids that stand in the sequence at its offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("pieces")
            flat = lists.flatten()
            at, sizes = (flat.field(n).to_numpy().tolist() for n in ("offset", "length"))
            ends = (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist()
            checks = []
            for packed, first, last in zip(batch.column("ids").to_pylist(), ends, ends[1:]):
                ids = memoryview(pa.decompress(packed, 4 * sum(sizes[first:last]), CODEC, asbytes=True))
                checks += [zlib.crc32(ids[4 * at[i] : 4 * (at[i] + sizes[i])]) for i in range(first, last)]
            whole = {n: flat.field(n) for n in SPAN} | {"ids_crc32": pa.array(checks, pa.int64()), "sequence_id": batch.column("sequence_id").take(pa.array(np.repeat(np.arange(batch.num_rows), np.diff(ends))))}
            names = [c.split()[0] for c in DIGESTS.split(", ")]
            yield pa.RecordBatch.from_arrays([whole[n] for n in names], names=names)

    return sequences.mapInArrow(run, DIGESTS)


def pack_sequences(docs: DataFrame, path: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack into sequences of ids: see ``pieces`` and ``pack``."""
    return pack(cut(pieces(docs, path, end_id, capacity, id_col, text_col)), capacity)


def pack_documents(docs: DataFrame, path: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digests of all packed sequences, which are written first."""
    return digests(cut(pack(cut(pieces(docs, path, end_id, capacity, id_col, text_col)), capacity, stored=True)))
