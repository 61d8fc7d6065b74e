"""Byte-level BPE encoding and decoding by corpus-level merge replay (see ``bpe``)."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm._common import blocks, small_batches, utf8
from weftline.llm.bpe import MergeTable, replay_bytes

# The characters with Unicode's White_Space property.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

BLOCK_BYTES = 8 << 20
CACHED_CHUNKS = 300_000

ASCII_EDGES = re.compile(rb"\s\s|\A\s|\s\Z")
ANY_EDGES = re.compile(f"[{SPACES}][{SPACES}]|\\A[{SPACES}]|[{SPACES}]\\Z")
#: UTF-8 beginnings of the white space beyond ASCII; a text without them and without the runs below has only single blanks and line ends inside.
WIDE = [b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80"]
RUNS = [b"  ", b" \n", b"\n ", b"\n\n"]
RARE = [b"\t", b"\r", b"\x0b", b"\x0c"]


class ByteBPE:
    """Encoder and decoder over a rank file; holds a bounded cache of chunks.

    A chunk is what stands between two single blanks, its leading blank included. In a
    text without runs of white space no match of the pattern crosses a chunk's border,
    so chunks can be looked up whole; other texts are matched word by word.
    """

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.table = MergeTable.from_ranks(self.ranks)
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, i in self.ranks.items():
            self.tokens[i] = token
        self.sizes = np.fromiter(map(len, self.tokens), np.int64, len(self.tokens))
        self.flat_bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.first = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.match = regex.compile(pattern).findall
        self.chunks: dict[bytes, bytes] = {}

    def split(self, text: bytes) -> list[bytes]:
        return [w.encode() for w in self.match(text.decode())]

    def split_chunk(self, chunk: bytes) -> tuple[bytes, ...] | list[bytes]:
        """Matches of a chunk with its leading blank; all letters, or letters and one ASCII mark, need no pattern."""
        if chunk.isascii():
            if chunk.isalpha():
                return (b" " + chunk,)
            if chunk[:-1].isalpha() and not chunk[-1:].isalnum() and not chunk[-1:].isspace():
                return b" " + chunk[:-1], chunk[-1:]
        else:
            text = chunk.decode()
            if text.isalpha():
                return (b" " + chunk,)
            if text[:-1].isalpha() and chunk[-1] < 128 and not chunk[-1:].isalnum() and not chunk[-1:].isspace():
                return b" " + chunk[:-1], chunk[-1:]
        return self.split(b" " + chunk)

    def plain(self, text: bytes) -> bool:
        """Whether chunks can be looked up whole."""
        if any(x in text for x in WIDE):
            return not ANY_EDGES.search(text.decode())
        if any(x in text for x in RARE):
            return not ASCII_EDGES.search(text)
        return not (any(x in text for x in RUNS) or text[:1].isspace() or text[-1:].isspace())

    def encode_block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (uint32, one after another) and the number of ids of each text.

        The chunks of the block are looked up as a dictionary, so Python sees each
        distinct chunk once; those that stand twice or more are kept for later blocks.
        Bytes that aren't UTF-8 are replaced by U+FFFD.
        """
        if len(self.chunks) > CACHED_CHUNKS:
            self.chunks.clear()
        texts = utf8(texts)
        raw = texts.cast(pa.binary()).to_pylist()
        whole = np.array([self.plain(t) for t in raw], bool)
        # texts that need the pattern throughout count as one chunk: the head, which has no leading blank
        parted = pc.split_pattern(pc.if_else(pa.array(whole), texts, ""), " ")
        flat = parted.flatten().dictionary_encode()
        codes, firsts = flat.indices.to_numpy().copy(), parted.offsets.to_numpy()[:-1] - parted.offsets[0].as_py()
        common = np.bincount(codes, minlength=len(flat.dictionary)) > 1
        distinct = flat.dictionary.cast(pa.binary()).to_pylist()
        heads = [self.split(t.split(b" ", 1)[0] if ok else t) for t, ok in zip(raw, whole)]
        codes[firsts] = len(distinct) + np.arange(len(raw), dtype=codes.dtype)

        ids: list[bytes | None] = [self.chunks.get(c) for c in distinct]
        missing = {i: self.split_chunk(distinct[i]) for i, x in enumerate(ids) if x is None}
        word = self.merged(set().union(*missing.values(), *heads)).__getitem__
        for i, ws in missing.items():
            ids[i] = word(ws[0]) if len(ws) == 1 else b"".join(map(word, ws))
            if common[i]:
                self.chunks[distinct[i]] = ids[i]
        ids.extend(b"".join(map(word, ws)) for ws in heads)
        out, counts = gather(np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4, codes)
        return out, np.add.reduceat(counts, firsts) if len(raw) else counts

    def merged(self, words: Iterable[bytes]) -> dict[bytes, bytes]:
        """Ids of distinct words; those that aren't tokens themselves go through the merge replay."""
        found = {w: self.ranks[w].to_bytes(4, "little") for w in words if w in self.ranks}
        rest = [w for w in words if w not in found]
        found.update(zip(rest, replay_bytes(self.table, rest, self.first)))
        return found

    def decode_block(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Bytes of texts whose ids stand one after another."""
        out, sizes = gather(self.flat_bytes, self.sizes, ids)
        ends = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(counts))]
        whole = out.tobytes()
        return [whole[s:e] for s, e in zip(ends[:-1].tolist(), ends[1:].tolist())]


def gather(flat: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``flat`` (run i has sizes[i] items) in the order of codes, and their sizes."""
    starts, taken = np.cumsum(sizes) - sizes, sizes[codes]
    ends = np.cumsum(taken)
    at = np.repeat(starts[codes] - (ends - taken), taken)
    at += np.arange(len(at))
    return flat[at], taken


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> ByteBPE:
    """One per Python worker, kept from task to task."""
    return ByteBPE(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every text: (id, ids array<int>).

    A null text counts as empty and gives an empty array; a null id stays null; repeated
    rows each give a row; other columns are ignored. No shuffle: each partition is a
    corpus of its own, in blocks of bounded size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in batches:
            for part in blocks(batch, "text", BLOCK_BYTES):
                ids, counts = bpe.encode_block(part.column("text"))
                offsets = np.append(0, np.cumsum(counts)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.view("<i4")))], names=["id", "ids"])

    return _prepared(docs, id_col, text_col).mapInArrow(run, "id bigint, ids array<int>").withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Bytes of every id array: (id, bytes binary). Null arrays count as empty; an id outside the ranks raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in batches:
            out = [b"".join(bpe.tokens[i] for i in ids or ()) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], names=["id", "bytes"])

    picked = tokens.select(F.col(id_col).cast("bigint").alias("id"), F.col(ids_col).alias("ids"))
    return picked.mapInArrow(run, "id bigint, bytes binary").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode and digest in one pass, without moving the ids.

    Returns (id, n_tokens, ids_sha256, decoded_sha256); nulls and repeated rows as in ``encode``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        sha = hashlib.sha256
        for batch in batches:
            for part in blocks(batch, "text", BLOCK_BYTES):
                ids, counts = bpe.encode_block(part.column("text"))
                ends = np.cumsum(counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        pa.array(counts),
                        pa.array([sha(ids[e - n : e].astype("<u4")).hexdigest() for e, n in zip(ends.tolist(), counts.tolist())]),
                        pa.array([sha(x).hexdigest() for x in bpe.decode_block(ids, counts)]),
                    ],
                    names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    schema = "id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return _prepared(docs, id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return small_batches(docs).select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
