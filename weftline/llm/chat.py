"""Chat formatting with typed content parts.

A turn's content is a list of typed parts: text, image, audio, document. A visitor
flattens them in order into text and numbered placeholders and records for each
attachment its reference and how many tokens its placeholder expands to. The template
marks turns; control strings inside texts are escaped reversibly, so a formatted
conversation can always be read back.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
CONTROL = re.compile(r"<(\\*)\|")
ESCAPED = re.compile(r"<\\(\\*)\|")
TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)

PATCH, FRAME_MS, PAGE_TOKENS = 14, 40, 512


def escape(text: str) -> str:
    """Puts a backslash more between each "<" and "|", so that no control string is left; see ``unescape``."""
    return CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"<\1|", text)


@dataclass
class Flattener:
    """Visits parts in order; ``text`` and ``attachments`` are what has been visited so far."""

    text: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict) -> None:
        visitor = getattr(self, f"visit_{part.get('type')}", None)
        if visitor is None:
            raise ValueError(f"unknown part type {part.get('type')!r}")
        visitor(part)

    def visit_text(self, part: dict) -> None:
        self.text.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        """One token a patch of the picture, at least one."""
        rows, columns = (math.ceil((part.get(k) or 0) / PATCH) for k in ("height", "width"))
        self._placeholder("image", part, max(1, rows * columns))

    def visit_audio(self, part: dict) -> None:
        """One token a frame, at least one."""
        self._placeholder("audio", part, max(1, math.ceil((part.get("duration_ms") or 0) / FRAME_MS)))

    def visit_document(self, part: dict) -> None:
        """A fixed number of tokens a page, one page at least."""
        self._placeholder("document", part, PAGE_TOKENS * max(1, part.get("pages") or 0))

    def _placeholder(self, kind: str, part: dict, tokens: int) -> None:
        self.text.append(f"<|{kind}:{len(self.attachments)}|>")
        self.attachments.append({"type": kind, "uri": part.get("uri"), "tokens": tokens})


def flatten(parts: list[dict] | None) -> tuple[str, list[dict]]:
    """(flat escaped text with placeholders, attachments in order); nothing for null."""
    seen = Flattener()
    for part in parts or ():
        seen.visit({k: v for k, v in part.items() if v is not None})
    return "".join(seen.text), seen.attachments


def turn_text(role: str, flat: str) -> str:
    """A marked turn; the role is escaped too, line ends in it stand as \\n."""
    return f"{OPEN}{escape_role(role)}\n{flat}{CLOSE}\n"


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, flat escaped text) of each turn."""
    return [(unescape_role(m[1]), m[2]) for m in TURN.finditer(formatted)]


PART = "struct<type:string,text:string,uri:string,width:int,height:int,duration_ms:int,pages:int>"
TURNS = "conv_id bigint, turn bigint, role string, formatted string, attachments array<struct<type:string,uri:string,tokens:int>>, expanded_tokens bigint"


def format_turns(turns: DataFrame) -> DataFrame:
    """Each row (conv_id, turn, role, parts array<PART>) with its formatted text, attachments and their tokens.

    Null roles and null parts count as empty; an unknown part type raises; other columns
    are ignored. Row by row, so nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = [flatten(p) for p in batch.column("parts").to_pylist()]
            texts = [turn_text(r or "", f) for r, (f, _) in zip(batch.column("role").to_pylist(), flat)]
            found = pa.array([a for _, a in flat], pa.list_(pa.struct([("type", pa.string()), ("uri", pa.string()), ("tokens", pa.int32())])))
            tokens = pa.array([sum(x["tokens"] for x in a) for _, a in flat], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "turn", "role")), pa.array(texts), found, tokens], names=["conv_id", "turn", "role", "formatted", "attachments", "expanded_tokens"])

    picked = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.col("parts").cast(f"array<{PART}>").alias("parts"))
    return picked.mapInArrow(run, TURNS)


def text_turns(conversations: DataFrame) -> DataFrame:
    """Plain rows (conv_id, turn, role, text) as turns of one text part; a null text is an empty one."""
    none = {n: F.lit(None).cast(t).alias(n) for n, t in (("uri", "string"), ("width", "int"), ("height", "int"), ("duration_ms", "int"), ("pages", "int"))}
    part = F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"), *none.values())
    return conversations.select("conv_id", "turn", "role", F.array(part).alias("parts"))


def conversations_text(formatted: DataFrame, max_chars: int = 1 << 28) -> DataFrame:
    """(conv_id, part, formatted, attachments, expanded_tokens) in turn order.

    A conversation that doesn't fit a row comes in several, part 0 and on, each of whole
    turns that begin within the same ``max_chars``; attachments are listed with the part.
    """
    before = Window.partitionBy("conv_id").orderBy("turn", "formatted").rowsBetween(Window.unboundedPreceding, -1)
    cut_up = formatted.withColumn("part", F.floor(F.coalesce(F.sum(F.length("formatted")).over(before), F.lit(0)) / max_chars))
    ordered = F.array_sort(F.collect_list(F.struct("turn", "formatted", "attachments", "expanded_tokens")))
    rows = cut_up.groupBy("conv_id", "part").agg(ordered.alias("t"))
    tokens = F.aggregate("t", F.lit(0).cast("bigint"), lambda a, x: a + x["expanded_tokens"])
    return rows.select("conv_id", "part", F.array_join("t.formatted", "").alias("formatted"), F.flatten("t.attachments").alias("attachments"), tokens.alias("expanded_tokens"))


class Digest:
    """What is read back from one conversation's formatted turns, one after another."""

    def __init__(self):
        self.turns = self.loss_chars = self.chars = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, loss_role: str) -> None:
        self.chars += len(formatted)
        for role, flat in read_back(formatted):
            text = unescape(flat)
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
            if role == loss_role:
                self.loss_chars += len(text)
                self.loss.update(text.encode())

    def row(self, conv_id: int | None) -> tuple:
        return conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


COLUMNS = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def digests(formatted: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """A row for each conversation, read back from its formatted turns.

    A conversation is streamed in turn order through running digests, so one of any
    length needs no more memory than a turn. Turns that share a number are ordered by
    their formatted text; null conv_ids are one conversation; null turns come first. An
    empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current, rows = None, None, []
        for batch in batches:
            for conv, text in zip(batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist()):
                if held is None or conv != current:
                    if held is not None:
                        rows.append(held.row(current))
                    held, current = Digest(), conv
                held.add(text, loss_role)
            if len(rows) >= 10_000:
                yield _rows(rows)
                rows = []
        if held is not None:
            rows.append(held.row(current))
        yield _rows(rows)

    ordered = formatted.select("conv_id", "turn", "formatted").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return ordered.select("conv_id", "formatted").mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    columns = list(zip(*rows)) if rows else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=COLUMNS)


def as_json(formatted: str, attachments: list[dict]) -> str:
    """A line of a training file."""
    return json.dumps({"text": formatted, "attachments": attachments}, ensure_ascii=False)
