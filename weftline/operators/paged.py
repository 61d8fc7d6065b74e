"""Chunks of paged documents: tables by a table function over their rows, and text by windows under its headings."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from weftline.functions.text import windows

BUDGET = 512
# Where an over-long row is cut, and how that is said.
HARD_LIMIT, CUT_MARK = 6000, "\n…[TRUNCATED]…"
TOKEN = re.compile(r"\w+|[^\w\s]")


def tokens_of(text: str) -> int:
    return len(TOKEN.findall(text))


class Batches:
    """Folds a table's rows into texts within a budget.

    A table that fits is one text, its caption over its printed rows. Otherwise rows are
    gathered under a prefix of caption and column names that each text repeats; a row that
    overflows a batch begins the next one unchecked; a row that doesn't even fit alone is
    cut. No more is held than one text may have.
    """

    def __init__(self, caption: str, headers: list[str], budget: int):
        self.budget = budget
        named = [f"TABLE: {caption.strip()}"] if caption.strip() else []
        self.base = "\n".join([*named, *(["COLUMNS: " + " | ".join(headers)] if headers else [])]) + "\nROWS:\n"
        self.printed = [*([f"TABLE: {caption}"]), "| " + " | ".join(headers) + " |", "|" + "-|" * len(headers)]
        self.whole: list[str] | None = []  # lines so far, while the table may still fit as it is
        self.size, self.fixed = sum(map(tokens_of, self.printed)), tokens_of(self.base)
        self.held: list[str] = []
        self.filled = 0

    def add(self, cells: list[str]):
        line = "- " + " | ".join((c or "").strip() for c in cells)
        if self.whole is not None:
            shown = "| " + " | ".join((c or "").strip() for c in cells) + " |"
            self.size += tokens_of(shown)
            self.printed.append(shown)
            self.whole.append(line)
            if self.size <= self.budget:
                return
            lines, self.whole, self.printed = self.whole, None, []
            for x in lines:
                yield from self._fold(x)
        else:
            yield from self._fold(line)

    def _fold(self, line: str):
        n = tokens_of(line)
        if self.fixed + self.filled + n <= self.budget:
            self.held.append(line)
            self.filled += n
        elif self.held:
            yield self.base + "\n".join(self.held)
            self.held, self.filled = [line], n
        else:
            yield (self.base + line)[:HARD_LIMIT] + CUT_MARK

    def end(self):
        if self.whole is not None:
            yield "\n".join(x for x in self.printed if x.strip())
        elif self.held:
            yield self.base + "\n".join(self.held)


class TableChunks:
    """The table function: a table of rows in, one of chunks out, with the keys that it was dealt by.

    Called with ``TABLE(rows)`` and a budget, where rows have keys of any type and any
    number, then (row_no, caption, headers, cells); it asks Spark itself for the partitions
    and the order.
    """

    FIXED = ("row_no", "caption", "headers", "cells")

    @staticmethod
    def analyze(rows: AnalyzeArgument, budget: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or any(c not in rows.dataType.names for c in TableChunks.FIXED):
            raise Exception(f"the first argument is a table with {', '.join(TableChunks.FIXED)}")
        keys = [f for f in rows.dataType.fields if f.name not in TableChunks.FIXED]
        made = [T.StructField("chunk_index", T.IntegerType()), T.StructField("embeddable_text", T.StringType())]
        return AnalyzeResult(
            schema=T.StructType([*keys, *made]),
            withSinglePartition=not keys,
            partitionBy=[PartitioningColumn(f.name) for f in keys],
            orderBy=[OrderingColumn("row_no")],
        )

    def __init__(self):
        self.batches, self.keys, self.made = None, (), 0

    def _out(self, texts):
        for text in texts:
            yield (*self.keys, self.made, text)
            self.made += 1

    def eval(self, row, budget):
        if self.batches is None:
            self.keys = tuple(row[c] for c in row.__fields__ if c not in TableChunks.FIXED)
            self.batches = Batches(row["caption"] or "", [str(h) for h in row["headers"] or []], budget)
        yield from self._out(self.batches.add(["" if c is None else str(c) for c in row["cells"] or []]))

    def terminate(self):
        if self.batches is not None:
            yield from self._out(self.batches.end())


def table_chunks(rows: DataFrame, keys: list[str], budget: int = BUDGET) -> DataFrame:
    """(keys, chunk_index, embeddable_text) of tables given as (keys, row_no, caption, headers, cells).

    A table is folded in the order of its rows, so it is one partition; what is held of it
    at a time is one chunk.
    """
    return F.udtf(TableChunks)(rows.select(*keys, *TableChunks.FIXED).asTable(), F.lit(budget))


def text_chunks(items: DataFrame, keys: list[str], budget: int = BUDGET, overlap: int = 64) -> DataFrame:
    """(keys, chunk_index, embeddable_text) of text items (keys, heading, body).

    An item within the budget, in white-space words, is one chunk, its heading over it;
    a longer body goes into windows, each under the heading. Items without a body give none.
    """
    body = F.trim(F.regexp_replace(F.coalesce("body", F.lit("")), r"\s+", " "))
    heading = F.trim(F.coalesce("heading", F.lit("")))
    under = lambda text: F.when(F.col("_heading") == "", text).otherwise(F.concat("_heading", F.lit("\n"), text))
    held = items.select(*keys, heading.alias("_heading"), F.split(body, " ").alias("_words"), body.alias("_body")).where("_body <> ''")
    whole = F.size(F.split(under(F.col("_body")), r"\s+")) <= budget
    cut = F.when(whole, F.array(F.struct(F.lit(0).alias("start"), F.col("_words").alias("window")))).otherwise(windows(F.col("_words"), budget, overlap))
    parts = held.select(*keys, "_heading", F.posexplode(cut).alias("chunk_index", "part"))
    return parts.select(*keys, "chunk_index", under(F.array_join("part.window", " ")).alias("embeddable_text"))


def chunks(items: DataFrame, rows: DataFrame, keys: list[str], budget: int = BUDGET) -> DataFrame:
    """Text and table chunks of the same documents, told apart by ``kind``."""
    return text_chunks(items, keys, budget).withColumn("kind", F.lit("text")).unionByName(table_chunks(rows, keys, budget).withColumn("kind", F.lit("table")))


def register(spark: SparkSession) -> None:
    """Make the table function known to SQL as ``table_chunks``."""
    spark.udtf.register("table_chunks", F.udtf(TableChunks))
