"""Language identification by Bayesian fusion of four kinds of evidence.

log P(language | row) = log P(text | language) + log P(declared markup language | language)
+ log P(address suffix | language) + log P(language | host), the last from counts
grouped by host and smoothed towards the host's site and then all rows. Text likelihoods
come from byte trigrams of the whole text; the other tables from grouped counts over all
rows, in which the text alone says a row's language. Those tables are joined to the rows,
so there may be any number of values, hosts and sites.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm._common import blocks, cut, small_batches, utf8

LABELLED = 1_500  # texts of each declared language that training takes at most
CELLS = 1 << 16  # trigram cells at most; a language code has two or three letters, so there are at most 18,252 languages,
TABLE = 1 << 24  # and cells times languages stay within this: 64 MB
BLOCK_BYTES = 1 << 20  # its trigrams take some 40 times as much while they are scored
STRENGTH = 20.0  # pseudo-counts that a host takes over from its site, and a site from all rows
MATTER = 200  # trigrams beyond which a text's evidence no longer grows: neighbouring ones aren't independent
LEAST = 0.6
UNSURE = 1.0  # pseudo-counts by which a value's share in a language is drawn to its share in all


def trigram_cells(raw: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """A table cell for the three bytes from each place on; two fewer than bytes. cells: a power of two."""
    x = raw.astype(np.uint32)
    mixed = ((x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]) * np.uint32(2654435761)
    return mixed >> np.uint32(32 - (cells.bit_length() - 1))


def cells_for(languages: int) -> int:
    """Cells of the table for so many languages: CELLS, or the power of two that keeps it within TABLE."""
    return min(CELLS, 1 << max(1, (TABLE // max(1, languages)).bit_length() - 1))


def cleaned(text: str) -> bytes:
    """Lower-cased, with all but letters as single blanks, in UTF-8, with a blank at either end; empty without letters."""
    words = re.sub(r"[\W\d_]+", " ", text.lower()).strip()
    return f" {words} ".encode() if words else b""


class TextModel:
    """Log probabilities of trigram cells by language."""

    def __init__(self, languages: list[str], log: np.ndarray):
        self.languages, self.log = languages, log

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Log likelihoods up to a constant, (texts, languages); zeros without letters."""
        out = np.zeros((len(texts), len(self.languages)))
        parts = [cleaned(t or "") for t in texts]
        full = [i for i, p in enumerate(parts) if len(p) > 2]
        if full and self.languages:
            sizes = np.array([len(parts[i]) for i in full])
            values = self.log[trigram_cells(np.frombuffer(b"".join(parts[i] for i in full), np.uint8), len(self.log))]
            # the two trigrams that run over a text's end belong to none
            starts = np.cumsum(sizes) - sizes
            inner = np.ones(len(values), bool)
            for shift in (-2, -1):
                inner[starts[1:] + shift] = False
            values[~inner] = 0
            n = (sizes - 2)[:, None]
            out[full] = np.add.reduceat(values, starts, axis=0) * np.minimum(1, MATTER / n)
        return out


def normal_tag(tag: F.Column) -> F.Column:
    """The first part of a language tag, lower-cased; null if it isn't a code of two or three letters."""
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(tag, F.lit("")), r"^\s*([A-Za-z]{2,3})(?![A-Za-z])", 1)), F.lit(""))


def train(rows: DataFrame, limit: int = LABELLED) -> TextModel:
    """Text model from rows (id, text, declared tags as of ``normal_tag``): at most about ``limit`` texts of each declared language, by a hash of id and text, so rows without an id or with one that repeats are sampled like all others."""
    counts = cut(rows.where("declared is not null").groupBy("declared").agg(F.count("*").alias("n")))
    order = [r.declared for r in counts.orderBy("declared").collect()]  # language codes
    n_cells = cells_for(len(order))
    if not order:
        return TextModel([], np.zeros((n_cells, 0)))
    chance = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.join(F.broadcast(counts), "declared").where(chance < F.lit(limit) / F.col("n")).select("declared", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text", BLOCK_BYTES):
                sums: dict[str, np.ndarray] = {}
                for tag, text in zip(part.column("declared").to_pylist(), utf8(part.column("text")).to_pylist()):
                    raw = cleaned(text or "")
                    if len(raw) > 2:
                        found = np.bincount(trigram_cells(np.frombuffer(raw, np.uint8), n_cells), minlength=n_cells)
                        sums[tag] = sums[tag] + found if tag in sums else found
                for tag, held in sums.items():
                    at = np.flatnonzero(held)
                    yield pa.RecordBatch.from_arrays([pa.array([tag] * len(at)), pa.array(at, pa.int32()), pa.array(held[at])], names=["declared", "cell", "n"])

    # TABLE counts at most
    cells = chosen.mapInArrow(run, "declared string, cell int, n bigint").groupBy("declared", "cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.full((n_cells, len(order)), 0.1)
    if cells.num_rows:
        index = {t: i for i, t in enumerate(order)}
        table[cells.column("cell").to_numpy(), [index[t] for t in cells.column("declared").to_pylist()]] += cells.column("n").to_numpy()
    return TextModel(order, np.log(table / table.sum(axis=0)).astype(np.float32))


def counted(guessed: DataFrame, *columns: str) -> DataFrame:
    """(columns, counts): of each value the rows of each guessed language, as a list of at most one entry a language."""
    per = guessed.where(" and ".join(f"{c} is not null" for c in columns[:1])).groupBy(*columns, "guess").agg(F.count("*").alias("n"))
    return per.groupBy(*columns).agg(F.collect_list(F.struct("guess", "n")).alias("counts"))


def totals(guessed: DataFrame, n: int, column: str | None = None) -> np.ndarray:
    """Rows of each guessed language, of those where the column isn't null."""
    out = np.zeros(n)
    for r in (guessed if column is None else guessed.where(F.col(column).isNotNull())).groupBy("guess").count().collect():
        out[r.guess] = r["count"]
    return out


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Lists of (language, n) as rows of counts; a null list is one of zeros."""
    out, sizes = np.zeros((len(lists), width)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    flat = lists.flatten()
    out[np.repeat(np.arange(len(lists)), sizes), flat.field("guess").to_numpy()] = flat.field("n").to_numpy()
    return out


def smoothed(n: np.ndarray, above: np.ndarray, strength: float) -> np.ndarray:
    """Shares from counts, drawn to the level above by that many pseudo-counts; without counts those of the level above."""
    return (n + strength * above) / (n.sum(axis=1, keepdims=True) + strength)


def log_evidence(n: np.ndarray, of: np.ndarray) -> np.ndarray:
    """log P(value | language) from a value's counts and those of all values; 0 for a value without counts, which says nothing."""
    share = n.sum(axis=1, keepdims=True) / max(1.0, of.sum())
    return np.where(share > 0, np.log((n + UNSURE * np.where(share > 0, share, 1)) / (of + UNSURE)), 0.0)


def identify(rows: DataFrame, least: float = LEAST, strength: float = STRENGTH, limit: int = LABELLED) -> DataFrame:
    """One row per row of (id, text, declared, suffix, host, site): (id, language, posterior, declared, kept).

    declared is a markup language tag, suffix the address's last label, host and site
    the two levels of the prior; each may be null and then says nothing. language is
    ``und`` without letters or without any declared language to learn from; of equally
    likely languages the first in alphabetical order is given. kept says that a language
    was found with a posterior of at least ``least``. An id may have any type that can be
    hashed, such as a struct; bytes that aren't UTF-8 count as no letters. Repeated rows each give a row;
    other columns are ignored; an empty table gives an empty result.
    """
    spark = rows.sparkSession
    rows = small_batches(rows).withColumn("declared", normal_tag(F.col("declared")))
    model = train(rows, limit)
    shared = spark.sparkContext.broadcast(model)
    languages = model.languages
    n = len(languages)

    def read_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            for part in blocks(batch, "text", BLOCK_BYTES):
                scores = held.scores(utf8(part.column("text")).to_pylist())
                some = (scores != 0).any(axis=1)
                best = pa.array(scores.argmax(axis=1) if n else np.zeros(len(scores), np.int64), pa.int32(), mask=~some)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(scores) + 1) * n, pa.int32()), pa.array(scores.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in ("id", "declared", "suffix", "host", "site")] + [flat, best], names=["id", "declared", "suffix", "host", "site", "scores", "guess"])

    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, declared string, suffix string, host string, site string, scores array<double>, guess int"
    scored = cut(rows.select("id", "declared", "suffix", "host", "site", "text").mapInArrow(read_text, schema))
    if not n:
        return scored.select("id", F.lit("und").alias("language"), F.lit(0.0).alias("posterior"), "declared", F.lit(False).alias("kept"))

    guessed = scored.where("guess is not null")
    # written first, so that Spark knows their sizes when it plans the joins
    of_tag, of_suffix, of_site = (cut(counted(guessed, c).withColumnRenamed("counts", f"of_{c}")) for c in ("declared", "suffix", "site"))
    of_host = cut(counted(guessed, "host", "site").withColumnRenamed("counts", "of_host").join(of_site, "site", "left"))
    base = (totals(guessed, n) + 1) / (totals(guessed, n).sum() + n)
    tags, suffixes = totals(guessed, n, "declared"), totals(guessed, n, "suffix")

    there = of_host.select(F.col("host").alias("prior_host"), F.col("site").alias("prior_site"), "of_host", "of_site")
    joined = scored.join(of_tag, "declared", "left").join(of_suffix, "suffix", "left").join(there, (F.col("host") == F.col("prior_host")) & F.col("site").eqNullSafe(F.col("prior_site")), "left")

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([*languages, "und"])
        for batch in batches:
            if not batch.num_rows:
                continue
            held = {c: matrix(batch.column(f"of_{c}"), n) for c in ("declared", "suffix", "site", "host")}
            prior = smoothed(held["host"], smoothed(held["site"], base, strength), strength)
            logs = batch.column("scores").flatten().to_numpy().reshape(-1, n) + np.log(prior) + log_evidence(held["declared"], tags) + log_evidence(held["suffix"], suffixes)
            known = pc.is_valid(batch.column("guess")).to_numpy(zero_copy_only=False)
            posterior = np.where(known, 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1), 0.0)
            language = names.take(pa.array(np.where(known, logs.argmax(axis=1), n)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), language, pa.array(posterior), batch.column("declared"), pa.array(known & (posterior >= least))], names=["id", "language", "posterior", "declared", "kept"])

    needed = joined.select("id", "declared", "guess", "scores", "of_declared", "of_suffix", "of_site", "of_host")
    return needed.mapInArrow(fuse, f"id {kind}, language string, posterior double, declared string, kept boolean")


def host_levels(host: F.Column) -> dict[str, F.Column]:
    """suffix: the host's last label; site: its last two labels; both null where the name has a single label."""
    dotted = F.contains(host, F.lit("."))
    return {"suffix": F.when(dotted, F.substring_index(host, ".", -1)), "host": host, "site": F.when(dotted, F.substring_index(host, ".", -2))}


def of_documents(docs: DataFrame, key: F.Column | None = None) -> DataFrame:
    """Documents as rows to identify, by doc_id or another key: the lang column is what is declared, the source is the host; a source without dots has no suffix and no site."""
    host = F.nullif(F.lower(F.trim("source")), F.lit(""))
    return docs.select((F.col("doc_id").cast("bigint") if key is None else key).alias("id"), "text", F.col("lang").alias("declared"), *(c.alias(k) for k, c in host_levels(host).items()))


def of_pages(pages: DataFrame) -> DataFrame:
    """Web pages as rows to identify: markup's lang attribute, the host with its last label and its last two, and the text outside tags."""
    html = F.coalesce("html", F.lit(""))
    host = F.nullif(F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"://([^/?#:]*)", 1)), F.lit(""))
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    declared = F.regexp_extract(html, r"(?i)<html[^>]*\blang\s*=\s*[\"']?([A-Za-z-]+)", 1)
    return pages.select(F.col("page_id").cast("bigint").alias("id"), text.alias("text"), declared.alias("declared"), *(c.alias(k) for k, c in host_levels(host).items()))
