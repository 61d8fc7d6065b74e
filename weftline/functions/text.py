"""Column functions over text: tokens, windows, truncation, patterns, small parsers."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column
from pyspark.sql import functions as F

SAMPLE_CHARS = 256
WINDOW, OVERLAP = 300, 50


def tokens(text: Column) -> Column:
    """Lower-cased runs of a-z; empty array for null."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z]+"), "")


def words(text: Column) -> Column:
    """Parts between runs of Unicode white space, empty ones at the edges included."""
    return F.split(text, r"(?U)\s+", -1)


def windows(items: Column, size: int, overlap: int) -> Column:
    """Array of (start, window) over an array: each window begins ``size - overlap`` after the last, until one reaches the end.

    A size or overlap of 0 falls back to the default; an overlap that isn't smaller than the size raises.
    """
    size, overlap = size or WINDOW, overlap or OVERLAP
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the window")
    step, n = size - overlap, F.size(items)
    count = F.when(n <= size, 1).otherwise(F.ceil((n - size) / F.lit(step)) + 1).cast("int")
    starts = F.transform(F.sequence(F.lit(0), count - 1), lambda i: i * step)
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice(items, s + 1, size).alias("window")))


def truncated(value: Column, limit: int = SAMPLE_CHARS) -> Column:
    """At most ``limit`` characters, with a note of the full length where some are cut."""
    note = F.concat(F.lit(f"…[truncated, {limit}/"), F.length(value).cast("string"), F.lit("]"))
    return F.when(F.length(value) > limit, F.concat(F.substring(value, 1, limit), note)).otherwise(value)


def joined_with_last(parts: Column, last: str, sep: str = ", ") -> Column:
    """Parts joined by ``sep``, the last one by ``last``."""
    n = F.size(parts)
    many = F.concat(F.array_join(F.slice(parts, 1, n - 1), sep), F.lit(last), F.element_at(parts, -1))
    return F.when(n == 0, "").when(n == 1, F.element_at(parts, 1)).otherwise(many)


def glob_pattern(glob: str) -> str:
    """A Java pattern for a shell glob."""
    return "^" + fnmatch.translate(glob).replace(r"\Z", "$").replace(r"\z", "$")


def glob_match(value: Column, glob: str, case_sensitive: bool = False) -> Column:
    if case_sensitive:
        return value.rlike(glob_pattern(glob))
    return F.lower(value).rlike(glob_pattern(glob.lower()))


def coerced_bool(value: Column) -> Column:
    """yes/true/1 and no/false/0 in any case; other non-empty text is true; null stays null."""
    text = F.lower(F.trim(value.cast("string")))
    return F.when(text.isin("yes", "1", "true"), True).when(text.isin("no", "0", "false", ""), False).when(text.isNotNull(), True)


def ref_target(text: Column) -> Column:
    """The name inside ref('...'), null for anything else."""
    return F.nullif(F.regexp_extract(text, r"""^ref\(['"]([\w.]+)['"]\)$""", 1), F.lit(""))


def array_literal(text: Column) -> Column:
    """Items of an unquoted {a,b} literal; null for null, empty for {}."""
    inner = F.regexp_replace(text, r"^\{|\}$", "")
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, ","))


def sample_value(value: Column, kind: str) -> Column:
    """A value of any type as sample text: bytes by their number, nested values as JSON, all truncated."""
    if kind == "binary":
        return F.concat(F.lit("<bytes, "), F.octet_length(value).cast("string"), F.lit(" bytes>"))
    if kind.startswith(("array", "struct", "map")):
        return truncated(F.to_json(value))
    return truncated(value.cast("string"))
