"""Chunks: windows over free text, and sentences over table metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import OVERLAP, WINDOW, joined_with_last, windows, words

SHOWN_COLUMNS = 50


def word_chunks(docs: DataFrame, id_col: str, text_col: str, size: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """(id, chunk_index, chunk_content): windows of words, the index is the window's first word's offset. Null texts give nothing."""
    # the words are a column first: within the windows they would be split again for each one
    split = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col), words(F.col(text_col)).alias("_words"))
    parts = split.select(id_col, F.explode(windows(F.col("_words"), size, overlap)).alias("w"))
    return parts.select(id_col, F.col("w.start").alias("chunk_index"), F.array_join("w.window", " ").alias("chunk_content"))


def token_chunks(tokens: DataFrame, id_col: str, tokens_col: str, budget: int = 1900, overlap: int = 80) -> DataFrame:
    """(id, start, tokens): windows over token arrays; an array that fits is one window, an empty one too."""
    parts = tokens.select(F.col(id_col), F.explode(windows(F.coalesce(F.col(tokens_col), F.array()), budget, overlap)).alias("w"))
    return parts.select(id_col, F.col("w.start").alias("start"), F.col("w.window").alias("tokens"))


def sentences(*parts: Column) -> Column:
    """Non-empty parts joined as sentences."""
    return F.concat_ws(". ", *[F.nullif(p, F.lit("")) for p in parts])


def table_text(t: dict[str, Column]) -> Column:
    """A table's chunk text. t: name, kind, columns (array of name, type, ...), primary_key, foreign_keys, description."""
    names = F.transform(t["columns"], lambda c: c["name"])
    n, key = F.size(t["columns"]), t["primary_key"]
    key_type = F.element_at(F.filter(t["columns"], lambda c: c["name"] == F.element_at(key, 1)), 1)["type"]
    one = F.concat(F.lit("Its primary key is the column "), F.element_at(key, 1), F.lit(" of type "), key_type)
    many = F.concat(F.lit("Its primary key is composed of the columns ("), F.array_join(key, ", "), F.lit(")"))
    primary = F.when(F.coalesce(F.size(key), F.lit(0)) < 1, None).when(F.size(key) == 1, one).otherwise(many)
    targets = joined_with_last(F.transform(t["foreign_keys"], lambda k: k["referenced_table"]), " and ")
    foreign = (
        F.when(F.coalesce(F.size(t["foreign_keys"]), F.lit(0)) < 1, None)
        .when(F.size(t["foreign_keys"]) == 1, F.concat(F.lit("The column has a foreign key to "), targets))
        .otherwise(F.concat(F.lit("The "), t["kind"], F.lit(" has foreign keys to "), targets))
    )
    first = F.concat(F.lit(f"Here are the first {SHOWN_COLUMNS} columns for the "), t["kind"], F.lit(": "), F.array_join(F.slice(names, 1, SHOWN_COLUMNS), ", "))
    whole = F.concat(F.lit("Here is the full list of columns for the "), t["kind"], F.lit(": "), F.array_join(names, ", "))
    opening = F.concat(t["name"], F.lit(" is a database "), t["kind"], F.lit(" with "), n.cast("string"), F.lit(" columns"))
    return sentences(opening, primary, foreign, F.when(n > SHOWN_COLUMNS, first).otherwise(whole), t["description"])


def column_text(t: dict[str, Column], c: Column) -> Column:
    """A column's chunk text within its table."""
    key = t["primary_key"]
    primary = (
        F.when(F.size(key) == 1, F.when(F.element_at(key, 1) == c["name"], F.concat(F.lit("It is the primary key of the "), t["kind"])))
        .when(F.array_contains(key, c["name"]), F.concat(F.lit("It is part of the primary key of the "), t["kind"]))
    )
    mine = F.filter(F.coalesce(t["foreign_keys"], F.array()), lambda k: F.exists(k["mapping"], lambda m: m["from_column"] == c["name"]))
    single = F.transform(F.filter(mine, lambda k: F.size(k["mapping"]) == 1), lambda k: F.concat(k["referenced_table"], F.lit("."), F.element_at(k["mapping"], 1)["to_column"]))
    composite = F.transform(F.filter(mine, lambda k: F.size(k["mapping"]) > 1), lambda k: k["referenced_table"])
    foreign = sentences(
        F.when(F.size(single) > 0, F.concat(F.lit("This column is a foreign key to "), joined_with_last(single, " and "))),
        F.when(F.size(composite) > 0, F.concat(F.lit("This column is part of a foreign key to "), joined_with_last(composite, " and "))),
    )
    generated = F.when(c["generated"] == "identity", "This column is an identity column").when(F.coalesce(c["generated"], F.lit("")) != "", "This column is a generated column")
    opening = F.concat(c["name"], F.lit(" is a column with type "), c["type"], F.lit(" in the "), t["kind"], F.lit(" "), t["name"])
    nullable = F.concat(F.lit("It can"), F.when(c["nullable"], "").otherwise(" not"), F.lit(" contain null values"))
    return sentences(opening, nullable, primary, foreign, generated, c["description"])


def table_chunks(tables: DataFrame) -> DataFrame:
    """(table_name, chunk_type, position, embeddable_text): a table's chunk (position -1), then its columns' in order."""
    t = {c: F.col(c) for c in ("name", "kind", "columns", "primary_key", "foreign_keys", "description")}
    own = tables.select(F.col("name").alias("table_name"), F.lit("table").alias("chunk_type"), F.lit(-1).alias("position"), table_text(t).alias("embeddable_text"))
    each = tables.select("*", F.posexplode("columns").alias("position", "c"))
    columns = each.select(F.col("name").alias("table_name"), F.lit("column").alias("chunk_type"), "position", column_text(t, F.col("c")).alias("embeddable_text"))
    return own.unionByName(columns)


def table_row_batches(rows: list[str], header: str, budget: int, length=len) -> list[str]:
    """Rows of a printed table in batches under a repeated header, each within the budget where single rows allow it.

    A lone row that doesn't fit is cut at 6000 characters and marked.
    """
    out, held = [], []
    text = lambda rs: header + "\n".join(rs)
    for row in rows:
        if held and length(text([*held, row])) > budget:
            out.append(text(held))
            held = []
        if not held and length(text([row])) > budget:
            row = row[:6000] + "…[TRUNCATED]…" if len(row) > 6000 else row
        held.append(row)
    return [*out, text(held)] if held else out


def model_text(name: Column, database: Column, schema: Column, unique_id: Column) -> Column:
    return F.format_string("Model %s in database %s and schema %s, with unique id %s", name, database, schema, unique_id)


def model_column_text(name: Column, model_id: Column) -> Column:
    return F.format_string("Column %s in model %s", name, model_id)


def semantic_model_text(name: Column, unique_id: Column, model: Column) -> Column:
    return F.format_string("Semantic model %s with id %s, referencing model %s", name, unique_id, model)


def metric_text(name: Column, unique_id: Column, semantic_model: Column) -> Column:
    return F.concat(F.format_string("Metric %s with id %s", name, unique_id), F.coalesce(F.concat(F.lit(", depending on semantic model "), semantic_model), F.lit("")))


def parquet_column_text(name: Column, kind: Column, num_values: Column, file: Column) -> Column:
    return F.format_string("Column [name = %s, type = %s, number of values = %s] in parquet file %s", name, kind, num_values.cast("string"), file)
