"""Catalog metadata: from component rows to a typed model of tables, with scopes and checks."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import coerced_bool, glob_match

# What kinds of data sets there are; anything else is a table.
KINDS = ("table", "view", "materialized_view", "external_table", "snapshot", "clone")


def dataset_kind(kind: Column) -> Column:
    return F.when(F.lower(kind).isin(*KINDS), F.lower(kind)).otherwise("table")


@dataclass
class Rule:
    """A scope rule; what is left out matches everything. Names are globs, without regard to case."""

    catalog: str | None = None
    schemas: list[str] | None = None
    tables: list[str] | None = None
    except_schemas: list[str] | None = None
    except_tables: list[str] | None = None

    def __post_init__(self):
        for name in ("schemas", "tables", "except_schemas", "except_tables"):
            if isinstance(getattr(self, name), str):
                setattr(self, name, [getattr(self, name)])
        if self.catalog is None and self.schemas is None and self.tables is None:
            raise ValueError("a rule needs a catalog, schemas or tables")

    def matches(self, catalog: Column, schema: Column, table: Column | None = None) -> Column:
        out = F.lit(True)
        if self.catalog is not None:
            out &= glob_match(catalog, self.catalog)
        if self.schemas is not None:
            out &= any_glob(schema, self.schemas)
        if self.tables is not None and table is not None:
            out &= any_glob(table, self.tables)
        if self.except_schemas is not None:
            out &= ~any_glob(schema, self.except_schemas)
        if self.except_tables is not None and table is not None:
            out &= ~any_glob(table, self.except_tables)
        return out


@dataclass
class Scope:
    """What to keep: without include rules all is included; an exclude rule wins."""

    include: list[Rule] = field(default_factory=list)
    exclude: list[Rule] = field(default_factory=list)
    ignored_schemas: tuple[str, ...] = ()
    enabled: bool = True

    def keeps(self, catalog: Column, schema: Column, table: Column | None = None) -> Column:
        any_of = lambda rules: reduce(lambda a, b: a | b, [r.matches(catalog, schema, table) for r in rules])
        out = F.lit(self.enabled)
        if self.ignored_schemas:
            out &= ~F.lower(schema).isin(*[s.lower() for s in self.ignored_schemas])
        if self.include:
            out &= any_of(self.include)
        if self.exclude:
            out &= ~any_of(self.exclude)
        return out


def any_glob(value: Column, globs: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [glob_match(value, g) for g in globs], F.lit(False))


def resource_matches(rules: list[str | dict], fields: dict[str, Column]) -> Column:
    """Whether a resource fits any rule, with regard to case: a glob on unique_id, or globs by field that must all fit. A missing field never fits."""
    fits = []
    for rule in rules:
        wanted = {"unique_id": rule} if isinstance(rule, str) else rule
        fits.append(reduce(lambda a, b: a & b, [F.coalesce(glob_match(fields[k], v, case_sensitive=True), F.lit(False)) for k, v in wanted.items()]))
    return reduce(lambda a, b: a | b, fits, F.lit(False))


def in_position(*columns: str) -> Column:
    """A group's rows as structs of the columns, by position, rows without one last."""
    order = F.array_sort(F.collect_list(F.struct(F.coalesce(F.col("position"), F.lit(2147483647)).alias("position"), *[F.col(c) for c in columns])))
    return F.transform(order, lambda x: F.struct(*[x[c].alias(c) for c in columns])) if len(columns) > 1 else F.transform(order, lambda x: x[columns[0]])


def assembled_keys(rows: DataFrame) -> DataFrame:
    """(schema_name, table_name, constraint_name, columns, validated) of primary or unique keys."""
    return rows.groupBy("schema_name", "table_name", "constraint_name").agg(in_position("column_name").alias("columns"), F.first("validated", ignorenulls=True).alias("validated"))


def assembled_foreign_keys(rows: DataFrame) -> DataFrame:
    """Foreign keys with their column mapping in order; referenced_table is schema.table, empty where either is missing; enforced and validated unless said otherwise."""
    target = F.when(F.col("ref_schema").isNotNull() & F.col("ref_table").isNotNull(), F.concat_ws(".", "ref_schema", "ref_table")).otherwise("")
    keyed = rows.withColumn("target", target)
    mapping = in_position("from_column", "to_column")
    first = lambda c: F.min_by(c, F.coalesce("position", F.lit(2147483647)))
    return keyed.groupBy("schema_name", "table_name", "constraint_name").agg(
        mapping.alias("mapping"), first("target").alias("referenced_table"), first("on_update").alias("on_update"), first("on_delete").alias("on_delete"),
        *(F.coalesce(first(c) if c in rows.columns else F.lit(None).cast("boolean"), F.lit(True)).alias(c) for c in ("enforced", "validated")),
    )


def assembled_indexes(rows: DataFrame) -> DataFrame:
    """Indexes with their expressions in order; unique unless said is false."""
    return rows.groupBy("schema_name", "table_name", "index_name").agg(
        in_position("expr").alias("columns"), F.coalesce(F.first(coerced_bool(F.col("is_unique")), ignorenulls=True), F.lit(False)).alias("unique"), F.first("method", ignorenulls=True).alias("method"),
        (F.first("predicate", ignorenulls=True) if "predicate" in rows.columns else F.lit(None).cast("string")).alias("predicate"),
    )


def assembled_columns(rows: DataFrame) -> DataFrame:
    """(schema_name, table_name, columns): structs of name, type, nullable, generated, description by ordinal; nullable unless said otherwise."""
    shaped = rows.select(
        "schema_name",
        "table_name",
        F.col("ordinal_position").alias("position"),
        F.col("column_name").alias("name"),
        F.col("data_type").alias("type"),
        F.coalesce(coerced_bool(F.col("is_nullable")), F.lit(True)).alias("nullable"),
        F.col("generated").alias("generated"),
        F.col("description").alias("description"),
        (F.col("default_expression") if "default_expression" in rows.columns else F.lit(None).cast("string")).alias("default_expression"),
    )
    return shaped.groupBy("schema_name", "table_name").agg(in_position("name", "type", "nullable", "generated", "description", "default_expression").alias("columns"))


def assembled_partitions(rows: DataFrame) -> DataFrame:
    """(schema_name, table_name, partition_info): how a table is partitioned, by which columns, into which tables by name."""
    parts = rows.groupBy("schema_name", "table_name").agg(
        F.first("partitioning_strategy", ignorenulls=True).alias("strategy"),
        F.array_sort(F.collect_set(F.when(F.col("column_name").isNotNull(), F.struct(F.coalesce("position", F.lit(2147483647)).alias("position"), "column_name")))).alias("by"),
        F.array_sort(F.collect_set("partition_table")).alias("partition_tables"),
    )
    return parts.select("schema_name", "table_name", F.struct("strategy", F.transform("by", lambda x: x["column_name"]).alias("columns"), "partition_tables").alias("partition_info"))


def assembled_tables(
    relations: DataFrame, columns: DataFrame, primary_keys: DataFrame, foreign_keys: DataFrame, unique_keys: DataFrame | None = None, checks: DataFrame | None = None, indexes: DataFrame | None = None,
    partitions: DataFrame | None = None,
) -> DataFrame:
    """The model: a row a table, also for one that only a component knows; rows without a schema are dropped, and so are partitions, which their parent names."""
    key = ["schema_name", "table_name"]
    keys = assembled_keys(primary_keys).groupBy(*key).agg(F.min_by("columns", "constraint_name").alias("primary_key"))
    foreign = assembled_foreign_keys(foreign_keys).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("constraint_name", "mapping", "referenced_table"))).alias("foreign_keys"))
    kinds = relations.select(*key, dataset_kind(F.col("kind")).alias("kind"), "description")
    parts = [kinds, assembled_columns(columns), keys, foreign]
    if unique_keys is not None:
        parts.append(assembled_keys(unique_keys).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("constraint_name", "columns"))).alias("unique_keys")))
    if checks is not None:
        parts.append(checks.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("constraint_name", "expression"))).alias("checks")))
    if indexes is not None:
        parts.append(assembled_indexes(indexes).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("index_name", "columns", "unique", "method", "predicate"))).alias("indexes")))
    if partitions is not None:
        parts.append(assembled_partitions(partitions))
    whole = reduce(lambda a, b: a.join(b, key, "full_outer"), parts)
    filled = whole.withColumns({"kind": F.coalesce("kind", F.lit("table")), "columns": F.coalesce("columns", F.array())})
    if partitions is not None:
        children = partitions.where("partition_table is not null").select("schema_name", F.col("partition_table").alias("table_name")).distinct()
        filled = filled.join(children, key, "left_anti")
    return filled.where(F.coalesce("schema_name", F.lit("")) != "").withColumnRenamed("table_name", "name")


def session_columns(spark: SparkSession, database: str) -> DataFrame:
    """Column rows of the tables that a Spark database holds."""
    rows = [
        (database, t.name, i, c.name, c.dataType, str(c.nullable).lower(), None, c.description)
        for t in spark.catalog.listTables(database)
        for i, c in enumerate(spark.catalog.listColumns(t.name, database))
    ]
    return spark.createDataFrame(rows, "schema_name string, table_name string, ordinal_position int, column_name string, data_type string, is_nullable string, generated string, description string")


def schema_columns(df: DataFrame, schema: str, table: str) -> DataFrame:
    """Column rows from a DataFrame's own schema."""
    rows = [(schema, table, i, f.name.lower(), f.dataType.simpleString(), str(f.nullable).lower(), None, None) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "schema_name string, table_name string, ordinal_position int, column_name string, data_type string, is_nullable string, generated string, description string")


def orphans(child: DataFrame, child_col: str, parent: DataFrame, parent_col: str) -> DataFrame:
    """Child rows whose non-null key has no parent."""
    return child.where(F.col(child_col).isNotNull()).join(parent.select(F.col(parent_col).alias("_p")), F.col(child_col) == F.col("_p"), "left_anti")


def duplicated_keys(df: DataFrame, *columns: str) -> DataFrame:
    """Keys that stand in more than one row, with their number."""
    return df.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")


def browse(tables: DataFrame) -> DataFrame:
    """(schema_name, tables): name and description of each table, by name."""
    return tables.groupBy("schema_name").agg(F.array_sort(F.collect_list(F.struct("name", "description"))).alias("tables"))
