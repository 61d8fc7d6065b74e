"""Text, performance logs, dbt artifacts and PDF files as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import ref_target
from weftline.operators.perf import RECORD

NODE = (
    "struct<unique_id:string,resource_type:string,name:string,database:string,schema:string,description:string,config:struct<materialized:string,severity:string>,"
    "columns:map<string,struct<name:string,data_type:string,description:string>>,depends_on:struct<nodes:array<string>>,attached_node:string,column_name:string,"
    "test_metadata:struct<name:string,kwargs:map<string,string>>>"
)
MANIFEST = f"nodes map<string,{NODE}>, semantic_models map<string,struct<unique_id:string,name:string,model:string,description:string>>, metrics map<string,struct<unique_id:string,name:string,type:string,description:string,depends_on:struct<nodes:array<string>>>>"
CATALOG = "nodes map<string,struct<metadata:struct<type:string,schema:string,name:string,database:string>,columns:map<string,struct<type:string,index:int,name:string,comment:string>>>>"
# Materializations that are known.
MATERIALIZATIONS = ("table", "view", "incremental", "ephemeral", "materialized_view")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole UTF-8 files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def perf_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON lines; blank, invalid and non-object lines are skipped."""
    parsed = spark.read.text(path).where(F.trim("value").startswith("{")).select(F.from_json("value", RECORD + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    return parsed.where("r is not null and r._corrupt is null").select("r.*").drop("_corrupt")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("multiLine", "true").json(path)


def catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CATALOG).option("multiLine", "true").json(path)


def materialization(value: Column) -> Column:
    return F.when(value.isin(*MATERIALIZATIONS), value)


def dbt_models(artifact: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """A row a model with its columns; the catalog's column types win over the manifest's."""
    nodes = artifact.select(F.explode("nodes").alias("key", "n")).where("n.resource_type = 'model'").select("n.*")
    out = nodes.select(
        F.col("unique_id").alias("id"), "name", "database", "schema", "description", materialization(F.col("config.materialized")).alias("materialization"),
        F.coalesce(F.col("depends_on.nodes"), F.array().cast("array<string>")).alias("depends_on_nodes"), F.map_values("columns").alias("columns"),
    )
    if types is None:
        return out
    found = types.select(F.explode("nodes").alias("id", "c")).select("id", F.transform_values("c.columns", lambda _, v: v["type"]).alias("known"))
    typed = F.transform("columns", lambda c: F.struct(c["name"].alias("name"), F.coalesce(F.try_element_at("known", c["name"]), c["data_type"]).alias("data_type"), c["description"].alias("description")))
    return out.join(found, "id", "left").withColumn("columns", F.when(F.col("known").isNull(), F.col("columns")).otherwise(typed)).drop("known")


def dbt_constraints(artifact: DataFrame) -> DataFrame:
    """(model_id, column_name, constraints) from tests that name a model and a column; enforced where the severity is ERROR."""
    tests = artifact.select(F.explode("nodes").alias("key", "n")).where("n.resource_type = 'test' and n.attached_node is not null and n.column_name is not null").select("n.*")
    kind = F.col("test_metadata.name")
    kwargs = lambda k: F.try_element_at("test_metadata.kwargs", F.lit(k))
    constraint = F.struct(
        kind.alias("type"),
        (F.coalesce("config.severity", F.lit("")) == "ERROR").alias("is_enforced"),
        F.from_json(kwargs("values"), "array<string>").alias("accepted_values"),
        F.coalesce(ref_target(kwargs("to")), kwargs("to")).alias("target_model"),
        kwargs("field").alias("target_column"),
    )
    known = tests.where(kind.isin("not_null", "unique", "accepted_values", "relationships"))
    return known.groupBy(F.col("attached_node").alias("model_id"), "column_name").agg(F.array_sort(F.collect_list(constraint)).alias("constraints"))


def dbt_metrics(artifact: DataFrame) -> DataFrame:
    """Metrics with the first semantic model they depend on."""
    m = artifact.select(F.explode("metrics").alias("key", "m")).select("m.*")
    first = F.try_element_at(F.filter("depends_on.nodes", lambda n: n.startswith("semantic_model.")), F.lit(1))
    return m.select(F.col("unique_id").alias("id"), "name", "type", "description", first.alias("depends_on_semantic_model"))


def dbt_semantic_models(artifact: DataFrame) -> DataFrame:
    return artifact.select(F.explode("semantic_models").alias("key", "s")).select(F.col("s.unique_id").alias("id"), "s.name", "s.model", "s.description")


def pdf_texts(spark: SparkSession, path: str, convert) -> DataFrame:
    """(path, text) of PDF files by a converter from bytes to text, given by the caller."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"path": frame["path"], "text": [convert(c) for c in frame["content"]]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, text string")
