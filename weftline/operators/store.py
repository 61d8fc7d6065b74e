"""Chunks and vectors in tables versioned by content hash.

Every write has a version id of its own. Data goes in first under that id; the row in
the hash table that names it is written last and is what makes it visible: of several
rows of a source and digest the latest counts, and one without a version is a deletion.
So a write that breaks off leaves nothing visible, an override replaces all rows at once,
and a deletion is one small append. ``vacuum`` removes the files that no row names.
"""

from __future__ import annotations

import re
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from weftline.operators.postings import Postings

HASHES = "datasource_id string, hash_algorithm string, hash string, hashed_at timestamp, version string"
CHUNKS = "chunk_id bigint, datasource_id string, full_type string, chunk_type string, embeddable_text string, display_text string, keyword_index_text string, hash string, version string"
VECTORS = "chunk_id bigint, datasource_id string, hash string, version string, vec array<float>"
MODELS = "embedder string, model_id string, dim int, table_name string, said_at timestamp, version string"
SHARD_NAME = re.compile(r"embedding_[a-z0-9_]+")


def shard_name(embedder: str, model: str) -> str:
    """Folder of a model's vectors."""
    name = "embedding_" + re.sub(r"[^a-z0-9]+", "_", f"{embedder}_{model}".lower()).strip("_")
    if not SHARD_NAME.fullmatch(name):
        raise ValueError(f"no table name for {embedder} {model}")
    return name


def content_hash(text) -> F.Column:
    return F.sha2(text.cast("binary"), 256)


def current(rows: DataFrame, allowed: DataFrame) -> DataFrame:
    """Rows of the current versions only. allowed: (datasource_id, hash), duplicates in it don't matter."""
    return rows.join(allowed.select("datasource_id", "hash").distinct(), ["datasource_id", "hash"], "left_semi")


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


class ModelRegistry:
    """Embedding models by embedder and id, with their dimension and vector table; every change is a row, the latest counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @property
    def models(self) -> DataFrame:
        """(embedder, model_id, dim, table_name) of the models that are there."""
        rows = read_or_empty(self.spark, self.path, MODELS)
        last = rows.groupBy("embedder", "model_id").agg(F.max(F.struct("said_at", "version", "dim", "table_name")).alias("last"))
        return last.where("last.dim is not null").select("embedder", "model_id", "last.dim", "last.table_name")

    def get(self, embedder: str, model_id: str) -> Row | None:
        return self.models.where((F.col("embedder") == embedder) & (F.col("model_id") == model_id)).first()

    def create(self, embedder: str, model_id: str, dim: int, table_name: str | None = None) -> Row:
        """Register a model; one that is there already, or a name that no vector table may have, raises."""
        name = shard_name(embedder, model_id) if table_name is None else table_name
        if not SHARD_NAME.fullmatch(name):
            raise ValueError(f"no name of a vector table: {name!r}")
        if self.get(embedder, model_id) is not None:
            raise ValueError(f"{embedder} {model_id} is registered already")
        self._say(embedder, model_id, dim, name)
        return Row(embedder=embedder, model_id=model_id, dim=dim, table_name=name)

    def ensure(self, embedder: str, model_id: str, dim: int) -> Row:
        """The model as registered, now or before; another dimension raises."""
        found = self.get(embedder, model_id) or self.create(embedder, model_id, dim)
        if found.dim != dim:
            raise ValueError(f"{embedder} {model_id} has {found.dim} components, not {dim}")
        return found

    def delete(self, embedder: str, model_id: str) -> int:
        """Take a model out; how many were there."""
        if self.get(embedder, model_id) is None:
            return 0
        self._say(embedder, model_id, None, None)
        return 1

    def _say(self, embedder: str, model_id: str, dim: int | None, name: str | None) -> None:
        row = (embedder, model_id, dim, name, datetime.now(timezone.utc), uuid.uuid4().hex)
        self.spark.createDataFrame([row], MODELS).coalesce(1).write.mode("append").parquet(self.path)


class ChunkStore:
    """Tables under one folder: ``hashes``, ``chunks``, the keyword index and a vector table for each model."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        return read_or_empty(self.spark, f"{self.root}/{name}", schema)

    @property
    def models(self) -> ModelRegistry:
        return ModelRegistry(self.spark, f"{self.root}/models")

    @property
    def hashes(self) -> DataFrame:
        """A row for each source and digest that is visible."""
        keys = ["datasource_id", "hash_algorithm", "hash"]
        last = self._read("hashes", HASHES).groupBy(*keys).agg(F.max(F.struct("hashed_at", "version")).alias("last"))
        return last.select(*keys, "last.hashed_at", "last.version").where("version is not null")

    def _visible(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.hashes.select("version"), "version", "left_semi").drop("version")

    @property
    def postings(self) -> Postings:
        """The keyword index; its versions are those of the chunks."""
        return Postings(self.spark, f"{self.root}/keywords")

    def keyword_search(self, question: str, limit: int, allowed: DataFrame | None = None) -> DataFrame:
        """(chunk_id, bm25_score) from the stored postings of all visible versions; allowed: (chunk_id) of what may be found."""
        ids = None if allowed is None else allowed.select(F.col("chunk_id").alias("id"))
        return self.postings.search(question, limit, self.hashes.select("version"), ids).withColumnRenamed("id", "chunk_id")

    @property
    def chunks(self) -> DataFrame:
        """Chunks of visible versions."""
        return self._visible(self._read("chunks", CHUNKS))

    def vectors(self, embedder: str, model: str) -> DataFrame:
        """Vectors of visible versions."""
        return self._visible(self._read(shard_name(embedder, model), VECTORS))

    def is_indexed(self, datasource_id: str, algorithm: str, digest: str) -> bool:
        held = self.hashes.where((F.col("datasource_id") == datasource_id) & (F.col("hash_algorithm") == algorithm) & (F.col("hash") == digest))
        return not held.isEmpty()

    def persist(self, chunks: DataFrame, datasource_id: str, algorithm: str, digest: str, vectors: DataFrame | None = None, embedder: str = "", model: str = "", dim: int | None = None, override: bool = False) -> None:
        """Write chunks, their postings, then vectors, then the hash row. A version that is visible raises, or is replaced by ``override``; one that broke off may be written again."""
        if not override and self.is_indexed(datasource_id, algorithm, digest):
            raise ValueError(f"{datasource_id} is already indexed under {digest}")
        version = uuid.uuid4().hex
        named = {"datasource_id": F.lit(datasource_id), "hash": F.lit(digest), "version": F.lit(version)}
        columns = [c.split()[0] for c in CHUNKS.split(", ")]
        chunks.withColumns(named).select(*columns).write.mode("append").partitionBy("version").parquet(f"{self.root}/chunks")
        self.postings.append(chunks, "chunk_id", "keyword_index_text", version)
        if vectors is not None:
            if dim is not None and not vectors.where(F.size("vec") != dim).isEmpty():
                raise ValueError(f"vectors must have {dim} components")
            rows = vectors.select("chunk_id", *[c.alias(k) for k, c in named.items()], "vec")
            rows.write.mode("append").partitionBy("version").parquet(f"{self.root}/{shard_name(embedder, model)}")
        self._say([(datasource_id, algorithm, digest, datetime.now(timezone.utc), version)])

    def _say(self, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, HASHES).coalesce(1).write.mode("append").parquet(f"{self.root}/hashes")

    def delete(self, datasource_id: str, digest: str | None = None) -> None:
        """Take versions of a source, or one of them, out of sight; their files stay until ``vacuum``."""
        gone = self.hashes.where(F.col("datasource_id") == datasource_id)
        if digest is not None:
            gone = gone.where(F.col("hash") == digest)
        now = datetime.now(timezone.utc)
        if rows := [(r.datasource_id, r.hash_algorithm, r.hash, now, None) for r in gone.collect()]:  # one row a version of a source
            self._say(rows)

    def vacuum(self) -> int:
        """Remove the files of versions that aren't visible; how many folders of chunks and vectors went; their postings go with them. No write may run meanwhile, for what it has written isn't visible yet."""
        kept = {r.version for r in self.hashes.select("version").collect()}  # one a source and digest
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        root = path(self.root)
        files = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        own, index = ([f.getPath() for f in files.globStatus(path(root, where)) or []] for where in ("*/version=*", "keywords/*/version=*"))
        gone = [f for f in [*own, *index] if f.getName().removeprefix("version=") not in kept]
        for folder in gone:
            files.delete(folder, True)
        return sum(f in own for f in gone)
