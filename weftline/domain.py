"""The facade: sources become contexts, contexts become indexed chunks, chunks answer questions.

A domain is a folder: ``src`` with source configurations and files, ``output`` with one
context file a source, ``index`` with the versioned chunk and vector tables. The heavy
work (profiles, chunks, vectors, search) are Spark jobs; the folder's bookkeeping stays on
the driver.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from pathlib import Path

import pandas as pd
import yaml
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import sample_value
from weftline.operators import catalog, chunking, profiling, search, sketches, store
from weftline.operators.sql import run_sql
from weftline.sources import databases, introspection
from weftline.sources.registry import Registry, built_in

DIM = 64
ALGORITHM = "SHA-256"
OK, SKIPPED, FAILED = "OK", "SKIPPED", "FAILED"
Embedder = Callable[[list[str]], list[list[float]]]


def hashing_embedder(texts: list[str], dim: int = DIM) -> list[list[float]]:
    """A deterministic embedder that needs no model: signed hashed words, scaled to length 1."""
    import xxhash

    out = []
    for text in texts:
        v = [0.0] * dim
        for word in re.findall(r"\w+", text.lower()):
            h = xxhash.xxh3_64_intdigest(word)
            v[h % dim] += 1.0 if h >> 63 else -1.0
        size = sum(x * x for x in v) ** 0.5 or 1.0
        out.append([x / size for x in v])
    return out


def embedded(chunks: DataFrame, embed: Embedder, dim: int, batch: int = 128) -> DataFrame:
    """(chunk_id, vec) in batches of texts; a wrong number or size of vectors raises."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for s in range(0, len(frame), batch):
                part = frame.iloc[s : s + batch]
                vectors = embed(part["embeddable_text"].tolist())
                if len(vectors) != len(part) or any(len(v) != dim for v in vectors):
                    raise ValueError("the embedder gave other vectors than asked for")
                yield pd.DataFrame({"chunk_id": part["chunk_id"].to_numpy(), "vec": vectors})

    return chunks.select("chunk_id", "embeddable_text").mapInPandas(run, "chunk_id bigint, vec array<float>")


RAW, INSTRUCT, REWRITE = "raw", "instruct", "rewrite"
INSTRUCTION = "Represent this question for finding tables and columns of databases by the names it holds"


def query_mode(setting: str | None) -> str:
    """The mode that a setting names, in any case; raw for anything else."""
    mode = (setting or "").strip().lower()
    return mode if mode in (RAW, INSTRUCT, REWRITE) else RAW


def queries(question: str, search_mode: str, mode: str = RAW, entities: Callable[[str], str | None] | None = None) -> tuple[str, str]:
    """(what keywords are taken from, what is embedded) for a question.

    ``entities`` gives lines of named entities; where it fails or finds none, the question
    stays as it is. Rewriting without it raises. Nothing is instructed in keyword search,
    which embeds nothing.
    """
    if mode == REWRITE:
        if entities is None:
            raise ValueError("rewriting asks for a provider of entities")
        try:
            found = entities(question)
        except Exception:
            found = None
        question = f"{question}\n{found}" if found else question
        return question, question
    if mode == INSTRUCT and search_mode != "keyword":
        return question, f"Instruct: {INSTRUCTION}\nQuery:{question}"
    if mode not in (RAW, INSTRUCT):
        raise ValueError(f"unknown query mode {mode!r}")
    return question, question


def plain(value):
    """Nested values without nulls below the top, as YAML can hold them."""
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items() if v is not None}
    if isinstance(value, (list, tuple, set)):
        return [plain(v) for v in value]
    return value if isinstance(value, (str, int, float, bool)) or value is None else str(value)


def rendered(text: str, environment: dict[str, str] | None = None) -> str:
    """Replaces {{ env_var('NAME', 'default') }}; a missing variable without default raises."""
    known = os.environ if environment is None else environment

    def value(m: re.Match) -> str:
        if m[1] in known:
            return known[m[1]]
        if m[2] is None:
            raise KeyError(f"environment variable {m[1]} isn't set")
        return m[2]

    return re.sub(r"\{\{\s*env_var\(\s*['\"](\w+)['\"]\s*(?:,\s*['\"]([^'\"]*)['\"]\s*)?\)\s*\}\}", value, text)


@dataclass
class Result:
    """What became of one source; a failure never stops the others."""

    datasource_id: str
    status: str
    note: str = ""


class Journal:
    """Append-only JSON lines with an id for each entry."""

    def __init__(self, path: Path):
        self.path = path

    def write(self, kind: str, **attributes) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        row = {"event_id": str(uuid.uuid4()), "type": kind, "ts": datetime.now(timezone.utc).isoformat(), **attributes}
        with self.path.open("a") as f:
            f.write(json.dumps(row) + "\n")


class Domain:
    """Build, index and search a folder of sources.

    ``profiling: true`` profiles columns exactly, ``profiling: sampled`` by sketches of a sample at the rate for the table's size.

    A source is a YAML file with ``type: parquet`` (``path`` of a folder with tables),
    ``type: spark`` (``database``), ``type: sqlite`` (``path``), the type of a database that
    JDBC reaches (``host``, ``port``, ``database``, ``options``), or a .txt or .md file. ``kinds``
    holds these and what the caller adds.
    """

    def __init__(self, spark: SparkSession, root: str, embed: Embedder = hashing_embedder, dim: int = DIM, entities: Callable[[str], str | None] | None = None, kinds: Registry | None = None):
        self.kinds = built_in(introspection.DIALECTS) if kinds is None else kinds
        self.spark, self.root, self.embed, self.dim, self.entities = spark, Path(root), embed, dim, entities
        self.store = store.ChunkStore(spark, str(self.root / "index"))
        self.journal = Journal(self.root / "logs" / "events.jsonl")

    @classmethod
    def create(cls, spark: SparkSession, root: str, **kwargs) -> Domain:
        for name in ("src/files", "output", "logs", "index"):
            (Path(root) / name).mkdir(parents=True, exist_ok=True)
        return cls(spark, root, **kwargs)

    def sources(self) -> list[str]:
        """Ids of all sources, without regard to case in their order; backups and files without a suffix are left out."""
        src = self.root / "src"
        found = [str(p.relative_to(src)) for p in src.rglob("*") if p.is_file() and p.suffix and not p.name.endswith("~")]
        return sorted(found, key=str.lower)

    def config(self, source: str) -> dict:
        return yaml.safe_load(rendered((self.root / "src" / source).read_text())) or {}

    def _each(self, sources: list[str] | None, work: Callable[[str], Result]) -> list[Result]:
        out = []
        for source in sources or self.sources():
            try:
                out.append(work(source))
            except Exception as e:
                out.append(Result(source, FAILED, str(e).splitlines()[0]))
            self.journal.write("source", datasource_id=source, status=out[-1].status)
        return out

    def check(self, sources: list[str] | None = None) -> list[Result]:
        """Whether each source can be read."""

        def work(source: str) -> Result:
            if not self._is_config(source):
                return Result(source, "UNKNOWN", "files need no connection")
            tables = self.tables(self.config(source))
            return Result(source, "VALID" if tables else "INVALID", f"{len(tables)} tables")

        return [Result(r.datasource_id, "INVALID", r.note) if r.status == FAILED else r for r in self._each(sources, work)]

    @staticmethod
    def _is_config(source: str) -> bool:
        return source.endswith((".yaml", ".yml"))

    def tables(self, config: dict) -> dict[str, DataFrame]:
        """A source's tables by name; settings that its kind doesn't know, or of another type, raise."""
        kind = self.kinds[config.get("type")]
        settings = kind.typed(config)
        if kind.tables is not None:
            return kind.tables(self.spark, settings)
        if config.get("type") == "parquet":
            paths = sorted(Path(config["path"]).glob("*.parquet"))
            return {p.stem: self.spark.read.parquet(str(p)) for p in paths}
        if config.get("type") == "spark":
            database = config.get("database", "default")
            return {t.name: self.spark.table(f"{database}.{t.name}") for t in self.spark.catalog.listTables(database)}
        if config.get("type") in introspection.DIALECTS:
            return {n: self._read(config, t.schema_name, t.name) for n, t in self.catalog(config).items() if t.columns}
        raise ValueError(f"unknown source type {config.get('type')!r}")

    def _read(self, config: dict, schema: str, name: str) -> DataFrame:
        if config["type"] == "sqlite":
            return databases.read_sqlite(self.spark, config["path"], name)
        return databases.read_table(self.spark, self._connection(config), f"{schema}.{name}")

    @staticmethod
    def _connection(config: dict) -> databases.Connection:
        return databases.Connection(config["type"], **{k: config[k] for k in ("host", "port", "database", "options") if k in config})

    def catalog(self, config: dict) -> dict[str, Row]:
        """What a database's own catalog says of each table; names that stand in several schemas carry theirs."""
        if config.get("type") not in introspection.DIALECTS:
            return {}
        read = introspection.sqlite_reader(self.spark, config["path"]) if config["type"] == "sqlite" else introspection.jdbc_reader(self.spark, self._connection(config))
        rows = catalog.assembled_tables(**introspection.components(self.spark, config["type"], read)).orderBy("schema_name", "name").collect()  # a row a table
        often = Counter(r.name for r in rows)
        return {r.name if often[r.name] == 1 else f"{r.schema_name}_{r.name}": r for r in rows}

    def build(self, sources: list[str] | None = None) -> list[Result]:
        """Introspect each source and write its context file."""

        def work(source: str) -> Result:
            if not self._is_config(source):
                context = {"datasource_id": source, "datasource_type": "file", "text": (self.root / "src" / source).read_text(encoding="utf-8")}
            else:
                config = self.config(source)
                if str(config.get("enabled", True)).lower() in ("false", "no", "0"):
                    return Result(source, SKIPPED, "disabled")
                context = {"datasource_id": source, "datasource_type": config["type"], "tables": self._all_introspected(config)}
            path = self.context_path(source)
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(yaml.safe_dump(plain(context), sort_keys=False, allow_unicode=True))
            return Result(source, OK)

        return self._each(sources, work)

    def _all_introspected(self, config: dict) -> list[dict]:
        tables = self.tables(config)
        known = {n: {k: v for k, v in plain(r).items() if k not in ("schema_name", "name")} for n, r in self.catalog(config).items()}
        out = [self._introspected(n, t, config) | known.pop(n, {}) for n, t in tables.items()]
        return out + [{"name": n, **v} for n, v in known.items()]  # what can't be read, such as broken views

    def _introspected(self, name: str, df: DataFrame, config: dict) -> dict:
        constraints = (config.get("constraints") or {}).get(name, {})
        out = {
            "name": name,
            "kind": "table",
            "description": (config.get("descriptions") or {}).get(name),
            "columns": [{"name": f.name.lower(), "type": f.dataType.simpleString(), "nullable": f.nullable} for f in df.schema.fields],
            "primary_key": constraints.get("primary_key"),
            "foreign_keys": constraints.get("foreign_keys"),
        }
        if config.get("samples", True):
            shown = [sample_value(F.col(f"`{f.name}`"), f.dataType.simpleString()).alias(f.name.lower()) for f in df.schema.fields]
            out["samples"] = [r.asDict() for r in df.limit(5).select(*shown).collect()]
        if config.get("profiling") == "sampled":
            try:
                found = sketches.estimated(sketches.adaptive(df, name)).drop("version").collect()  # a row a column
                out["stats"] = [r.asDict() for r in found]
            except Exception as e:  # a table that can't be profiled leaves the others
                out["stats_error"] = str(e).splitlines()[0]
        elif config.get("profiling"):
            keep = ("column_name", "null_count", "non_null_count", "exact_distinct", "cardinality_bucket", "min_text", "max_text", "min_number", "max_number")
            out["stats"] = [{k: r[k] for k in keep} for r in profiling.profile(df, name).collect()]
        return out

    def enrich(self, describe: Callable[[dict], str], sources: list[str] | None = None) -> list[Result]:
        """Ask ``describe`` for each table and column without a description; what fails stays as it is."""

        def work(source: str) -> Result:
            context = self.context(source)
            for t in context.get("tables", []):
                for node in [*t["columns"], t]:
                    if not node.get("description"):
                        try:
                            node["description"] = describe({"table": t["name"], **node})
                        except Exception:
                            continue
            self.context_path(source).write_text(yaml.safe_dump(plain(context), sort_keys=False, allow_unicode=True))
            return Result(source, OK)

        return self._each(sources, work)

    def context_path(self, source: str) -> Path:
        return self.root / "output" / (source if self._is_config(source) else source + ".yaml")

    def context(self, source: str) -> dict:
        path = self.context_path(source)
        if not path.exists():
            raise ValueError(f"no context of {source}; build it first")
        return yaml.safe_load(path.read_text())

    def contexts(self) -> str:
        """All contexts under headers."""
        built = [s for s in self.sources() if self.context_path(s).exists()]
        return "\n".join(f"# ===== {s} =====\n{self.context_path(s).read_text()}" for s in built)

    def version(self, source: str) -> str:
        import hashlib

        return hashlib.sha256(self.context_path(source).read_bytes()).hexdigest()

    def chunks(self, source: str) -> DataFrame:
        """The chunks of a context: table and column sentences, or windows of a file's words."""
        context = self.context(source)
        if "text" in context:
            rows = chunking.word_chunks(self.spark.createDataFrame([(0, context["text"])], "id bigint, text string"), "id", "text")
            rows = rows.select(F.lit(None).cast("string").alias("chunk_type"), F.col("chunk_content").alias("embeddable_text"))
        else:
            fields = "name string, kind string, description string, columns array<struct<name:string,type:string,nullable:boolean,generated:string,description:string>>, primary_key array<string>, foreign_keys array<struct<mapping:array<struct<from_column:string,to_column:string>>,referenced_table:string>>"
            lines = [(json.dumps(t),) for t in context.get("tables", [])]
            tables = self.spark.createDataFrame(lines, "line string").select(F.from_json("line", fields).alias("t")).select("t.*")
            rows = chunking.table_chunks(tables).select("chunk_type", "embeddable_text")
        key = F.xxhash64(F.lit(source), F.lit(self.version(source)), F.col("embeddable_text"))
        return rows.select(key.alias("chunk_id"), F.lit(context["datasource_type"]).alias("full_type"), "chunk_type", "embeddable_text", F.col("embeddable_text").alias("display_text"), F.col("embeddable_text").alias("keyword_index_text")).dropDuplicates(["chunk_id"])

    def index(self, sources: list[str] | None = None, override: bool = False) -> list[Result]:
        """Chunk, embed and store each context that isn't indexed in its current version."""

        def work(source: str) -> Result:
            if not self.context_path(source).exists():
                return Result(source, SKIPPED, "not built")
            digest = self.version(source)
            if self.store.is_indexed(source, ALGORITHM, digest) and not override:
                return Result(source, SKIPPED, "already indexed")
            chunks = self.chunks(source)
            self.store.models.ensure("own", "hashing", self.dim)
            self.store.persist(chunks, source, ALGORITHM, digest, embedded(chunks, self.embed, self.dim), "own", "hashing", self.dim, override)
            return Result(source, OK)

        return self._each(sources, work)

    def search(self, question: str, limit: int = 10, sources: list[str] | None = None, mode: str = "hybrid", chunk_types: list[str] | None = None, query_mode: str = RAW) -> DataFrame:
        """Best chunks of the current versions: ``hybrid``, ``vector`` or ``keyword``. Keyword statistics are over all chunks; filters come after.

        query_mode: ``raw``; ``instruct`` puts an instruction before what is embedded;
        ``rewrite`` adds the entities that the provider finds to what is embedded and to
        what keywords are taken from. Only a rewritten question reaches the keyword side.
        """
        said, asked = queries(question, mode, query_mode, self.entities)
        wanted = [s for s in (sources or self.sources()) if self.context_path(s).exists()]
        self.index(wanted)
        allowed = self.spark.createDataFrame([(s, self.version(s)) for s in wanted], "datasource_id string, hash string")
        visible = store.current(self.store.chunks, allowed)
        if chunk_types:
            visible = visible.where(F.col("chunk_type").isin(chunk_types))
        ids, n = visible.select("chunk_id"), search.candidate_limit(limit)
        found = {}
        if mode in ("hybrid", "keyword"):
            found["keyword"] = self.store.keyword_search(said, n if mode == "hybrid" else limit, ids)
        if mode in ("hybrid", "vector"):
            vectors = self.store.vectors("own", "hashing").join(ids, "chunk_id", "left_semi").dropDuplicates(["chunk_id"])
            found["vector"] = search.vector_search(vectors, self.embed([asked])[0], "chunk_id", "vec", n if mode == "hybrid" else limit)
        if not found:
            raise ValueError(f"unknown search mode {mode!r}")
        best = search.fuse(found["vector"], found["keyword"], "chunk_id", limit) if mode == "hybrid" else found[mode]
        score = {"hybrid": "rrf_score", "vector": "vector_distance", "keyword": "bm25_score"}[mode]
        out = best.join(visible.select("chunk_id", "datasource_id", "chunk_type", F.coalesce("display_text", "embeddable_text").alias("display_text")), "chunk_id")
        return out.withColumn("score", F.col(score)).orderBy(F.col(score) if mode == "vector" else F.desc(score), "chunk_id")

    def run_sql(self, source: str, sql: str, params: dict | list | None = None, read_only: bool = True) -> DataFrame:
        """Read-only SQL over a source's tables."""
        if not self._is_config(source):
            raise NotImplementedError("files hold no tables")
        for name, df in self.tables(self.config(source)).items():
            df.createOrReplaceTempView(name)
        return run_sql(self.spark, sql, params, read_only)

    def typed_context(self, source: str) -> dict:
        """The context of a source that has tables; a file's raises."""
        context = self.context(source)
        if context.get("datasource_type") == "file" or "tables" not in context:
            raise ValueError(f"{source} holds no tables")
        self.kinds[context["datasource_type"]]
        return context

    def browse(self, source: str) -> dict[str, str | None]:
        """Tables of a source with their descriptions."""
        return {t["name"]: t.get("description") for t in self.typed_context(source)["tables"]}

    def table_details(self, source: str, name: str) -> dict:
        tables = {t["name"]: t for t in self.typed_context(source)["tables"]}
        if name not in tables:
            raise ValueError(f"no table {name}; there are {', '.join(sorted(tables))}")
        return tables[name]
