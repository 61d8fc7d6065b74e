"""Catalog introspection: what a database says about its own tables, as component rows.

A dialect is a set of named catalog queries, one a component (relations, columns,
primary_keys, unique_keys, checks, foreign_keys, indexes, partitions). ``components`` runs each of
them through a reader and gives DataFrames with one row contract for all dialects, which
``weftline.operators.catalog.assembled_tables`` assembles. Catalogs are small next to the tables
they describe: a row a column.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from contextlib import closing
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources.databases import Connection

Reader = Callable[[str], DataFrame]

#: The row contract: columns of each component beyond schema_name and table_name.
CONTRACT = {
    "relations": "kind string, description string",
    "columns": "ordinal_position int, column_name string, data_type string, is_nullable string, default_expression string, generated string, description string",
    "primary_keys": "constraint_name string, position int, column_name string, validated boolean",
    "unique_keys": "constraint_name string, position int, column_name string, validated boolean",
    "checks": "constraint_name string, expression string, validated boolean",
    "foreign_keys": "constraint_name string, position int, from_column string, ref_schema string, ref_table string, to_column string, on_update string, on_delete string, enforced boolean, validated boolean",
    "indexes": "index_name string, position int, expr string, is_unique string, method string, predicate string",
    "partitions": "partitioning_strategy string, position int, column_name string, partition_table string",
}

KEY_COLUMNS = """
select k.table_schema as schema_name, k.table_name, k.constraint_name, k.ordinal_position as position, k.column_name
from information_schema.key_column_usage k
join information_schema.table_constraints c
  on c.constraint_schema = k.constraint_schema and c.constraint_name = k.constraint_name and c.table_schema = k.table_schema and c.table_name = k.table_name
where c.constraint_type = '{kind}'
"""

#: Components that the standard's information schema gives in the same way everywhere.
STANDARD = {
    "relations": "select table_schema as schema_name, table_name, case table_type when 'VIEW' then 'view' else 'table' end as kind from information_schema.tables",
    "columns": "select table_schema as schema_name, table_name, ordinal_position, column_name, data_type, is_nullable, column_default as default_expression from information_schema.columns",
    "primary_keys": KEY_COLUMNS.format(kind="PRIMARY KEY"),
    "unique_keys": KEY_COLUMNS.format(kind="UNIQUE"),
    "checks": """
select c.table_schema as schema_name, c.table_name, c.constraint_name, k.check_clause as expression
from information_schema.table_constraints c
join information_schema.check_constraints k on k.constraint_schema = c.constraint_schema and k.constraint_name = c.constraint_name
where c.constraint_type = 'CHECK'
""",
    "foreign_keys": """
select f.table_schema as schema_name, f.table_name, f.constraint_name, f.ordinal_position as position, f.column_name as from_column,
       t.table_schema as ref_schema, t.table_name as ref_table, t.column_name as to_column, r.update_rule as on_update, r.delete_rule as on_delete
from information_schema.referential_constraints r
join information_schema.key_column_usage f on f.constraint_schema = r.constraint_schema and f.constraint_name = r.constraint_name
join information_schema.key_column_usage t
  on t.constraint_schema = r.unique_constraint_schema and t.constraint_name = r.unique_constraint_name and t.ordinal_position = f.position_in_unique_constraint
""",
}

SQLITE = {
    "relations": "select 'main' as schema_name, name as table_name, type as kind from sqlite_master where type in ('table', 'view') and name not like 'sqlite\\_%' escape '\\'",
    "columns": """
select 'main' as schema_name, m.name as table_name, c.cid + 1 as ordinal_position, c.name as column_name, c.type as data_type,
       case when c."notnull" or c.pk > 0 and upper(c.type) = 'INTEGER' then 'no' else 'yes' end as is_nullable, c.dflt_value as default_expression, case when c.hidden in (2, 3) then 'computed' end as "generated"
from sqlite_master m join pragma_table_xinfo(m.name) c where m.type in ('table', 'view') and m.name not like 'sqlite\\_%' escape '\\' and m.name not in (select name from temp.weftline_broken_views) and c.hidden <> 1
""",
    "primary_keys": "select 'main' as schema_name, m.name as table_name, 'pk_' || m.name as constraint_name, c.pk as position, c.name as column_name from sqlite_master m join pragma_table_info(m.name) c where m.type = 'table' and c.pk > 0",
    "unique_keys": """
select 'main' as schema_name, m.name as table_name, i.name as constraint_name, x.seqno + 1 as position, x.name as column_name
from sqlite_master m join pragma_index_list(m.name) i join pragma_index_info(i.name) x where m.type = 'table' and i.origin = 'u'
""",
    "foreign_keys": """
select 'main' as schema_name, m.name as table_name, 'fk_' || m.name || '_' || f.id as constraint_name, f.seq + 1 as position, f."from" as from_column, 'main' as ref_schema, f."table" as ref_table,
       coalesce(f."to", (select p.name from pragma_table_info(f."table") p where p.pk = f.seq + 1)) as to_column, lower(f.on_update) as on_update, lower(f.on_delete) as on_delete
from sqlite_master m join pragma_foreign_key_list(m.name) f where m.type = 'table'
""",
    "indexes": """
select 'main' as schema_name, m.name as table_name, i.name as index_name, x.seqno + 1 as position, x.name as expr, case when i."unique" then 'yes' else 'no' end as is_unique
from sqlite_master m join pragma_index_list(m.name) i join pragma_index_info(i.name) x where m.type = 'table' and i.origin = 'c'
""",
}

DUCKDB_KEYS = """
select schema_name, table_name, constraint_name, unnest(generate_series(1, len(constraint_column_names))) as position, unnest(constraint_column_names) as column_name
from duckdb_constraints() where constraint_type = '{kind}'
"""
DUCKDB = {
    "relations": """
select schema_name, table_name, 'table' as kind, comment as description from duckdb_tables() where not internal
union all select schema_name, view_name, 'view', comment from duckdb_views() where not internal
""",
    "columns": "select schema_name, table_name, column_index as ordinal_position, column_name, data_type, case when is_nullable then 'yes' else 'no' end as is_nullable, column_default as default_expression, comment as description from duckdb_columns() where not internal",
    "primary_keys": DUCKDB_KEYS.format(kind="PRIMARY KEY"),
    "unique_keys": DUCKDB_KEYS.format(kind="UNIQUE"),
    "checks": "select schema_name, table_name, constraint_name, expression from duckdb_constraints() where constraint_type = 'CHECK'",
    "foreign_keys": """
select schema_name, table_name, constraint_name, unnest(generate_series(1, len(constraint_column_names))) as position, unnest(constraint_column_names) as from_column,
       schema_name as ref_schema, referenced_table as ref_table, unnest(referenced_column_names) as to_column
from duckdb_constraints() where constraint_type = 'FOREIGN KEY'
""",
    "indexes": """
select schema_name, table_name, index_name, unnest(generate_series(1, len(e))) as position, unnest(e) as expr, case when is_unique then 'yes' else 'no' end as is_unique
from (select *, list_transform(string_split(trim(expressions, '[]'), ','), lambda x: trim(x, ' "''')) as e from duckdb_indexes())
""",
}

POSTGRESQL_KEYS = """
select n.nspname as schema_name, c.relname as table_name, k.conname as constraint_name, u.position, a.attname as column_name, k.convalidated as validated
from pg_constraint k join pg_class c on c.oid = k.conrelid join pg_namespace n on n.oid = c.relnamespace
cross join lateral unnest(k.conkey) with ordinality as u(own, position) join pg_attribute a on a.attrelid = k.conrelid and a.attnum = u.own
where k.contype = '{kind}' and not c.relispartition
"""
POSTGRESQL = STANDARD | {
    "relations": """
select n.nspname as schema_name, c.relname as table_name, obj_description(c.oid, 'pg_class') as description,
       case c.relkind when 'v' then 'view' when 'm' then 'materialized_view' when 'f' then 'external_table' else 'table' end as kind
from pg_class c join pg_namespace n on n.oid = c.relnamespace where c.relkind in ('r', 'p', 'v', 'm', 'f') and not c.relispartition
""",
    "columns": """
select n.nspname as schema_name, c.relname as table_name, a.attnum as ordinal_position, a.attname as column_name, format_type(a.atttypid, a.atttypmod) as data_type,
       case when a.attnotnull then 'no' else 'yes' end as is_nullable, pg_get_expr(d.adbin, d.adrelid) as default_expression,
       case when a.attidentity <> '' then 'identity' when a.attgenerated <> '' then 'computed' end as generated, col_description(c.oid, a.attnum) as description
from pg_attribute a join pg_class c on c.oid = a.attrelid join pg_namespace n on n.oid = c.relnamespace left join pg_attrdef d on d.adrelid = a.attrelid and d.adnum = a.attnum
where a.attnum > 0 and not a.attisdropped and c.relkind in ('r', 'p', 'v', 'm', 'f') and not c.relispartition
""",
    # constraint names are unique within a table only, so the standard's views, which know them by schema, would mix tables up
    "primary_keys": POSTGRESQL_KEYS.format(kind="p"),
    "unique_keys": POSTGRESQL_KEYS.format(kind="u"),
    "checks": """
select n.nspname as schema_name, c.relname as table_name, k.conname as constraint_name, pg_get_expr(k.conbin, k.conrelid) as expression, k.convalidated as validated
from pg_constraint k join pg_class c on c.oid = k.conrelid join pg_namespace n on n.oid = c.relnamespace where k.contype = 'c' and not c.relispartition
""",
    "foreign_keys": """
select n.nspname as schema_name, c.relname as table_name, k.conname as constraint_name, u.position, a.attname as from_column, rn.nspname as ref_schema, r.relname as ref_table, b.attname as to_column,
       case k.confupdtype when 'c' then 'cascade' when 'n' then 'set null' when 'd' then 'set default' when 'r' then 'restrict' else 'no action' end as on_update,
       case k.confdeltype when 'c' then 'cascade' when 'n' then 'set null' when 'd' then 'set default' when 'r' then 'restrict' else 'no action' end as on_delete,
       k.convalidated as validated
from pg_constraint k join pg_class c on c.oid = k.conrelid join pg_namespace n on n.oid = c.relnamespace join pg_class r on r.oid = k.confrelid join pg_namespace rn on rn.oid = r.relnamespace
cross join lateral unnest(k.conkey, k.confkey) with ordinality as u(own, other, position)
join pg_attribute a on a.attrelid = k.conrelid and a.attnum = u.own join pg_attribute b on b.attrelid = k.confrelid and b.attnum = u.other
where k.contype = 'f' and not c.relispartition and not r.relispartition
""",
    # an index that stands behind a key is that key
    "indexes": """
select n.nspname as schema_name, t.relname as table_name, i.relname as index_name, p.position, pg_get_indexdef(x.indexrelid, p.position, true) as expr,
       case when x.indisunique then 'yes' else 'no' end as is_unique, m.amname as method, pg_get_expr(x.indpred, x.indrelid) as predicate
from pg_index x join pg_class t on t.oid = x.indrelid join pg_class i on i.oid = x.indexrelid join pg_namespace n on n.oid = t.relnamespace join pg_am m on m.oid = i.relam
cross join lateral generate_series(1, x.indnkeyatts) as p(position)
where not t.relispartition and not exists (select 1 from pg_constraint k where k.conindid = x.indexrelid and k.contype in ('p', 'u', 'x'))
""",
    "partitions": """
select n.nspname as schema_name, c.relname as table_name, case q.partstrat when 'h' then 'hash partitioned' when 'l' then 'list partitioned' when 'r' then 'range partitioned' end as partitioning_strategy,
       u.position, a.attname as column_name, child.relname as partition_table
from pg_partitioned_table q join pg_class c on c.oid = q.partrelid join pg_namespace n on n.oid = c.relnamespace
cross join lateral unnest(q.partattrs::int2[]) with ordinality as u(own, position)
left join pg_attribute a on a.attrelid = q.partrelid and a.attnum = u.own
left join pg_inherits h on h.inhparent = q.partrelid left join pg_class child on child.oid = h.inhrelid
""",
}

MYSQL = STANDARD | {
    "relations": "select table_schema as schema_name, table_name as table_name, case table_type when 'VIEW' then 'view' else 'table' end as kind, nullif(table_comment, '') as description from information_schema.tables",
    "columns": """
select table_schema as schema_name, table_name as table_name, ordinal_position as ordinal_position, column_name as column_name, column_type as data_type, is_nullable as is_nullable,
       column_default as default_expression, case when extra like '%auto_increment%' then 'identity' when extra like '%VIRTUAL GENERATED%' or extra like '%STORED GENERATED%' then 'computed' end as `generated`, nullif(column_comment, '') as description
from information_schema.columns
""",
    "foreign_keys": """
select k.table_schema as schema_name, k.table_name as table_name, k.constraint_name as constraint_name, k.ordinal_position as position, k.column_name as from_column,
       k.referenced_table_schema as ref_schema, k.referenced_table_name as ref_table, k.referenced_column_name as to_column, lower(r.update_rule) as on_update, lower(r.delete_rule) as on_delete
from information_schema.key_column_usage k join information_schema.referential_constraints r on r.constraint_schema = k.constraint_schema and r.constraint_name = k.constraint_name and r.table_name = k.table_name
where k.referenced_table_name is not null
""",
    "indexes": """
select table_schema as schema_name, table_name as table_name, index_name as index_name, seq_in_index as position, coalesce(expression, column_name) as expr,
       case when non_unique = 0 then 'yes' else 'no' end as is_unique, lower(index_type) as method
from information_schema.statistics where index_name <> 'PRIMARY'
""",
}

MSSQL = STANDARD | {
    "relations": """
select schema_name(o.schema_id) as schema_name, o.name as table_name, case o.type when 'V' then 'view' else 'table' end as kind, cast(p.value as nvarchar(4000)) as description
from sys.objects o left join sys.extended_properties p on p.class = 1 and p.major_id = o.object_id and p.minor_id = 0 and p.name = 'MS_Description'
where o.type in ('U', 'V') and o.is_ms_shipped = 0
""",
    "columns": """
select schema_name(o.schema_id) as schema_name, o.name as table_name, c.column_id as ordinal_position, c.name as column_name,
       type_name(c.user_type_id) + case
         when type_name(c.system_type_id) in ('varchar', 'char', 'varbinary', 'binary') then '(' + case c.max_length when -1 then 'max' else cast(c.max_length as varchar(10)) end + ')'
         when type_name(c.system_type_id) in ('nvarchar', 'nchar') then '(' + case c.max_length when -1 then 'max' else cast(c.max_length / 2 as varchar(10)) end + ')'
         when type_name(c.system_type_id) in ('decimal', 'numeric') then '(' + cast(c.precision as varchar(10)) + ',' + cast(c.scale as varchar(10)) + ')' else '' end as data_type,
       case when c.is_nullable = 1 then 'yes' else 'no' end as is_nullable, coalesce(k.definition, d.definition) as default_expression,
       case when c.is_identity = 1 then 'identity' when c.is_computed = 1 then 'computed' end as generated, cast(p.value as nvarchar(4000)) as description
from sys.columns c join sys.objects o on o.object_id = c.object_id
left join sys.default_constraints d on d.object_id = c.default_object_id
left join sys.computed_columns k on k.object_id = c.object_id and k.column_id = c.column_id
left join sys.extended_properties p on p.class = 1 and p.major_id = c.object_id and p.minor_id = c.column_id and p.name = 'MS_Description'
where o.type in ('U', 'V') and o.is_ms_shipped = 0
""",
    # a foreign key may point to a unique index, which the standard's views don't know
    "foreign_keys": """
select schema_name(t.schema_id) as schema_name, t.name as table_name, f.name as constraint_name, c.constraint_column_id as position, col_name(c.parent_object_id, c.parent_column_id) as from_column,
       schema_name(r.schema_id) as ref_schema, r.name as ref_table, col_name(c.referenced_object_id, c.referenced_column_id) as to_column,
       lower(replace(f.update_referential_action_desc, '_', ' ')) as on_update, lower(replace(f.delete_referential_action_desc, '_', ' ')) as on_delete,
       case when f.is_disabled = 0 then 'true' else 'false' end as enforced, case when f.is_not_trusted = 0 then 'true' else 'false' end as validated
from sys.foreign_keys f join sys.tables t on t.object_id = f.parent_object_id join sys.tables r on r.object_id = f.referenced_object_id
join sys.foreign_key_columns c on c.constraint_object_id = f.object_id
""",
    "indexes": """
select schema_name(t.schema_id) as schema_name, t.name as table_name, i.name as index_name, c.key_ordinal as position,
       col_name(c.object_id, c.column_id) + case when c.is_descending_key = 1 then ' DESC' else '' end as expr,
       case when i.is_unique = 1 then 'yes' else 'no' end as is_unique, lower(i.type_desc) as method, i.filter_definition as predicate
from sys.indexes i join sys.tables t on t.object_id = i.object_id join sys.index_columns c on c.object_id = i.object_id and c.index_id = i.index_id
where i.is_primary_key = 0 and i.is_unique_constraint = 0 and c.key_ordinal > 0
""",
}

CLICKHOUSE = {
    "relations": "select database as schema_name, name as table_name, multiIf(engine = 'View', 'view', engine = 'MaterializedView', 'materialized_view', 'table') as kind, nullIf(comment, '') as description from system.tables where not is_temporary",
    "columns": """
select database as schema_name, table as table_name, position as ordinal_position, name as column_name, type as data_type, if(startsWith(type, 'Nullable'), 'yes', 'no') as is_nullable,
       nullIf(default_expression, '') as default_expression, if(default_kind in ('MATERIALIZED', 'ALIAS'), 'computed', null) as generated, nullIf(comment, '') as description
from system.columns
""",
    "indexes": "select database as schema_name, table as table_name, name as index_name, 1 as position, expr, 'no' as is_unique, type as method from system.data_skipping_indices",
}

SNOWFLAKE = {
    "relations": """
select table_schema as schema_name, table_name, comment as description,
       case table_type when 'VIEW' then 'view' when 'MATERIALIZED VIEW' then 'materialized_view' when 'EXTERNAL TABLE' then 'external_table' else 'table' end as kind
from {part}.information_schema.tables
""",
    "columns": """
select table_schema as schema_name, table_name, ordinal_position, column_name, data_type, is_nullable, column_default as default_expression,
       case is_identity when 'YES' then 'identity' end as "generated", comment as description
from {part}.information_schema.columns
""",
}

BIGQUERY_KEYS = """
select k.table_schema as schema_name, k.table_name, k.constraint_name, k.ordinal_position as position, k.column_name
from {part}.INFORMATION_SCHEMA.TABLE_CONSTRAINTS c
join {part}.INFORMATION_SCHEMA.KEY_COLUMN_USAGE k on k.constraint_schema = c.constraint_schema and k.constraint_name = c.constraint_name
where c.constraint_type = 'PRIMARY KEY'
"""
BIGQUERY = {
    "relations": """
select table_schema as schema_name, table_name,
       case table_type when 'VIEW' then 'view' when 'MATERIALIZED VIEW' then 'materialized_view' when 'EXTERNAL' then 'external_table' when 'SNAPSHOT' then 'snapshot' when 'CLONE' then 'clone' else 'table' end as kind
from {part}.INFORMATION_SCHEMA.TABLES
""",
    "columns": """
select c.table_schema as schema_name, c.table_name, c.ordinal_position, c.column_name, c.data_type, c.is_nullable, nullif(c.column_default, 'NULL') as default_expression,
       case c.is_generated when 'ALWAYS' then 'computed' end as generated, f.description
from {part}.INFORMATION_SCHEMA.COLUMNS c
left join {part}.INFORMATION_SCHEMA.COLUMN_FIELD_PATHS f on f.table_name = c.table_name and f.field_path = c.column_name
""",
    "primary_keys": BIGQUERY_KEYS,
    # a foreign key names the table it points to; which of its columns, its position in that table's primary key says
    "foreign_keys": f"""
with pk as ({BIGQUERY_KEYS}),
target as (select distinct constraint_name, table_schema, table_name from {{part}}.INFORMATION_SCHEMA.CONSTRAINT_COLUMN_USAGE)
select k.table_schema as schema_name, k.table_name, k.constraint_name, k.ordinal_position as position, k.column_name as from_column,
       t.table_schema as ref_schema, t.table_name as ref_table, pk.column_name as to_column, case c.enforced when 'YES' then 'true' else 'false' end as enforced
from {{part}}.INFORMATION_SCHEMA.TABLE_CONSTRAINTS c
join {{part}}.INFORMATION_SCHEMA.KEY_COLUMN_USAGE k on k.constraint_schema = c.constraint_schema and k.constraint_name = c.constraint_name
join target t on t.constraint_name = c.constraint_name
left join pk on pk.schema_name = t.table_schema and pk.table_name = t.table_name and pk.position = k.position_in_unique_constraint
where c.constraint_type = 'FOREIGN KEY'
""",
    "partitions": "select table_schema as schema_name, table_name, 'column' as partitioning_strategy, 1 as position, column_name from {part}.INFORMATION_SCHEMA.COLUMNS where is_partitioning_column = 'YES'",
}

DIALECTS = {
    "sqlite": SQLITE,
    "duckdb": DUCKDB,
    "postgresql": POSTGRESQL,
    "mysql": MYSQL,
    "mssql": MSSQL,
    "clickhouse": CLICKHOUSE,
    "athena": {k: STANDARD[k] for k in ("relations", "columns")},
    "snowflake": SNOWFLAKE,
    "bigquery": BIGQUERY,
}
#: Dialects whose catalog is one a database or data set: how these are listed; queries stand for each of them with its name for {part}.
PARTS = {
    "snowflake": "select database_name as part from information_schema.databases",
    "bigquery": "select schema_name as part from INFORMATION_SCHEMA.SCHEMATA",
}

# Schemas that hold a database's own catalog.
SYSTEM_SCHEMAS = {
    "postgresql": ("information_schema", "pg_catalog", "pg_toast"),
    "mysql": ("information_schema", "mysql", "performance_schema", "sys"),
    "mssql": (
        "information_schema", "sys", "guest", "db_owner", "db_accessadmin", "db_securityadmin", "db_ddladmin", "db_backupoperator",
        "db_datareader", "db_datawriter", "db_denydatareader", "db_denydatawriter",
    ),
    "clickhouse": ("information_schema", "system"),
    "duckdb": ("information_schema", "pg_catalog"),
    "athena": ("information_schema",),
    "snowflake": ("information_schema",),
    "bigquery": ("information_schema",),
}


def per_part(read: Reader, query: str, parts: list[str]) -> DataFrame:
    """One catalog query for each database or data set, all rows together; names that are no plain identifiers raise, since they go into the query."""
    if bad := [p for p in parts if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_$-]*", p)]:
        raise ValueError(f"names that can't be put into a query: {', '.join(bad)}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [read(query.replace("{part}", p)) for p in parts])


def components(spark: SparkSession, dialect: str, read: Reader, parts: list[str] | None = None) -> dict[str, DataFrame]:
    """The rows of every component in the contract's columns and types.

    A component that the dialect's catalog doesn't have is empty, and a column that its
    query doesn't give is null. Rows of the database's own schemas are left out. parts: the
    databases or data sets of a dialect that has a catalog for each; all that are listed if left out.
    """
    if dialect not in DIALECTS:
        raise ValueError(f"no catalog queries for {dialect}; there are {', '.join(sorted(DIALECTS))}")
    hidden = SYSTEM_SCHEMAS.get(dialect, ())
    if dialect in PARTS and parts is None:
        parts = [r[0] for r in read(PARTS[dialect]).collect() if r[0].lower() not in hidden]  # a row a database or data set
    out = {}
    for name, columns in CONTRACT.items():
        schema = f"schema_name string, table_name string, {columns}"
        query = DIALECTS[dialect].get(name)
        if query is None or dialect in PARTS and not parts:
            out[name] = spark.createDataFrame([], schema)
            continue
        found = per_part(read, query, parts) if dialect in PARTS else read(query)
        known = {c.lower(): c for c in found.columns}
        wanted = [f.strip().split(" ") for f in schema.split(",")]
        rows = found.select(*[(F.col(f"`{known[c]}`") if c in known else F.lit(None)).cast(t).alias(c) for c, t in wanted])
        out[name] = rows.where(~F.lower("schema_name").isin(*hidden)) if hidden else rows
    return out


def jdbc_reader(spark: SparkSession, connection: Connection) -> Reader:
    """Catalog queries over JDBC; the database runs them."""
    return lambda query: spark.read.format("jdbc").options(url=connection.url(), query=query.strip(), **connection.options).load()


def sqlite_reader(spark: SparkSession, path: str) -> Reader:
    """Catalog queries of a SQLite file, through Python's own driver; views that no longer resolve have no columns."""

    def read(query: str) -> DataFrame:
        import sqlite3

        with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as c:
            c.execute("create temp table weftline_broken_views (name text)")
            for (view,) in c.execute("select name from sqlite_master where type = 'view'").fetchall():
                try:
                    c.execute("select name from pragma_table_xinfo(?)", (view,)).fetchall()
                except sqlite3.OperationalError:
                    c.execute("insert into weftline_broken_views values (?)", (view,))
            cursor = c.execute(query)
            return local_rows(spark, [d[0] for d in cursor.description], cursor.fetchall())

    return read


def duckdb_reader(spark: SparkSession, path: str) -> Reader:
    """Catalog queries of a DuckDB file, where its Python driver is there."""

    def read(query: str) -> DataFrame:
        import duckdb

        with duckdb.connect(path, read_only=True) as c:
            cursor = c.execute(query)
            return local_rows(spark, [d[0] for d in cursor.description], cursor.fetchall())

    return read


def local_rows(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """Catalog rows as strings, which ``components`` casts."""
    shown = [tuple(None if v is None else str(v) for v in r) for r in rows]
    return spark.createDataFrame(shown, ", ".join(f"`{n}` string" for n in names))
