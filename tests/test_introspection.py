import sqlite3

import pytest

from weftline.domain import FAILED, OK, Domain
from weftline.operators import catalog
from weftline.sources import introspection

SHOP_DDL = """
create table users (user_id integer primary key, name varchar not null, email varchar not null unique, is_active integer not null default 1);
create table products (product_id integer primary key, sku varchar not null unique, price decimal(10, 2));
create table orders (order_id integer primary key, user_id integer not null references users (user_id), order_number varchar not null, status varchar default 'PENDING', placed_at timestamp, amount integer, unique (user_id, order_number));
create table order_items (order_id integer not null references orders (order_id), product_id integer not null references products (product_id), quantity integer, primary key (order_id, product_id));
create index orders_user_placed on orders (user_id, placed_at);
create index items_product on order_items (product_id);
create view paid_orders as select order_id, user_id from orders where status = 'PAID';
"""


@pytest.fixture()
def shop(tmp_path):
    path = str(tmp_path / "shop.db")
    with sqlite3.connect(path) as c:
        c.executescript(SHOP_DDL)
        c.execute("insert into users values (1, 'Ann', 'a@x', 1), (2, 'Bo', 'b@x', 0)")
        c.execute("insert into orders values (10, 1, 'n1', 'PAID', '2024-01-01', 5)")
    return path


def model(spark, dialect, read):
    return {r.name: r for r in catalog.assembled_tables(**introspection.components(spark, dialect, read)).collect()}


def test_sqlite_catalog(spark, shop):
    tables = model(spark, "sqlite", introspection.sqlite_reader(spark, shop))
    assert {n: t.kind for n, t in tables.items()} == {"users": "table", "products": "table", "orders": "table", "order_items": "table", "paid_orders": "view"}
    orders = tables["orders"]
    assert [(c.name, c.nullable) for c in orders.columns][:2] == [("order_id", False), ("user_id", False)]
    assert orders.primary_key == ["order_id"] and tables["order_items"].primary_key == ["order_id", "product_id"]
    assert [k.columns for k in orders.unique_keys] == [["user_id", "order_number"]]
    assert [(k.referenced_table, [(m.from_column, m.to_column) for m in k.mapping]) for k in orders.foreign_keys] == [("main.users", [("user_id", "user_id")])]
    assert [(i.index_name, i.columns, i.unique) for i in orders.indexes] == [("orders_user_placed", ["user_id", "placed_at"], False)]


def test_a_broken_view_leaves_the_rest(spark, shop):
    with sqlite3.connect(shop) as c:
        c.executescript("create table gone (a int); create view broken as select a from gone; drop table gone;")
    tables = model(spark, "sqlite", introspection.sqlite_reader(spark, shop))
    assert tables["broken"].columns == [] and len(tables["users"].columns) == 4


def test_duckdb_catalog(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    path = str(tmp_path / "x.duckdb")
    with duckdb.connect(path) as c:
        c.execute("create table users (id integer primary key, email varchar not null unique, age integer check (age > 0)); comment on table users is 'people'")
        c.execute("create table orders (a integer, b integer, user_id integer references users (id), primary key (a, b)); create index by_user on orders (user_id, b); create view v as select id from users")
    tables = model(spark, "duckdb", introspection.duckdb_reader(spark, path))
    assert {n: t.kind for n, t in tables.items()} == {"users": "table", "orders": "table", "v": "view"}
    users, orders = tables["users"], tables["orders"]
    assert users.description == "people" and users.primary_key == ["id"] and [k.columns for k in users.unique_keys] == [["email"]] and "age" in users.checks[0].expression
    assert orders.primary_key == ["a", "b"] and orders.foreign_keys[0].referenced_table == "main.users" and orders.indexes[0].columns == ["user_id", "b"]


def test_components_keep_the_contract(spark):
    with pytest.raises(ValueError, match="nope"):
        introspection.components(spark, "nope", lambda q: None)
    read = lambda q: spark.createDataFrame([("pg_catalog", "t", "x"), ("s", "t", "x")], "SCHEMA_NAME string, TABLE_NAME string, EXTRA string")
    for dialect in introspection.DIALECTS:
        for name, df in introspection.components(spark, dialect, read).items():
            assert df.columns == ["schema_name", "table_name", *[c.split()[0] for c in introspection.CONTRACT[name].split(", ")]]
    assert introspection.components(spark, "postgresql", read)["relations"].count() == 1


def test_domain_over_sqlite(spark, shop, tmp_path):
    d = Domain.create(spark, str(tmp_path / "d"))
    (d.root / "src" / "shop.yaml").write_text(f"type: sqlite\npath: {shop}\n")
    (d.root / "src" / "none.yaml").write_text(f"type: sqlite\npath: {tmp_path}/none.db\n")
    assert {r.datasource_id: r.status for r in d.build()} == {"shop.yaml": OK, "none.yaml": FAILED}
    assert d.table_details("shop.yaml", "orders")["unique_keys"][0]["columns"] == ["user_id", "order_number"]
    assert [s["name"] for s in d.table_details("shop.yaml", "users")["samples"]] == ["Ann", "Bo"]
    assert d.run_sql("shop.yaml", "SELECT count(*) AS n FROM paid_orders").first().n == 1
    assert d.chunks("shop.yaml").where("embeddable_text like '%foreign key to main.users.user_id%'").count() == 1
