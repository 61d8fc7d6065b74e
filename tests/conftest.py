import os
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ.setdefault("WEFTLINE_DRIVER_MEMORY", "4g")

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from weftline.session import local_session

    return local_session("tests", cores=4, partitions=4)


@pytest.fixture(scope="session")
def duck():
    connection = duckdb.connect()
    connection.execute("set timezone = 'UTC'")
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return connection


def shown(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(shown(v) for v in value)
    return value


def same_rows(df, duck, sql):
    """Both sides' rows as sorted texts of the columns by name."""
    columns = sorted(df.columns)
    mine = sorted(repr(tuple(shown(r[c]) for c in columns)) for r in df.collect())
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    other = sorted(repr(tuple(shown(row[names.index(c)]) for c in columns)) for row in result.fetchall())
    return mine, other
