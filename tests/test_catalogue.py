"""Every query with SQL must give the SQL's rows."""

import duckdb
import pytest

from plumbline.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in ("orders", "events"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_rows_equal_sql(spark, duck, name):
    ours = catalogue.queries()[name](spark, DATA)
    columns = sorted(ours.columns)
    theirs = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(theirs.columns) == columns
    rows = lambda got: sorted((tuple(v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v for v in r) for r in got), key=str)
    a, b = rows(map(tuple, ours.select(*columns).collect())), rows(duck.sql(f"SELECT {', '.join(columns)} FROM theirs").fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            assert u == v or (isinstance(u, float) and abs(u - v) < 2e-6), (x, y)
