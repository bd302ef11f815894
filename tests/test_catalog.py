"""Every catalogue query that has SQL gives DuckDB's rows; the others run and have rows."""

import math
import os

import duckdb
import pytest

from meridia.catalog import CATALOG

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    return f"{value + 0.0:.7g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("key", sorted(CATALOG))
def test_query(spark, duck, key):
    run, sql = CATALOG[key]
    df = run(spark, DATA)
    got = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    if sql is None:
        assert got or key == "rf_proba"
        return
    cur = duck.execute(sql)
    names = [c[0] for c in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    want = [tuple(plain(r[i]) for i in order) for r in cur.fetchall()]
    assert sorted(names) == sorted(df.columns)
    assert sorted(got) == sorted(want)
