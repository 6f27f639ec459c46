"""Every registered engine query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from quernel import queries as Q

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(v):
    return f"{v:.6g}" if isinstance(v, float) else str(list(v)) if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(Q.FOUND))
def test_query_equals_sql(spark, con, name):
    f, sql = Q.FOUND[name]
    got = f(Q.database(spark, DIR))
    cols = sorted(got.columns)
    mine = sorted(tuple(plain(r[c]) for c in cols) for r in got.collect())
    rel = con.sql(sql)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert mine == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
