"""Every query against its SQL, over the driver's smallest tables."""

import math
from datetime import datetime

import duckdb
import pytest

from cloakwork import case_queries, queries

QUERIES, SQL = queries.QUERIES | case_queries.QUERIES, queries.SQL | case_queries.SQL
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: [(x is not None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    assert got[1]
    if name in SQL:
        found = db.execute(SQL[name])
        want = rows_of([d[0] for d in found.description], found.fetchall())
        assert got[0] == want[0] and len(got[1]) == len(want[1])
        assert got[1] == want[1]
