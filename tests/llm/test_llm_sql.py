"""The queries that SQL can express, against their SQL over the driver's smallest tables."""

import duckdb
import pytest

from cloakwork.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = c.execute(SQL[name])
    columns = [d[0] for d in found.description]
    want = sorted(found.fetchall(), key=str)
    got = QUERIES[name](spark, SF).select(columns)
    assert got.columns == columns
    assert sorted(map(tuple, got.collect()), key=str) == want
