"""Every query against its SQL, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from strataflow.queries import QUERIES, SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(round(r[i], 6) if isinstance(r[i], float) else r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    found = rows(df.collect(), df.columns)
    assert found
    if name in SQL:
        con = duckdb.connect()
        for t in TABLES:
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = con.sql(SQL[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert found == rows(want.fetchall(), want.columns)
