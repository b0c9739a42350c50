"""Queries of the subpackage against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

from netloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    frame = queries.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    result = c.execute(queries.ORACLE_SQL[name])
    at = [[d[0] for d in result.description].index(x) for x in columns]
    assert sorted(map(tuple, frame.select(columns).collect()), key=str) == sorted((tuple(r[i] for i in at) for r in result.fetchall()), key=str)


def test_every_sql_has_its_query():
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES) and len(queries.QUERIES) == 10
