"""Queries with SQL give DuckDB's rows on the smallest tables."""

import os

import duckdb
import pytest

from ridgeline.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    df = queries.QUERIES[name](spark, SF)
    cursor = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    order = sorted(df.columns)
    assert sorted(names) == order
    want = sorted((tuple(r[names.index(c)] for c in order) for r in cursor.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in order) for r in df.collect()), key=str) == want


def test_every_operator_is_registered():
    ops = [n for n in queries.QUERIES if n.startswith("op")]
    assert [n.split("_")[0] for n in ops] == [f"op{i}" for i in range(1, 11)] and set(queries.ORACLE_SQL) <= set(queries.QUERIES)
