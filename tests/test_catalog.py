"""Every query with an oracle gives DuckDB's rows on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from ridgeline.operators import elevation as el
from ridgeline.plans import catalog, ingest
from ridgeline.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 9) + 0.0
    return float(v) if hasattr(v, "as_tuple") else v


def rows(data, names, order):
    at = [names.index(c) for c in order]
    return sorted((tuple(plain(r[i]) for i in at) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cursor = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    assert rows(df.collect(), df.columns, order) == rows(cursor.fetchall(), names, order)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["id", "in_degree", "out_degree", "degree"] and df.count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["g16_g18_route_search_naive", "plan_optimised_nodes", "plan_sanitised_edges"])
def test_spread_rows(spark, monkeypatch, name):
    """Over many partitions, as many rows are, a query gives the same rows."""
    rows = lambda: sorted(map(str, catalog.QUERIES[name](spark, SF).collect()))
    whole, dealt = rows(), []
    before, frame = spark.conf.get("spark.sql.shuffle.partitions"), type(spark.range(0))
    repartition = frame.repartition
    monkeypatch.setattr("ridgeline.runtime.ROWS", 1000, raising=False)
    monkeypatch.setattr(frame, "repartition", lambda self, n, *keys: dealt.append((n, keys)) or repartition(self, n, *keys))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        assert rows() == whole and whole
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert ("be", "bn", "deal") in {keys for _, keys in dealt} and min(n for n, _ in dealt) > 2


@pytest.mark.parametrize("name", ["plan_optimised_nodes", "g16_g18_route_search_naive"])
def test_nodes_are_loaded_once(spark, monkeypatch, name):
    """Only nodes of sanitised edges get an elevation, and the loaded nodes are
    read where they are stored, not made again out of the lines."""
    given, loaded, placed, optimise = [], [], el.node_elevation, ingest.optimise
    monkeypatch.setattr(el, "node_elevation", lambda n, *rest: given.append(n) or placed(n, *rest))
    monkeypatch.setattr(ingest, "optimise", lambda n, e: loaded.append((n, e)) or optimise(n, e))
    assert catalog.QUERIES[name](spark, SF).count() > 0
    (used,), ((nodes, edges),) = given, loaded
    ends = edges.select("src").union(edges.select("dst")).distinct().count()
    assert used.count() == nodes.count() == ends < fx.nodes(spark, SF).count()
    assert "lineitem" not in "".join(nodes.inputFiles())
    want = ingest.sanitise_nodes(ingest.stage_nodes(fx.nodes(spark, SF), fx.elevation(spark, SF), fx.bounds(spark, SF)), edges)
    assert sorted(map(str, nodes.collect())) == sorted(map(str, want.collect()))
