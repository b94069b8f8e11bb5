import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ridgeline.functions import profile as pf
from ridgeline.operators import elevation as el
from ridgeline.operators import tags
from ridgeline.plans import catalog, ingest
from ridgeline.sources import fixtures as fx


def test_step_metrics(spark):
    cases = [(0, 0, 30, 0, 4), (0, 0, 0, 20, 3), (0, 0, 10, 0, 2), (0, 0, 0, 0, 2), (5, 5, 8, 9, 2), (0, 0, 15, 0, 3), (0, 0, -15, 0, 3)]
    df = spark.createDataFrame([c[:4] for c in cases], "src_easting int, src_northing int, dst_easting int, dst_northing int")
    assert sorted(r.edge_steps for r in el.edge_steps(df).collect()) == sorted(c[4] for c in cases)


def test_explode_is_inclusive(spark):
    df = spark.createDataFrame([(1, 0, 0, 30, -20, 4), (2, 7, 7, 7, 7, 2)], "id int, src_easting int, src_northing int, dst_easting int, dst_northing int, edge_steps int")
    got = sorted((r.id, r.edge_inx, r.easting, r.northing) for r in el.explode_edges(df).collect())
    assert got == [(1, 0, 0, 0), (1, 1, 10, -7), (1, 2, 20, -13), (1, 3, 30, -20), (2, 0, 7, 7), (2, 1, 7, 7)]


@pytest.mark.parametrize(
    "profile,flat,gain,loss",
    [
        ([1.0], False, 0.0, 0.0),
        ([1.0, 3.0], False, 2.0, 0.0),
        ([3.0, 1.0, 2.0], False, 1.0, 2.0),
        ([0.0, 2.0, 1.0, 9.0, 8.0], False, 2.0, 2.0),
        ([0.0, 6.0, 0.0], False, 0.0, 0.0),
        ([0.0, 5.9, 0.0], True, 0.0, 0.0),
        ([], False, 0.0, 0.0),
    ],
)
def test_climb(spark, profile, flat, gain, loss):
    df = spark.createDataFrame([(profile, flat)], "elevation array<double>, is_flat boolean")
    r = el.elevation_changes(df).first()
    assert (r.elevation_gain, r.elevation_loss) == (gain, loss)


def test_implode(spark):
    rows = [(1, 2, 1, 0, 2, 30.0), (1, 2, 1, 0, 0, 10.0), (1, 2, 1, 0, 1, 20.0), (3, 4, 1, 1, 0, 1.0), (3, 4, 1, 1, 1, None)]
    df = spark.createDataFrame(rows, "src long, dst long, way_id long, way_inx int, edge_inx int, elevation double")
    got = {r.src: r.elevation for r in el.implode_edges(df, []).collect()}
    assert got == {1: [10.0, 20.0, 30.0], 3: None}


def test_melt_and_reject(spark):
    rows = [("a", 100, 200, 103, 202, [[1, 2, 3], [4, 5, None]]), ("b", 0, 0, 2, 2, [[1, 2]]), ("c", 0, 0, 2, 2, None)]
    df = spark.createDataFrame(rows, "file_id string, min_easting int, min_northing int, max_easting int, max_northing int, raster array<array<int>>")
    good, bad = el.valid_rasters(df)
    got = sorted((r.easting, r.northing, r.elevation) for r in el.melt_raster(good).collect() if r.elevation is not None)
    assert got == [(100, 200, 4.0), (100, 201, 1.0), (101, 200, 5.0), (101, 201, 2.0), (102, 201, 3.0)]
    assert sorted(r.file_id for r in bad.collect()) == ["b", "c"]


def test_bounds_from_xml(spark):
    xml = "<md><spatRepInfo><Georect><cornerPts><pos>85000.000000 4000.000000</pos><pos>90000.0 9000.0</pos><pos>85000.0 9000.0</pos></cornerPts><centerPt><pos>1 1</pos></centerPt></Georect></spatRepInfo></md>"
    df = spark.createDataFrame([(1, xml), (2, "<md/>")], "id int, xml string")
    a, b = el.bounds_from_xml(df).orderBy("id").collect()
    assert (a.min_easting, a.min_northing, a.max_easting, a.max_northing) == (85000, 4000, 90000, 9000)
    assert b.min_easting is None


def test_tiles_are_half_open(spark):
    bounds = spark.createDataFrame([("a", 0, 0, 5000, 5000), ("b", 5000, 0, 5500, 5000)], "file_id string, min_easting int, min_northing int, max_easting int, max_northing int")
    pts = spark.createDataFrame([(1, 0, 0), (2, 4999, 4999), (3, 5000, 10), (4, 5500, 10), (5, 10, 5000)], "id int, easting int, northing int")
    assert sorted((r.id, r.file_id) for r in el.assign_tiles(pts, bounds).collect()) == [(1, "a"), (2, "a"), (3, "b")]


def test_expressions(spark):
    df = spark.createDataFrame([([1.0, None, 2.5], {"a": 1.0}, 12345.0, 1234.4)], "x array<double>, m map<string,double>, d double, g double")
    r = df.select(
        pf.array_literal(F.col("x")).alias("lit"), pf.add_surface(F.col("m"), F.lit("a"), F.lit(2.0)).alias("a"),
        pf.add_surface(F.col("m"), F.lit(None).cast("string"), F.lit(2.0)).alias("b"), pf.card_text("d", "g").alias("card"), pf.whole_or_null(F.col("x")).alias("w"),
    ).first()
    assert r.lit == "{1.0,NULL,2.5}" and r.a == {"a": 3.0} and r.b == {"a": 1.0, "unclassified": 2.0}
    assert r.card == "12.3 km, 1,234 m" and r.w is None


def test_profiles_against_samples(spark):
    """Profiles by square are those of every sample joined with its cell, across
    squares, in all directions, west and south of zero too."""
    rnd = random.Random(3)
    cells = [(e, n, float((e * 7 + n * 13) % 97)) for e in range(-200, 300, 1) for n in range(-150, 150) if not (50 <= e < 60 and 20 <= n < 40)]
    elevation = spark.createDataFrame(cells + [(0, 0, None), (1, 1, -5.0)], "easting int, northing int, elevation double")
    at = lambda: (rnd.randrange(-200, 300), rnd.randrange(-150, 150))
    rows = [(i, i + 1, i % 3, i, *at(), *at()) for i in range(400)]
    rows += [(900, 901, 1, 1, 5, -140, 5, 140), (902, 903, 1, 1, -190, 7, 290, 7), (904, 905, 1, 1, 127, 127, 129, 129), (906, 907, 1, 1, 5, 5, 5, 5), (908, 909, 1, 1, 9000, 0, 9100, 0), (910, 911, 1, 1, -128, -128, 128, 128)]
    edges = spark.createDataFrame(rows, "src long, dst long, way_id long, way_inx int, src_easting int, src_northing int, dst_easting int, dst_northing int")
    samples = el.sample_elevation(el.explode_edges(el.edge_steps(edges)), el.distinct_elevation(elevation))
    want = {(r.src, r.way_inx): r.elevation for r in el.implode_edges(samples, []).collect()}
    got = {(r.src, r.way_inx): r.elevation for r in el.profiles(edges.repartition(3), elevation).collect()}
    assert got == want and sum(v is None for v in want.values()) > 5 and len(want) == 406
    assert el.profiles(edges.limit(0), elevation).count() == 0
    assert all(r.elevation is None for r in el.profiles(edges, elevation.limit(0)).collect())


def test_crowded_squares_are_dealt(spark, monkeypatch):
    """However many edges cross a square, a group holds about ``GROUP`` of them."""
    rnd = random.Random(5)
    at = lambda: (rnd.randrange(100), rnd.randrange(100))
    rows = [(i, i + 1, i % 9, i, *at(), *at()) for i in range(3000)] + [(9000, 9001, 1, 1, 300, 300, 340, 300)]
    edges = spark.createDataFrame(rows, "src long, dst long, way_id long, way_inx int, src_easting int, src_northing int, dst_easting int, dst_northing int")
    cells = [(e, n, float((e * 7 + n * 13) % 97)) for e in range(100) for n in range(100) if e != 50 or n > 9]
    elevation = spark.createDataFrame(cells + [(e, 300, 1.0) for e in range(300, 341)], "easting int, northing int, elevation double")
    heights = el._heights

    def bounded(key, edges, cells):
        assert edges.num_rows <= 600, f"{edges.num_rows} edges in a group"
        return heights(key, edges, cells)

    monkeypatch.setattr(el, "_heights", bounded)
    monkeypatch.setattr(el, "GROUP", 300, raising=False)
    samples = el.sample_elevation(el.explode_edges(el.edge_steps(edges)), elevation)
    want = {(r.src, r.way_inx): r.elevation for r in el.implode_edges(samples, []).collect()}
    got = [((r.src, r.way_inx), r.elevation) for r in el.profiles(edges, elevation).collect()]
    assert len(got) == 3001 and dict(got) == want and sum(v is None for v in want.values()) > 5


def test_long_edges_are_sampled_in_their_square_only():
    n, far = 500, 400_000
    names = [*el._KEY, "edge_steps", "src_easting", "src_northing", "dst_easting", "dst_northing"]
    ids = np.arange(n, dtype=np.int64)
    columns = dict(zip(names, [ids, ids, ids, ids.astype(np.int32), np.full(n, far // 5 + 1), np.full(n, -far), np.full(n, 7), np.full(n, far), np.full(n, 7)], strict=True))
    tracemalloc.start()
    out = el._sampled(columns, 0, 0, np.ones((el.SQUARE, el.SQUARE)))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.num_rows == n and {len(h) for h in out["heights"].to_pylist()} == {13} and most < 20e6


#: Queries that go through profiles, each of which once held a square's edges at once.
CROWDED = ["g21_g24_route_search_fuzzy", "plan_f12_optimised_edges", "plan_sanitised_edges", "f2_f15_drop_without_elevation", "g16_g18_route_search_naive", "plan_optimised_nodes"]


@pytest.mark.parametrize("name", CROWDED)
def test_queries_deal_crowded_squares(spark, monkeypatch, name):
    """The same rows whether a square's edges make one group or many, none too large."""
    heights, run = el._heights, lambda: sorted(map(str, catalog.QUERIES[name](spark, "/root/testdata/sf0.001").collect()))
    want = run()

    def bounded(key, edges, cells):
        assert edges.num_rows <= 200, f"{edges.num_rows} edges in a group"
        return heights(key, edges, cells)

    monkeypatch.setattr(el, "_heights", bounded)
    monkeypatch.setattr(el, "GROUP", 100, raising=False)
    assert run() == want and want


@pytest.fixture
def few_partitions(spark, monkeypatch):
    """A session that asks for two partitions, and partitions of 500 rows."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    monkeypatch.setattr("ridgeline.runtime.ROWS", 500, raising=False)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def dealt_over(df):
    """The least number of partitions of a shuffle by a key in the plan."""
    return min(int(n) for n in re.findall(r"hashpartitioning\([^()]*, (\d+)\)", df._jdf.queryExecution().executedPlan().toString()))


def test_many_edges_are_spread(spark, few_partitions):
    """Partitions go with the counted edges, not with the session's number."""
    rnd = random.Random(6)
    at = lambda: (rnd.randrange(300), rnd.randrange(300))
    rows = [(i, i + 1, i % 9, i, *at(), *at()) for i in range(2000)]
    edges = spark.createDataFrame(rows, "src long, dst long, way_id long, way_inx int, src_easting int, src_northing int, dst_easting int, dst_northing int")
    elevation = spark.createDataFrame([(e, n, float((e * 7 + n * 13) % 97)) for e in range(300) for n in range(300) if e != 50 or n > 99], "easting int, northing int, elevation double")
    samples = el.sample_elevation(el.explode_edges(el.edge_steps(edges)), elevation)
    want = {(r.src, r.way_inx): r.elevation for r in el.implode_edges(samples, []).collect()}
    out = el.tag_edges(edges, elevation)
    assert dealt_over(out) >= 4
    got = [((r.src, r.way_inx), r.elevation) for r in out.collect()]
    assert len(got) == 2000 and dict(got) == want


def test_nodes_are_spread_with_their_cells(spark, few_partitions):
    """Cells that lie by place already, over few partitions, do not bring the
    spread nodes back to as few."""
    nodes = spark.range(4001).selectExpr("id", "cast(id % 90 as int) AS easting", "cast(id % 70 as int) AS northing")
    cells = spark.range(3600).selectExpr("cast(id div 60 as int) AS easting", "cast(id % 60 as int) AS northing", "cast(id as double) AS elevation")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        placed = el.node_elevation(nodes, el.distinct_elevation(cells), 4001)
        assert placed.rdd.getNumPartitions() == 9
        at = {r.id: r.elevation for r in placed.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    known = lambda i: i % 90 < 60 and i % 70 < 60
    assert at == {i: float(i % 90 * 60 + i % 70) if known(i) else None for i in range(4001)}


def test_a_group_is_sampled_in_small_deals():
    """What sampling a group holds besides its edges and profiles stays small."""
    n = 1 << 15
    ids = np.arange(n, dtype=np.int64)
    flat = {"src": ids, "dst": ids, "way_id": ids, "way_inx": ids.astype(np.int32), "edge_steps": np.full(n, 13)}
    ends = {"src_easting": 1, "src_northing": 2, "dst_easting": 120, "dst_northing": 100}
    edges = pa.table(flat | {c: np.full(n, v, dtype=np.int64) for c, v in ends.items()})
    square = np.arange(el.SQUARE)
    cells = pa.table({"easting": np.repeat(square, el.SQUARE), "northing": np.tile(square, el.SQUARE), "elevation": np.ones(el.SQUARE**2)})
    el._heights((pa.scalar(0), pa.scalar(0), pa.scalar(0)), edges[:9], cells)  # modules that Arrow loads late do not count
    tracemalloc.start()
    out = el._heights((pa.scalar(0), pa.scalar(0), pa.scalar(0)), edges, cells)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.num_rows == n and {len(h) for h in out["heights"].to_pylist()} == {13} and most < 25e6


def test_only_safe_edges_are_sampled(spark, monkeypatch):
    """What the rules drop gets no profile, tags do not travel, and the rows are
    those of all edges staged and then sanitised."""
    sf, given, profiles = "/root/testdata/sf0.001", [], el.profiles
    edges, cells, tiles = fx.edges(spark, sf), fx.elevation(spark, sf), fx.bounds(spark, sf)
    want = ingest.sanitise_edges(ingest.stage_edges(edges, cells, tiles), F.lit(1.0))
    names = ["src", "dst", "way_id", "way_inx", "highway", "surface", "elevation_gain", "elevation_loss"]
    want = sorted(map(str, want.select(*names).collect()))
    monkeypatch.setattr(el, "profiles", lambda e, *rest: given.append(e) or profiles(e, *rest))
    assert sorted(map(str, catalog.QUERIES["plan_sanitised_edges"](spark, sf).collect())) == want and want
    safe = tags.drop_unsafe(tags.keep_accessible(tags.flag_footways(edges))).count()
    assert [e.count() for e in given] == [safe] and safe < edges.count() and "tags" not in given[0].columns


def test_ways_are_dealt_once(spark):
    """Both windows along a way share a shuffle, which goes with the lines."""
    plan = fx.plain_edges(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
