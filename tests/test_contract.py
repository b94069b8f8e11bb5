from ridgeline.operators import contract as ct
from ridgeline.plans import ingest

EDGE = (
    "src long, dst long, way_id long, way_inx int, src_lat double, src_lon double, dst_lat double, dst_lon double, "
    "highway string, surface string, elevation_gain double, elevation_loss double, distance double"
)


def edges(spark, pairs, highway=lambda i: "path"):
    rows = [(s, d, w, i, float(s), -float(s), float(d), -float(d), highway(i), "grass" if i % 2 else None, 1.0, 2.0, 10.0) for s, d, w, i in pairs]
    return spark.createDataFrame(rows, EDGE)


def nodes(spark, ids):
    return spark.createDataFrame([(i, float(i), -float(i), i / 10.0) for i in ids], "id long, lat double, lon double, elevation double")


def test_chain_through_links_only(spark):
    # 1-2-3-4-5 is one way; at 3 another way crosses (6-3-7). 2 and 4 are links.
    pairs = [(1, 2, 1, 0), (2, 3, 1, 1), (3, 4, 1, 2), (4, 5, 1, 3), (6, 3, 2, 0), (3, 7, 2, 1)]
    loop = [(5, 6, 3, 0), (7, 1, 4, 0)]
    n, e = ingest.optimise(nodes(spark, range(1, 9)), edges(spark, pairs + loop))
    got = {(r.src, r.dst): r for r in e.collect()}
    assert set(got) == {(1, 3), (3, 5), (6, 3), (3, 7), (5, 6), (7, 1)}
    r = got[1, 3]
    assert (r.distance, r.elevation_gain, r.elevation_loss) == (20.0, 2.0, 4.0)
    assert r.lats == [1.0, 2.0, 3.0] and r.lons == [-1.0, -2.0, -3.0] and r.eles == [0.1, 0.2, 0.3] and r.dists == [0.0, 10.0, 10.0]
    assert r.highway == "path" and r.surface == "grass" and r.ptn == "1_n1"
    assert got[3, 7].surface == "grass" and got[6, 3].surface == "unclassified"
    assert sorted(x.id for x in n.collect()) == [1, 3, 5, 6, 7]


def test_dead_ends_go_once(spark):
    pairs = [(1, 2, 1, 0), (2, 3, 2, 0), (3, 1, 3, 0), (3, 4, 4, 0), (4, 5, 5, 0)]
    _, e = ingest.optimise(nodes(spark, range(1, 6)), edges(spark, pairs))
    assert sorted((r.src, r.dst) for r in e.collect()) == [(1, 2), (2, 3), (3, 1), (3, 4)]


def test_mixed_kinds(spark):
    pairs = [(1, 2, 1, 0), (2, 3, 1, 1), (3, 1, 2, 0)]
    _, e = ingest.optimise(nodes(spark, range(1, 4)), edges(spark, pairs, lambda i: f"kind{i}"))
    got = {(r.src, r.dst): r.highway for r in e.collect()}
    assert got == {(1, 3): "unclassified", (3, 1): "kind0"}


def test_way_end_flags(spark):
    df = spark.createDataFrame([(1, 1, 5), (2, 2, 0), (3, 2, 1), (4, 3, -2), (5, 3, -1), (6, 3, 0)], "id int, way_id long, way_inx int")
    got = {r.id: (r.way_start_flag, r.way_end_flag) for r in ct.way_ends(df).collect()}
    assert got == {1: (1, 1), 2: (1, 0), 3: (0, 1), 4: (1, 0), 5: (0, 0), 6: (0, 1)}


def test_one_shuffle_by_way(spark):
    """After the nodes are joined, everything along a way shares one exchange
    and one sort."""
    e = edges(spark, [(1, 2, 1, 0), (2, 3, 1, 1), (3, 1, 2, 0)])
    flagged = ct.endpoint_flags(e, nodes(spark, range(1, 4)).selectExpr("*", "1 AS contract_flag", "0 AS dead_end_flag"))
    stored = spark.createDataFrame(flagged.collect(), flagged.schema)
    plan = ct.fill_chains(ct.chain_ends(ct.way_ends(stored)))._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("+- == Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning(way_id") == 1 and plan.count("Sort [way_id") == 1


def test_many_edges_are_spread(spark, monkeypatch):
    """Partitions go with the counted edges, and the result does not."""
    pairs = [(i, i + 1, i // 40, i) for i in range(1, 400)] + [(i, i + 7, 1000 + i, 0) for i in range(1, 393, 13)]
    n, e = nodes(spark, range(1, 401)), edges(spark, pairs)
    rows = lambda df: sorted(map(str, df.collect()))
    whole = [rows(df) for df in ingest.optimise(n, e)]
    before, dealt = spark.conf.get("spark.sql.shuffle.partitions"), []
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    monkeypatch.setattr("ridgeline.runtime.ROWS", 50, raising=False)
    frame = type(e)
    repartition = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, n, *keys: dealt.append((n, keys)) or repartition(self, n, *keys))
    try:
        spread = [rows(df) for df in ingest.optimise(n, e)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert spread == whole and len(whole[1]) > 20
    assert {keys for _, keys in dealt} == {("id",), ("src",), ("dst",), ("way_id",), ("chain_src", "chain_dst")} and min(n for n, _ in dealt) >= 8
