import pytest

from ridgeline.operators import network as net
from ridgeline.operators import tags as tg


def frame(spark, rows, extra=""):
    return spark.createDataFrame(rows, f"inx int, tags map<string,string>{extra}")


def test_unpack_tags(spark):
    b = lambda s: bytearray(s.encode())
    rows = [(1, [(b("a"), b("1")), (b("b"), b("2"))]), (2, [(b("a"), b("old")), (b("a"), b("new"))]), (3, []), (4, None)]
    df = spark.createDataFrame(rows, "inx int, tags array<struct<key:binary,value:binary>>")
    got = {r.inx: r.tags for r in tg.unpack_tags(df).collect()}
    assert got == {1: {"a": "1", "b": "2"}, 2: {"a": "new"}, 3: {}, 4: None}


@pytest.mark.parametrize(
    "tags,explicit,separate",
    [
        ({}, False, False),
        ({"foot": "yes"}, True, False),
        ({"foot": "no"}, False, False),
        ({"sidewalk": "separate"}, False, True),
        ({"foot": "yes", "sidewalk": "separate"}, True, True),
        ({"sidewalk:left": "no", "sidewalk:right": "both"}, True, False),
        ({"sidewalk:both": '"separate"'}, False, True),
    ],
)
def test_footways(spark, tags, explicit, separate):
    r = tg.flag_footways(frame(spark, [(1, tags)])).first()
    assert (r.explicit_footway, r.separate_footway) == (explicit, separate)


def test_access(spark):
    cases = [({"access": "yes"}, False), ({"access": "permissive"}, False), ({"access": "designated"}, False), ({}, False), ({"access": "no"}, False), ({"access": "no"}, True), ({"access": "private"}, False)]
    df = frame(spark, [(i, t, e) for i, (t, e) in enumerate(cases)], ", explicit_footway boolean")
    assert sorted(r.inx for r in tg.keep_accessible(df).collect()) == [0, 1, 2, 3, 5]


def test_unsafe(spark):
    cases = [
        ({"highway": "motorway"}, False, False, False),
        ({"highway": "motorway_link"}, True, False, False),
        ({"highway": "path", "junction": "roundabout"}, False, False, False),
        ({"highway": "primary", "maxspeed": "60 mph"}, False, False, False),
        ({"highway": "primary", "maxspeed": "60 mph"}, True, False, True),
        ({"highway": "primary", "maxspeed": "30 mph"}, False, False, True),
        ({"highway": "primary", "maxspeed": "50"}, False, False, False),
        ({"highway": "primary", "maxspeed": "none"}, False, False, True),
        ({"highway": "primary", "maxspeed": "1000"}, False, False, False),
        ({"highway": "path"}, True, True, False),
        ({}, False, False, True),
    ]
    df = frame(spark, [(i, t, e, s) for i, (t, e, s, _) in enumerate(cases)], ", explicit_footway boolean, separate_footway boolean")
    assert sorted(r.inx for r in tg.drop_unsafe(df).collect()) == [i for i, c in enumerate(cases) if c[3]]


def test_flat_and_oneway(spark):
    cases = [({"bridge": "no"}, True, False), ({"tunnel": "yes"}, True, False), ({"oneway": "yes"}, False, True), ({"oneway": "no"}, False, False), ({"oneway": "-1"}, False, True), ({}, False, False)]
    rows = tg.flag_oneway(tg.flag_flat(frame(spark, [(i, c[0]) for i, c in enumerate(cases)]))).orderBy("inx").collect()
    assert [(r.is_flat, r.oneway) for r in rows] == [c[1:] for c in cases]


def test_reverse_edges(spark):
    schema = "way_id long, way_inx int, src long, dst long, src_lat double, dst_lat double, oneway boolean, elevation_gain double, elevation_loss double"
    df = spark.createDataFrame([(1, 2, 10, 20, 1.0, 2.0, True, 5.0, 6.0), (2, 3, 30, 40, 3.0, 4.0, False, 7.0, 8.0)], schema)
    got = sorted(tuple(r) for r in net.reverse_edges(df).collect())
    assert got == [(-2, -3, 40, 30, 4.0, 3.0, 8.0, 7.0), (1, 2, 10, 20, 1.0, 2.0, 5.0, 6.0), (2, 3, 30, 40, 3.0, 4.0, 7.0, 8.0)]


def test_degrees(spark):
    # A line, a pair both ways, and a node that two parallel edges reach.
    e = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (5, 4), (6, 7), (6, 7)], "src long, dst long")
    got = {r.id: (r.in_degree, r.out_degree, r.degree) for r in net.node_degrees(e).collect()}
    assert got == {1: (0, 1, 1), 2: (1, 1, 2), 3: (1, 0, 1), 4: (1, 1, 1), 5: (1, 1, 1), 6: (0, 2, 1), 7: (2, 0, 1)}


def test_way_edges(spark):
    rows = [(1, [(0, 5), (2, 7), (1, 6)], 9), (2, [(0, 8), (1, 9)], 9), (3, [(0, 1)], 9)]
    w = spark.createDataFrame(rows, "id long, nodes array<struct<index:int,nodeId:long>>, timestamp long")
    got = sorted((r.way_id, r.way_inx, r.src, r.dst) for r in net.way_edges(w).collect())
    assert got == [(1, 0, 5, 6), (1, 1, 6, 7), (2, 0, 8, 9)]
