import zlib

import numpy as np
import pytest

from ridgeline.sources import pbf


def tag(**kw):
    return [{"key": k.encode(), "value": v.encode()} for k, v in kw.items()]


def test_numbers():
    values = [0, 1, 127, 128, 300, 2**32, 2**63, 2**64 - 1]
    assert pbf.packed(b"".join(map(pbf.varint, values))).tolist() == values
    assert pbf.packed(b"").tolist() == []
    ints = [0, -1, 1, -2, 2**40, -(2**40), 2**62, -(2**62)]
    assert pbf.signed(np.array([pbf._zigzag(i) for i in ints], dtype=np.uint64)).tolist() == ints
    assert [v for _, v in pbf.fields(pbf.message((1, 5), (2, b"abc"), (3, -1)))] == [5, b"abc", 2**64 - 1]


def test_block_round_trip():
    nodes = [(10, 51.0000001, -1.5, 1_700_000_000, tag(name="a")), (5, -51.25, 179.9999999, 5, []), (2**40, 0.0, 0.0, 1_800_000_000, tag(x="é", y=""))]
    ways = [(7, tag(highway="path"), 1_700_000_001, [{"index": 0, "nodeId": 10}, {"index": 1, "nodeId": 5}]), (8, [], None, [])]
    block = pbf.Block(pbf.encode_block(nodes, ways))
    got = list(block.nodes())
    assert [(g[0], g[3], g[4]) for g in got] == [(n[0], n[3], n[4]) for n in nodes]
    assert all(g[1:3] == pytest.approx(n[1:3], abs=1e-9) for g, n in zip(got, nodes))
    assert list(block.ways()) == ways


def test_plain_nodes_offsets_and_scales():
    z = pbf._zigzag
    node = pbf.message((1, z(-3)), (2, pbf.varint(1)), (3, pbf.varint(2)), (4, pbf.message((2, 90))), (8, z(400)), (9, z(-400)))
    strings = pbf.message((1, b""), (1, b"k"), (1, b"v"))
    block = pbf.Block(pbf.message((1, strings), (2, pbf.message((1, node))), (17, 1000), (18, 2000), (19, 5_000_000_000), (20, -1_000_000_000)))
    assert list(block.nodes()) == [(-3, pytest.approx(5.0004), pytest.approx(-1.0004), 180, [{"key": b"k", "value": b"v"}])]


def test_extract_in_many_blobs(spark, tmp_path):
    nodes = spark.range(3000).selectExpr("id * 3 AS id", "50 + id / 10000 AS latitude", "-2 + id / 5000 AS longitude", "1000 + id AS timestamp", f"cast(array() AS {pbf.TAGS}) AS tags")
    ways = spark.range(700).selectExpr(
        "id", f"cast(array(named_struct('key', cast('highway' AS binary), 'value', cast('path' AS binary))) AS {pbf.TAGS}) AS tags", "cast(id AS long) AS timestamp",
        "transform(sequence(0, cast(id % 5 AS int)), i -> named_struct('index', i, 'nodeId', (id + i) * 3)) AS nodes",
    )
    path = pbf.write_extract(nodes, ways, f"{tmp_path}/raw", rows=100)
    with open(path, "rb") as f:
        raw = f.read()
        kinds = [k for k, *_ in pbf.blobs(f, len(raw))]
    assert kinds[0] == b"OSMHeader" and len(kinds) >= 38
    n, w = pbf.read_extract(spark, f"{tmp_path}/raw")
    assert n.selectExpr("id", "round(latitude, 7) AS latitude", "round(longitude, 7) AS longitude", "timestamp", "tags").exceptAll(
        nodes.selectExpr("id", "round(latitude, 7) AS latitude", "round(longitude, 7) AS longitude", "timestamp", "tags")
    ).isEmpty() and n.count() == 3000
    assert w.exceptAll(ways.select(*w.columns)).isEmpty() and w.count() == 700


def test_which_file(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        pbf.locate(spark, f"{tmp_path}/none")
    (tmp_path / "a.osm.pbf").write_bytes(pbf.header_blob())
    assert pbf.locate(spark, str(tmp_path)).endswith("/a.osm.pbf")
    assert [df.count() for df in pbf.read_extract(spark, str(tmp_path))] == [0, 0]
    (tmp_path / "b.osm.pbf").write_bytes(b"")
    with pytest.raises(ValueError):
        pbf.locate(spark, str(tmp_path))


def test_bad_files(spark, tmp_path):
    for name, raw in (("cut", pbf.header_blob()[:-3]), ("feature", pbf.encode_blob(b"OSMHeader", pbf.message((4, b"Other"))))):
        folder = tmp_path / name
        folder.mkdir()
        (folder / "x.osm.pbf").write_bytes(raw)
        with pytest.raises(Exception, match="truncated|requires"):
            pbf.read_extract(spark, str(folder))
    with pytest.raises(ValueError):
        pbf.unpack_blob(pbf.message((4, zlib.compress(b"x"))))
