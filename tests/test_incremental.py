import os

import pytest
from pyspark.sql import functions as F

from ridgeline.operators import incremental as inc
from ridgeline.schema import layer_schema, map_to_schema
from ridgeline.sources import files

NODES = "id long, timestamp long, easting int, northing int"


def test_changes_and_removals(spark):
    new = spark.createDataFrame([(2, 5, 0, 0), (3, 5, 0, 0), (4, 6, 0, 0), (5, None, 0, 0), (6, None, 0, 0)], NODES)
    old = spark.createDataFrame([(1, 5), (3, 5), (4, 5), (6, None)], "id long, timestamp long")
    assert sorted(r.id for r in inc.changes(new, old, ["id"]).collect()) == [2, 4, 5]
    assert [r.id for r in inc.removals(old, new, ["id"]).collect()] == [1]


def test_refresh_without_updates_still_deletes(spark):
    staged = spark.createDataFrame([(1, 5, "a"), (2, 5, "b")], "id long, timestamp long, v string")
    landed = spark.createDataFrame([(2, 5)], "id long, timestamp long")
    out = inc.refresh(staged, landed, ["id"], lambda rows: rows.withColumn("v", F.lit("new")))
    assert [tuple(r) for r in out.collect()] == [(2, 5, "b")]
    landed = spark.createDataFrame([(2, 6), (3, 1)], "id long, timestamp long")
    out = inc.refresh(staged, landed, ["id"], lambda rows: rows.withColumn("v", F.lit("new")))
    assert sorted(tuple(r) for r in out.collect()) == [(2, 6, "new"), (3, 1, "new")]


def test_snapshots(spark, tmp_path):
    schema = layer_schema("staging", "nodes")
    t = inc.SnapshotTable(spark, f"{tmp_path}/snap", schema)
    assert t.read().count() == 0 and t.versions() == []
    one = map_to_schema(spark.createDataFrame([(1, 2.0)], "id long, lat double").withColumns({c: F.lit(None) for c in ("lon", "elevation", "timestamp")}), schema)
    assert t.write(one) == 1
    assert t.write(t.read().unionByName(one), files=1) == 2
    assert t.read().count() == 2 and t.read(1).count() == 1
    t.vacuum()
    assert t.versions() == [2]
    with pytest.raises(FileNotFoundError):
        t.read(1)


def test_two_writers_of_one_version(spark, tmp_path):
    """The second of two writers that began with one version fails, and nothing
    that either stored is lost or half seen."""
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    t = inc.SnapshotTable(spark, f"{tmp_path}/snap", rows(1).schema)
    base = t.write(rows(1))
    assert t.write(t.read().unionByName(rows(2)), base=base) == 2
    with pytest.raises(inc.ConcurrentWrite):
        t.write(rows(1, 3), base=base)
    with pytest.raises(inc.ConcurrentWrite):
        t.change(["id"], rows(3), base=base)
    assert t.versions() == [1, 2] and sorted(r.id for r in t.read().collect()) == [1, 2]
    assert t.change(["id"], rows(3)) == 3 and sorted(r.id for r in t.read().collect()) == [1, 2, 3]
    t.vacuum()
    assert t.versions() == [3] and t.read().count() == 3
    left = [n for n in os.listdir(f"{tmp_path}/snap") if n.startswith("data-")]
    assert len(left) == 1


def test_a_change_rewrites_what_it_touches(spark, tmp_path):
    data = [(i, i * 10, f"p {i % 5}") for i in range(50)] + [(50, 0, None)]
    df = spark.createDataFrame(data, "id long, v long, place string")
    t = inc.SnapshotTable(spark, f"{tmp_path}/parts", df.schema, F.col("place"))
    t.write(df)
    before = t.partitions()
    assert len(before) == 6
    # One row changes, one moves, one is new, one goes.
    updates = spark.createDataFrame([(1, -1, "p 1"), (6, -6, "p 2"), (99, 99, "p 9")], df.schema)
    t.change(["id"], updates, spark.createDataFrame([(11,)], "id long"))
    after = t.partitions()
    assert {p for p in before if before[p] != after[p]} == {"__part=p 1", "__part=p 2"}
    want = {i: (v, p) for i, v, p in data} | {1: (-1, "p 1"), 6: (-6, "p 2"), 99: (99, "p 9")}
    del want[11]
    assert {r.id: (r.v, r.place) for r in t.read().collect()} == want
    assert {r.id for r in t.read(1).collect()} == set(range(51))
    # A partition without rows is no longer listed, and nothing to do is no version.
    t.change(["id"], updates.limit(0), spark.createDataFrame([(99,), (50,)], "id long"))
    assert len(t.partitions()) == 5
    assert t.change(["id"], updates.limit(0), spark.createDataFrame([(12345,)], "id long")) == 3
    t.vacuum()
    del want[99], want[50]
    assert {r.id: (r.v, r.place) for r in t.read().collect()} == want


def test_spatial_chunk_is_stable(spark):
    df = spark.createDataFrame([(i, 1, (i * 7919) % 20000, (i * 104729) % 20000) for i in range(500)], NODES)
    a = [r.id for r in inc.spatial_chunk(df, ["id"], 100).collect()]
    assert a == [r.id for r in inc.spatial_chunk(df.repartition(7), ["id"], 100).collect()]


def test_files(spark, tmp_path):
    root = f"{tmp_path}/files"
    with pytest.raises(FileNotFoundError):
        files.read_parquet(spark, root, "landing", "nodes")
    with pytest.raises(FileNotFoundError):
        files.locate_raw(spark, root)
    with pytest.raises(FileNotFoundError):
        files.list_tiles(spark, root, required=True)
    assert files.list_tiles(spark, root).count() == 0 and files.read_raw(spark, root, skip=True) == (None, None)
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, v string")
    for name in ("tile_SU41ne", "tile_TQ01sw", "other"):
        df.write.parquet(f"{root}/tiles/{name}.parquet")
    tiles = files.list_tiles(spark, f"{root}/tiles", "*.parquet", required=True)
    assert sorted(r.file_id for r in tiles.collect()) == ["SU41ne", "TQ01sw"]
    assert files.manifest(tiles).first().manifest == "SU41ne,TQ01sw"
    files.export_tsv(df, f"{root}/tsv")
    assert sorted(r.value for r in spark.read.text(f"{root}/tsv").collect()) == ["1\ta", "2\t\\N"]


def test_serving_tables_prune(spark, tmp_path):
    n = spark.createDataFrame([(1, 50.0, -1.0, "50_n1"), (2, 51.0, -1.0, "51_n1")], "id long, lat double, lon double, ptn string")
    e = spark.createDataFrame([(1, 2, 50.0, -1.0, "50_n1")], "src long, dst long, src_lat double, src_lon double, ptn string")
    root = f"{tmp_path}/serve"
    files.serving_tables(n, e, root)
    got = spark.read.parquet(f"{root}/nodes").where("ptn = '51_n1'")
    assert [r.id for r in got.collect()] == [2]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "51_n1" in plan


def test_gpx_and_json(spark):
    df = spark.createDataFrame([("a<b", [1.0, 2.0], [3.0, 4.0], [5.0, 6.0])], "name string, lats array<double>, lons array<double>, eles array<double>")
    doc = df.select(files.gpx(F.col("name"))).first()[0]
    import xml.etree.ElementTree as ET

    rte = ET.fromstring(doc)[0]
    assert [c.tag.split("}")[1] for c in rte] == ["name", "type", "rtept", "rtept"]
    assert rte[0].text == "a<b" and rte[2].attrib == {"lat": "1.0", "lon": "3.0"}
    back = files.routes_from_json(df.select(files.routes_to_json(df).alias("j")), "j", "name string, lats array<double>, lons array<double>, eles array<double>")
    assert back.collect() == df.collect()
