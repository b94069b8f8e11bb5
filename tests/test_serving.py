from ridgeline.sources import files, serving


def test_table_ddl(spark):
    got = serving.table_ddl("edges")
    assert got[1] == "DROP TABLE IF EXISTS routing.edges"
    assert got[2].startswith("CREATE TABLE routing.edges (src bigint, dst bigint, src_lat float,")
    assert "lats float ARRAY" in got[2] and got[2].endswith("ptn text NOT NULL, PRIMARY KEY (src, dst, ptn)) PARTITION BY LIST (ptn)")
    assert got[3:] == [
        "CREATE INDEX edges_src_lat_src_lon_inx ON routing.edges (src_lat, src_lon)",
        "CREATE INDEX edges_highway_inx ON routing.edges (highway)",
        "CREATE INDEX edges_surface_inx ON routing.edges (surface)",
    ]


def test_partitions_and_loads(spark, tmp_path):
    rows = {(r.name, r.ptn): r.statement for r in serving.partition_ddl(spark).collect()}
    assert len(rows) == 2 * 13 * 17
    assert rows["nodes", "51_n1"] == "CREATE TABLE routing.nodes_51_n1 PARTITION OF routing.nodes FOR VALUES IN ('51_n1')"
    assert ("edges", "48_n15") in rows and ("edges", "60_1") in rows
    one = (1, 2, 50.0, -1.0, "track", None, 1.0, 2.0, 3.0, [1.0, None], [], None, [0.0], "50_n1")
    df = spark.createDataFrame([one], serving.layer_schema("optimised", "edges")).coalesce(1)
    files.export_tsv(serving.text_rows(df, "edges"), f"{tmp_path}/edges")
    loads = serving.load_scripts(spark, f"{tmp_path}/edges", "edges").collect()
    assert len(loads) == 1 and loads[0].statement.startswith("COPY routing.edges (src, dst, src_lat,")
    with open(loads[0].path.removeprefix("file:")) as f:
        assert f.read() == "1\t2\t50.0\t-1.0\ttrack\t\\N\t1.0\t2.0\t3.0\t{1.0,NULL}\t{}\t\\N\t{0.0}\t50_n1\n"
    assert serving.load_scripts(spark, f"{tmp_path}/none", "edges").count() == 0
