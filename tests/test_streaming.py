from ridgeline.operators.incremental import SnapshotTable
from ridgeline.schema import layer_schema
from ridgeline.streaming.landing import stage_stream, upsert_batch

KEYS = ["id"]


def rows(spark, data):
    return spark.createDataFrame(data, layer_schema("staging", "nodes"))


def test_stream_stages_files(spark, tmp_path):
    root = str(tmp_path)
    schema = layer_schema("staging", "nodes")
    table = SnapshotTable(spark, f"{root}/staged", schema)
    rows(spark, [(1, 1.0, 1.0, 5.0, 10), (2, 1.0, 1.0, 5.0, 10)]).write.parquet(f"{root}/landing/a")
    stage_stream(spark, f"{root}/landing/*", table, KEYS, f"{root}/cp", schema).awaitTermination()
    assert table.read().count() == 2
    rows(spark, [(2, 1.0, 1.0, 6.0, 11), (2, 1.0, 1.0, 7.0, 9), (3, 1.0, 1.0, 8.0, None)]).write.parquet(f"{root}/landing/b")
    stage_stream(spark, f"{root}/landing/*", table, KEYS, f"{root}/cp", schema).awaitTermination()
    assert sorted((r.id, r.elevation) for r in table.read().collect()) == [(1, 5.0), (2, 6.0), (3, 8.0)]
    versions = table.versions()
    upsert_batch(table, KEYS, lambda x: x)(rows(spark, [(3, 1.0, 1.0, 8.0, None)]), 9)
    assert table.versions() == versions
