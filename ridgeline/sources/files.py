"""Files in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tile ids as in published raster file names: two letters, two digits, quadrant.
TILE_ID = r".*([A-Z][A-Z][0-9]{2}[ns][ew]).*"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def write_parquet(df: DataFrame, root: str, layer: str, dataset: str, partition_by: list[str] | None = None, compression: str = "snappy") -> str:
    """Overwrite ``root/layer/dataset``; folders come into being as needed."""
    path = f"{root}/{layer}/{dataset}"
    w = df.write.mode("overwrite").option("compression", compression)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return path


def read_parquet(spark: SparkSession, root: str, layer: str, dataset: str) -> DataFrame:
    path = f"{root}/{layer}/{dataset}"
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.parquet(path)


def locate_raw(spark: SparkSession, folder: str) -> tuple[str, str]:
    """The raw node and way files of a folder; either missing is an error."""
    fs, p = _fs(spark, folder)
    names = sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []
    found = []
    for kind in ("node", "way"):
        match = [n for n in names if n.endswith(f".{kind}.parquet")]
        if not match:
            raise FileNotFoundError(f"{folder}: no *.{kind}.parquet")
        found.append(f"{folder}/{match[0]}")
    return found[0], found[1]


def read_raw(spark: SparkSession, folder: str, skip: bool = False) -> tuple[DataFrame, DataFrame] | tuple[None, None]:
    if skip:
        return None, None
    nodes, ways = locate_raw(spark, folder)
    return spark.read.parquet(nodes), spark.read.parquet(ways)


def tile_id(path: Column) -> Column:
    """The tile id in a path, NULL if there is none."""
    return F.nullif(F.regexp_extract(path, TILE_ID, 1), F.lit(""))


def list_tiles(spark: SparkSession, folder: str, pattern: str = "*", required: bool = False) -> DataFrame:
    """``file_id, path`` of the files with a tile id; no file content is read."""
    schema = "file_id string, path string"
    if not exists(spark, folder):
        if required:
            raise FileNotFoundError(folder)
        return spark.createDataFrame([], schema)
    fs, p = _fs(spark, f"{folder}/{pattern}")
    paths = [(str(s.getPath()),) for s in (fs.globStatus(p) or [])]
    out = spark.createDataFrame(paths, "path string").withColumn("file_id", tile_id(F.col("path"))).where("file_id IS NOT NULL")
    if required and out.isEmpty():
        raise FileNotFoundError(f"{folder}: no tiles")
    return out.select("file_id", "path")


def tiles_to_load(available: DataFrame, loaded: DataFrame) -> DataFrame:
    return available.join(loaded.select("file_id"), "file_id", "left_anti")


def manifest(tiles: DataFrame) -> DataFrame:
    """One row with the sorted ids, to compare with the last run's."""
    return tiles.agg(F.concat_ws(",", F.array_sort(F.collect_set("file_id"))).alias("manifest"))


def changed(spark: SparkSession, path: str, now: str) -> bool:
    """Whether the text stored at ``path`` differs from ``now``."""
    if not exists(spark, path):
        return True
    rows = spark.read.text(path, wholetext=True).collect()
    return not rows or rows[0].value.rstrip("\n") != now


def remember(spark: SparkSession, path: str, now: str) -> None:
    """Store ``now`` at ``path``; call it after the run's output is complete."""
    spark.createDataFrame([(now,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def export_tsv(df: DataFrame, path: str) -> None:
    """Tab separated, no header, uncompressed; NULL is ``\\N``, as text loads
    expect. Nested columns must be literals already."""
    df.write.mode("overwrite").option("sep", "\t").option("header", False).option("nullValue", "\\N").option(
        "encoding", "UTF-8"
    ).option("compression", "none").option("quote", "").csv(path)


def serving_tables(nodes: DataFrame, edges: DataFrame, root: str) -> None:
    """Nodes and edges partitioned by ``ptn`` and sorted by latitude, so windows
    prune partitions and row groups."""
    for name, df in (("nodes", nodes), ("edges", edges)):
        by = ["ptn", "lat", "lon"] if name == "nodes" else ["ptn", "src_lat", "src_lon"]
        df.repartition("ptn").sortWithinPartitions(*by).write.mode("overwrite").partitionBy("ptn").parquet(f"{root}/{name}")


def gpx(name: Column, lats: str = "lats", lons: str = "lons", eles: str = "eles") -> Column:
    """A GPX 1.1 document with one route of type ``run``."""
    points = F.transform(
        F.arrays_zip(lats, lons, eles),
        lambda p: F.concat(
            F.lit('<rtept lat="'), p[lats].cast("string"), F.lit('" lon="'), p[lons].cast("string"), F.lit('"><ele>'),
            p[eles].cast("string"), F.lit("</ele></rtept>"),
        ),
    )
    head = '<?xml version="1.0" encoding="UTF-8"?><gpx version="1.1" creator="ridgeline" xmlns="http://www.topografix.com/GPX/1/1"><rte><name>'
    escaped = F.replace(F.replace(F.replace(name, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.concat(F.lit(head), escaped, F.lit("</name><type>run</type>"), F.array_join(points, ""), F.lit("</rte></gpx>"))


def routes_to_json(routes: DataFrame) -> Column:
    return F.to_json(F.struct(*routes.columns))


def routes_from_json(rows: DataFrame, column: str, schema: str) -> DataFrame:
    return rows.select(F.from_json(column, schema).alias("__r")).select("__r.*")


def job_status(status: Column, detail: Column) -> Column:
    """``{"status": ..., "detail": ...}`` of a job."""
    return F.to_json(F.struct(status.alias("status"), detail.alias("detail")))
