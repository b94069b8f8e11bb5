"""The driver's tables seen as ways, nodes, tags and elevation.

Integer formulae of order and part keys, so that another engine computes the
same. The SQL texts give the same relations to DuckDB.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.runtime import spread

EASTING, NORTHING = "(({0}) * 37) % 499", "(({0}) * 91) % 491"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_lines: dict[str, int] = {}


def lines(spark: SparkSession, sf_dir: str) -> int:
    """How many order lines there are."""
    if sf_dir not in _lines:
        _lines[sf_dir] = table(spark, sf_dir, "lineitem").count()
    return _lines[sf_dir]


def way_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines are dealt by ``way_id`` once, and lie so for whatever goes along a
    way. They are narrow, so a partition takes four times as many."""
    order = Window.partitionBy("way_id").orderBy("l_linenumber", "part", "l_suppkey", "l_extendedprice", "l_shipdate")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("long").alias("way_id"), F.col("l_partkey").cast("long").alias("part"),
        "l_linenumber", "l_suppkey", "l_extendedprice", "l_shipdate",
    )
    rows = spread(rows, lines(spark, sf_dir) // 4, "way_id").select(
        "way_id",
        F.row_number().over(order).alias("way_inx"),
        "part",
        (F.unix_date(F.col("l_shipdate").cast("date")).cast("long") * 86400).alias("shipped"),
    )
    node = F.when(F.col("part") % 4 == 0, F.col("part")).otherwise(1000000 + F.col("way_id") * 100 + F.col("way_inx"))
    return rows.select("way_id", "way_inx", node.alias("node"), "shipped")


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested: ``id, tags, timestamp, nodes array<struct<index,nodeId>>``."""
    node = F.struct(F.col("way_inx").alias("index"), F.col("node").alias("nodeId"))
    out = way_nodes(spark, sf_dir).groupBy(F.col("way_id").alias("id")).agg(
        F.max("shipped").alias("timestamp"), F.sort_array(F.collect_list(node)).alias("nodes")
    )
    return out.withColumn("tags", way_tags("id"))


def way_tags(key: str) -> Column:
    def pick(tag: str, value: str):
        return F.expr(f"CASE WHEN ({value}) IS NOT NULL THEN named_struct('key', '{tag}', 'value', ({value})) END")

    foot = f"CASE {key} % 7 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'separate' END"
    entries = [
        pick("highway", f"element_at(array('footway', 'residential', 'motorway', 'track', 'primary'), cast({key} % 5 as int) + 1)"),
        pick("surface", f"CASE {key} % 3 WHEN 1 THEN 'asphalt' WHEN 2 THEN 'grass' END"),
        pick("foot", foot),
        pick("sidewalk", f"CASE ({key} + 3) % 7 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'separate' END"),
        pick("access", f"CASE {key} % 11 WHEN 0 THEN 'no' WHEN 1 THEN 'permissive' END"),
        pick("maxspeed", f"CASE {key} % 13 WHEN 0 THEN '70 mph' WHEN 1 THEN '30 mph' WHEN 2 THEN 'none' END"),
        pick("oneway", f"CASE {key} % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END"),
        pick("bridge", f"CASE WHEN {key} % 17 = 0 THEN 'yes' END"),
        pick("junction", f"CASE WHEN {key} % 19 = 0 THEN 'roundabout' END"),
    ]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e.isNotNull()))


def plain_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``src, dst, way_id, way_inx, timestamp`` without self-loops."""
    order = Window.partitionBy("way_id").orderBy("way_inx")
    e = way_nodes(spark, sf_dir).select(
        "way_id", "way_inx", F.col("node").alias("src"), F.lead("node").over(order).alias("dst"),
        F.max("shipped").over(Window.partitionBy("way_id")).alias("timestamp"),
    )
    return e.where("dst IS NOT NULL AND src <> dst").select("src", "dst", "way_id", "way_inx", "timestamp")


def place(df: DataFrame, key: str, prefix: str = "") -> DataFrame:
    """Grid and geographic coordinates of a node id."""
    e, n = (F.expr(f"cast({x.format(key)} as int)") for x in (EASTING, NORTHING))
    return df.withColumns(
        {f"{prefix}easting": e, f"{prefix}northing": n, f"{prefix}lat": F.lit(50) + n / 1000.0, f"{prefix}lon": F.lit(-2) + e / 1000.0}
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed edges: coordinates of both ends and tags."""
    out = place(place(plain_edges(spark, sf_dir), "src", "src_"), "dst", "dst_")
    return out.withColumn("tags", way_tags("way_id"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, lat, lon, easting, northing, timestamp`` of every way node."""
    found = spread(way_nodes(spark, sf_dir), lines(spark, sf_dir) // 4, "node")
    ids = found.groupBy(F.col("node").alias("id")).agg(F.max("shipped").alias("timestamp"))
    return place(ids, "id").select("id", "lat", "lon", "easting", "northing", "timestamp")


#: Order lines for which the raster grows by a square of ``SIDE`` metres each way.
LINES, SIDE = 30_000, 500


_squares: dict[str, int] = {}


def squares(spark: SparkSession, sf_dir: str) -> int:
    """How many squares wide the raster is: its area grows with the tables."""
    if sf_dir not in _squares:
        _squares[sf_dir] = max(1, math.ceil(math.sqrt(lines(spark, sf_dir) / LINES)))
    return _squares[sf_dir]


BOUNDS = [("A", 0, 0, 250, 250), ("B", 250, 0, 500, 250), ("C", 0, 250, 250, 500), ("D", 250, 250, 400, 500), ("E", 400, 250, 500, 400)]


def bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = squares(spark, sf_dir)
    around = [(f"X{i}_{j}", i * SIDE, j * SIDE, (i + 1) * SIDE, (j + 1) * SIDE) for i in range(k) for j in range(k) if i or j]
    return spark.createDataFrame(BOUNDS + around, "file_id string, min_easting int, min_northing int, max_easting int, max_northing int")


def elevation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells by tile. All ways lie in the first square, which lacks its
    north-eastern corner; the country around it only a load without pruning
    makes: a join on ``file_id`` passes to the tiles, as with a table
    partitioned by them."""
    line = lambda a, b: F.sequence(F.col(a), F.col(b) - 1)
    rows = bounds(spark, sf_dir).select("file_id", "min_easting", "max_easting", F.explode(line("min_northing", "max_northing")).alias("northing"))
    cells = rows.select("file_id", "northing", F.explode(line("min_easting", "max_easting")).alias("easting"))
    return cells.select("easting", "northing", F.expr("cast(((easting * 2 + northing * 3) % 1000) div 10 as double)").alias("elevation"), "file_id")


def staged_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An older state: every tenth way missing, every tenth older, and some
    edges that are no longer landed."""
    e = plain_edges(spark, sf_dir)
    old = e.where("way_id % 10 <> 0").withColumn("timestamp", F.expr("timestamp - CASE WHEN way_id % 10 = 1 THEN 1 ELSE 0 END"))
    gone = e.where("way_id % 10 = 2").withColumns({"src": -F.col("src"), "dst": -F.col("dst")})
    return old.unionByName(gone)


# --------------------------------------------------------------------------
# the same relations in DuckDB's SQL


def tag_sql(key: str) -> str:
    return f"""
  CASE {key} % 5 WHEN 0 THEN 'footway' WHEN 1 THEN 'residential' WHEN 2 THEN 'motorway' WHEN 3 THEN 'track' ELSE 'primary' END AS highway,
  CASE {key} % 3 WHEN 1 THEN 'asphalt' WHEN 2 THEN 'grass' END AS surface,
  CASE {key} % 7 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'separate' END AS foot,
  CASE ({key} + 3) % 7 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'separate' END AS sidewalk,
  CASE {key} % 11 WHEN 0 THEN 'no' WHEN 1 THEN 'permissive' END AS access,
  CASE {key} % 13 WHEN 0 THEN '70 mph' WHEN 1 THEN '30 mph' WHEN 2 THEN 'none' END AS maxspeed,
  CASE {key} % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END AS oneway,
  CASE WHEN {key} % 17 = 0 THEN 'yes' END AS bridge,
  CASE WHEN {key} % 19 = 0 THEN 'roundabout' END AS junction"""


BASE_SQL = f"""
way_nodes AS (
  SELECT way_id, way_inx, shipped,
         CASE WHEN part % 4 = 0 THEN part ELSE 1000000 + way_id * 100 + way_inx END AS node
  FROM (
    SELECT l_orderkey::BIGINT AS way_id, l_partkey::BIGINT AS part, (l_shipdate::DATE - DATE '1970-01-01')::BIGINT * 86400 AS shipped,
           row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS way_inx
    FROM lineitem
  )
),
all_edges AS (
  SELECT node AS src, lead(node) OVER (PARTITION BY way_id ORDER BY way_inx) AS dst, way_id, way_inx,
         max(shipped) OVER (PARTITION BY way_id) AS timestamp
  FROM way_nodes
),
edges AS (SELECT * FROM all_edges WHERE dst IS NOT NULL AND src <> dst),
nodes AS (
  SELECT node AS id, max(shipped) AS timestamp, ((node * 37) % 499)::INT AS easting, ((node * 91) % 491)::INT AS northing,
         50 + ((node * 91) % 491) / 1000.0::DOUBLE AS lat, -2 + ((node * 37) % 499) / 1000.0::DOUBLE AS lon
  FROM way_nodes GROUP BY node
),
ways AS (SELECT DISTINCT way_id FROM way_nodes),
tags AS (SELECT way_id, {tag_sql("way_id")} FROM ways),
squares AS (SELECT greatest(1, ceil(sqrt(count(*) / {LINES}.0)))::INT AS k FROM lineitem),
elevation AS (
  SELECT e::INT AS easting, n::INT AS northing, (((e * 2 + n * 3) % 1000) // 10)::DOUBLE AS elevation
  FROM (SELECT unnest(range(k * {SIDE})) AS e FROM squares), (SELECT unnest(range(k * {SIDE})) AS n FROM squares)
  WHERE NOT (e BETWEEN 400 AND 499 AND n BETWEEN 400 AND 499)
),
bounds AS (
  SELECT * FROM (VALUES {", ".join(str(b) for b in BOUNDS)}) t(file_id, min_easting, min_northing, max_easting, max_northing)
  UNION ALL
  SELECT 'X' || i || '_' || j, (i * {SIDE})::INT, (j * {SIDE})::INT, ((i + 1) * {SIDE})::INT, ((j + 1) * {SIDE})::INT
  FROM (SELECT unnest(range(k)) AS i FROM squares), (SELECT unnest(range(k)) AS j FROM squares) WHERE i + j > 0
),
staged AS (
  SELECT src, dst, way_id, way_inx, timestamp - CASE WHEN way_id % 10 = 1 THEN 1 ELSE 0 END AS timestamp FROM edges WHERE way_id % 10 <> 0
  UNION ALL SELECT -src, -dst, way_id, way_inx, timestamp FROM edges WHERE way_id % 10 = 2
)"""


def sql(rest: str) -> str:
    """A query over the relations above; ``rest`` may go on with more of them."""
    rest = rest.strip()
    return f"WITH {BASE_SQL}{rest if rest.startswith(',') else ' ' + rest}"
