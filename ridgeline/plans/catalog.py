"""Queries over the driver's tables, one or more for each operator, with the
same query in DuckDB's SQL wherever SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions import geo
from ridgeline.functions import profile as pf
from ridgeline.operators import contract as ct
from ridgeline.operators import elevation as el
from ridgeline.operators import incremental as inc
from ridgeline.operators import network as net
from ridgeline.operators import search as rs
from ridgeline.operators import tags as tg
from ridgeline.plans import ingest
from ridgeline.runtime import materialize, scratch_path
from ridgeline.schema import layer_schema, map_to_schema
from ridgeline.sources import files, pbf, raster, serving
from ridgeline.sources import fixtures as fx

#: Grid steps of the loops that are walked without pruning.
LOOP_M = 800.0

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, recursive: bool = False):
    """Register a function under its name; ``sql`` goes on from the relations
    of ``fixtures.BASE_SQL``."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            whole = fx.sql(sql)
            ORACLE_SQL[f.__name__] = whole.replace("WITH", "WITH RECURSIVE", 1) if recursive else whole
        return f

    return register


def _edges(spark, sf_dir):
    return fx.edges(spark, sf_dir)


def _landed(spark, sf_dir):
    """The landed edges as a load finds them: stored."""
    return materialize(_edges(spark, sf_dir), "landed")


def _cells_along(spark, sf_dir, edges):
    """The raster of the tiles that edges cross."""
    return el.cells_around(el.squares_of_edges(edges), fx.elevation(spark, sf_dir), fx.bounds(spark, sf_dir))


def _placed_nodes(spark, sf_dir):
    n = fx.nodes(spark, sf_dir)
    return el.node_elevation(n, el.cells_around(el.squares_of_points(n), fx.elevation(spark, sf_dir), fx.bounds(spark, sf_dir)))


# Pieces of SQL that several oracles share.

TAGGED = ", tagged AS (SELECT e.*, t.* EXCLUDE (way_id) FROM edges e JOIN tags t USING (way_id))"
FLAGS = """, flagged AS (
  SELECT *, coalesce(foot NOT IN ('no', 'separate'), false) OR coalesce(sidewalk NOT IN ('no', 'separate'), false) AS explicit_footway,
         coalesce(foot = 'separate', false) OR coalesce(sidewalk = 'separate', false) AS separate_footway
  FROM tagged
)"""
ACCESS = "(access IS NULL OR access IN ('yes', 'permissive', 'designated') OR explicit_footway)"
SPEED = "coalesce(try_cast(nullif(regexp_extract(maxspeed, '([0-9]{1,3})', 1), '') AS INT) < 50, true) OR explicit_footway"
SAFE = f"(highway IS NULL OR NOT contains(highway, 'motorway')) AND NOT separate_footway AND (junction IS NULL OR junction <> 'roundabout') AND ({SPEED})"
PLACED = """, placed AS (
  SELECT *, ((src * 37) % 499)::INT AS se, ((src * 91) % 491)::INT AS sn, ((dst * 37) % 499)::INT AS de, ((dst * 91) % 491)::INT AS dn FROM {0}
), stepped AS (
  SELECT *, greatest(2, CAST(round(sqrt((de - se) * (de - se) + (dn - sn) * (dn - sn)) / 10 + 1) AS INT)) AS n FROM placed
)"""
SAMPLES = """, samples AS (
  SELECT src, dst, way_id, way_inx, i::INT AS edge_inx,
    CAST(round(CASE WHEN i = 0 THEN se WHEN i = n - 1 THEN de ELSE se + (de - se)::DOUBLE / (n - 1) * i END) AS INT) AS easting,
    CAST(round(CASE WHEN i = 0 THEN sn WHEN i = n - 1 THEN dn ELSE sn + (dn - sn)::DOUBLE / (n - 1) * i END) AS INT) AS northing
  FROM (SELECT *, unnest(range(n)) AS i FROM stepped)
)"""
PROFILES = """, sampled AS (
  SELECT s.*, e.elevation FROM samples s LEFT JOIN elevation e USING (easting, northing)
), drops AS (
  SELECT *, elevation - lag(elevation) OVER (PARTITION BY src, dst, way_id, way_inx ORDER BY edge_inx) AS d FROM sampled
), profiles AS (
  SELECT src, dst, way_id, way_inx, count(*) AS n, count(elevation) = count(*) AS whole,
    coalesce(sum(d) FILTER (WHERE abs(d) < 6 AND d > 0), 0) AS gain, coalesce(sum(-d) FILTER (WHERE abs(d) < 6 AND d < 0), 0) AS loss,
    sum(elevation * (edge_inx + 1)) AS check_sum
  FROM drops GROUP BY src, dst, way_id, way_inx
)"""
BOTH = """, both_ways AS (
  SELECT src, dst, way_id, way_inx FROM edges UNION ALL
  SELECT dst, src, -way_id, -way_inx FROM edges JOIN tags USING (way_id) WHERE oneway IS NULL OR oneway = 'no'
)"""
LINKS = """, links AS (SELECT src AS id, dst AS other, 0 AS i, 1 AS o FROM {0} UNION ALL SELECT dst, src, 1, 0 FROM {0}),
degrees AS (SELECT id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree, count(DISTINCT other) AS degree FROM links GROUP BY id)"""
CHAINS = """, ends AS (
  SELECT e.*, CASE WHEN way_inx = min(way_inx) OVER w THEN 1 ELSE 0 END AS s_flag, CASE WHEN way_inx = max(way_inx) OVER w THEN 1 ELSE 0 END AS e_flag
  FROM edges e WINDOW w AS (PARTITION BY way_id)
), marked AS (
  SELECT e.*, a.degree AS src_degree, b.degree AS dst_degree,
         CASE WHEN s_flag = 1 OR a.degree <> 2 THEN src END AS c_src, CASE WHEN e_flag = 1 OR b.degree <> 2 THEN dst END AS c_dst
  FROM ends e JOIN degrees a ON a.id = e.src JOIN degrees b ON b.id = e.dst
), filled AS (
  SELECT *, last_value(c_src IGNORE NULLS) OVER (PARTITION BY way_id ORDER BY way_inx ROWS UNBOUNDED PRECEDING) AS chain_src,
         first_value(c_dst IGNORE NULLS) OVER (PARTITION BY way_id ORDER BY way_inx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS chain_dst
  FROM marked
)"""


# --------------------------------------------------------------------------
# sources and sinks


@query("SELECT way_id, count(*) AS n_nodes, sum(way_inx * (node % 1009))::BIGINT AS check_sum FROM way_nodes GROUP BY way_id")
def s4_read_raw_ways(spark, sf_dir):
    path = scratch_path(spark, "raw")
    fx.ways(spark, sf_dir).write.parquet(f"{path}/area.way.parquet")
    fx.nodes(spark, sf_dir).write.parquet(f"{path}/area.node.parquet")
    _, ways = files.read_raw(spark, path)
    total = F.aggregate("nodes", F.lit(0).cast("long"), lambda a, n: a + n["index"] * (n["nodeId"] % 1009))
    return ways.select(F.col("id").alias("way_id"), F.size("nodes").cast("long").alias("n_nodes"), total.alias("check_sum"))


@query("SELECT way_id, count(*) AS n_nodes, sum(way_inx * (node % 1009))::BIGINT AS check_sum, any_value(highway) AS highway FROM way_nodes JOIN tags USING (way_id) GROUP BY way_id")
def s1_binary_extract(spark, sf_dir):
    """The ways written as a binary extract and read back, blob by blob."""
    folder = scratch_path(spark, "extract")
    pair = lambda t: F.struct(t["key"].cast("binary").alias("key"), t["value"].cast("binary").alias("value"))
    none = F.array().cast(pbf.TAGS)
    nodes = fx.nodes(spark, sf_dir).select("id", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), "timestamp", none.alias("tags"))
    ways = fx.ways(spark, sf_dir).select("id", F.transform(F.map_entries("tags"), pair).alias("tags"), "timestamp", "nodes")
    pbf.write_extract(nodes, ways, folder)
    back = tg.unpack_tags(pbf.read_extract(spark, folder)[1])
    total = F.aggregate("nodes", F.lit(0).cast("long"), lambda a, n: a + (n["index"] + 1) * (n["nodeId"] % 1009))
    return back.select(F.col("id").alias("way_id"), F.size("nodes").cast("long").alias("n_nodes"), total.alias("check_sum"), pf.tag("highway").alias("highway"))


@query("SELECT id, easting, northing, timestamp FROM nodes")
def s5_s6_parquet_round_trip(spark, sf_dir):
    root = scratch_path(spark, "layers")
    files.write_parquet(fx.nodes(spark, sf_dir), root, "landing", "nodes")
    return files.read_parquet(spark, root, "landing", "nodes").select("id", "easting", "northing", "timestamp")


@query("SELECT src, dst, way_id, way_inx::INT AS way_inx, timestamp FROM staged")
def s7_versioned_read(spark, sf_dir):
    rows = fx.staged_edges(spark, sf_dir).select("src", "dst", "way_id", "way_inx", "timestamp")
    table = inc.SnapshotTable(spark, scratch_path(spark, "staged"), rows.schema)
    table.write(rows.limit(0))
    table.write(rows)
    return table.read()


@query("""SELECT n_nationkey::INT AS nation, upper(left(n_name, 2)) || lpad(n_nationkey::VARCHAR, 2, '0') || 'ne' AS file_id FROM nation""")
def s8_s9_tile_ids(spark, sf_dir):
    n = fx.table(spark, sf_dir, "nation")
    path = F.concat(F.lit("/tiles/survey-"), F.upper(F.substring("n_name", 1, 2)), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"), F.lit("ne-2024.zip"))
    return n.select(F.col("n_nationkey").cast("int").alias("nation"), files.tile_id(path).alias("file_id"))


@query("SELECT file_id FROM bounds WHERE file_id NOT IN ('B', 'D')")
def s10_x5_tiles_to_load(spark, sf_dir):
    b = fx.bounds(spark, sf_dir).select("file_id")
    return files.tiles_to_load(b, b.where("file_id IN ('B', 'D')"))


@query("SELECT file_id, min_easting, min_northing, max_easting, max_northing FROM bounds")
def s12_bounds_from_xml(spark, sf_dir):
    corner = lambda e, n: f"'<pos>', {e}, '.000000 ', {n}, '.000000</pos>'"
    corners = ", ".join(corner(e, n) for e in ("min_easting", "max_easting") for n in ("min_northing", "max_northing"))
    xml = f"concat('<r><spatRepInfo><Georect><cornerPts>', {corners}, '</cornerPts></Georect></spatRepInfo></r>')"
    tiles = fx.bounds(spark, sf_dir).select("file_id", F.expr(xml).alias("xml"))
    return el.bounds_from_xml(tiles).select("file_id", "min_easting", "min_northing", "max_easting", "max_northing")


def _rasters(spark, sf_dir):
    n = fx.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("k"))
    raster = "transform(sequence(0, 3), r -> transform(sequence(0, CASE WHEN k % 5 = 0 THEN 5 ELSE 4 END), c -> k * 100 + r * 10 + c))"
    return n.select(
        F.col("k").cast("string").alias("file_id"), F.expr("k * 5").alias("min_easting"), F.expr("k * 4").alias("min_northing"),
        F.expr("k * 5 + 5").alias("max_easting"), F.expr("k * 4 + 4").alias("max_northing"), F.expr(raster).alias("raster"),
    )


@query("""SELECT n_nationkey::VARCHAR AS file_id, (n_nationkey * 5 + c)::INT AS easting, (n_nationkey * 4 + 3 - r)::INT AS northing,
  (n_nationkey * 100 + r * 10 + c)::DOUBLE AS elevation FROM nation, range(4) t(r), range(5) u(c) WHERE n_nationkey % 5 <> 0""")
def s14_s15_s16_raster_melt(spark, sf_dir):
    return el.melt_raster(el.valid_rasters(_rasters(spark, sf_dir))[0]).select("file_id", "easting", "northing", "elevation")


@query("""SELECT 'TS' || lpad(n_nationkey::VARCHAR, 2, '0') || 'ne' AS file_id, (n_nationkey * 5 + c)::INT AS easting, (n_nationkey * 4 + 3 - r)::INT AS northing,
  (n_nationkey * 100 + r * 10 + c)::DOUBLE AS elevation FROM nation, range(4) t(r), range(5) u(c) WHERE n_nationkey % 5 <> 0""")
def s11_s13_s16_s21_zipped_tiles(spark, sf_dir):
    """Tiles as a survey sends them, zipped rasters with their boxes, read back
    by as many tasks as there are files to share."""
    folder = scratch_path(spark, "tiles")
    named = _rasters(spark, sf_dir).withColumn("file_id", F.concat(F.lit("TS"), F.lpad("file_id", 2, "0"), F.lit("ne")))
    raster.write_archives(named, folder)
    return raster.melt_rows(raster.fitting_rows(raster.read_rasters(spark, folder))[0])


@query("SELECT n_nationkey::VARCHAR AS file_id FROM nation WHERE n_nationkey % 5 = 0")
def s18_rejected_rasters(spark, sf_dir):
    return el.valid_rasters(_rasters(spark, sf_dir))[1].select("file_id")


@query("SELECT file_id, min_easting, min_northing, max_easting, max_northing FROM bounds")
def s19_s20_merge_bounds(spark, sf_dir):
    b = fx.bounds(spark, sf_dir)
    path = scratch_path(spark, "bounds")
    el.merge_bounds(b.where("file_id < 'D'"), b.where("file_id > 'A'")).write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


@query("""SELECT e.easting, e.northing, e.elevation FROM elevation e WHERE e.easting >= 250 AND e.easting < 500 AND e.northing < 250""")
def s17_s22_tile_pruned_read(spark, sf_dir):
    path = scratch_path(spark, "elevation")
    fx.elevation(spark, sf_dir).repartition("file_id").write.partitionBy("file_id").parquet(path)
    wanted = fx.bounds(spark, sf_dir).where("min_easting = 250 AND min_northing = 0")
    return el.read_tiles(spark.read.parquet(path), wanted).select("easting", "northing", "elevation")


@query("""SELECT id, '{' || lat_m || ',' || CASE WHEN id % 2 = 0 THEN 'NULL' ELSE lon_m END || '}' AS geom, CASE WHEN id % 3 = 0 THEN NULL ELSE id % 7 END AS rest
FROM (SELECT id, northing::VARCHAR AS lat_m, easting::VARCHAR AS lon_m FROM nodes)""")
def s23_p13_tsv_export(spark, sf_dir):
    values = F.array(F.col("northing"), F.expr("CASE WHEN id % 2 <> 0 THEN easting END"))
    rows = fx.nodes(spark, sf_dir).select("id", pf.array_literal(values).alias("geom"), F.expr("CASE WHEN id % 3 <> 0 THEN id % 7 END").alias("rest"))
    path = scratch_path(spark, "tsv")
    files.export_tsv(rows, path)
    return spark.read.schema("id long, geom string, rest long").option("sep", "\t").option("nullValue", "\\N").option("quote", "").csv(path)


def _config(**kw):
    return rs.RouteConfig(**({"start_lat": 50.2, "start_lon": -1.7, "target_distance": 12_000.0} | kw))


_BOX = geo.bounding_box(50.2, -1.7, _config().max_distance)
IN_BOX = f"lat BETWEEN {_BOX[0]!r} AND {_BOX[2]!r} AND lon BETWEEN {_BOX[1]!r} AND {_BOX[3]!r}"


@query(f"SELECT id, easting, northing FROM nodes WHERE {IN_BOX}")
def s24_s27_p9_node_window(spark, sf_dir):
    root = scratch_path(spark, "serving")
    n = fx.nodes(spark, sf_dir).withColumn("ptn", geo.partition_key("lat", "lon"))
    e = _edges(spark, sf_dir).drop("tags").withColumn("ptn", geo.partition_key("src_lat", "src_lon"))
    files.serving_tables(n, e, root)
    return rs.nodes_window(spark.read.parquet(f"{root}/nodes"), _config()).select("id", "easting", "northing")


_SQUARE = "replace(lat::VARCHAR, '-', 'n') || '_' || replace(lon::VARCHAR, '-', 'n')"


@query(f"""SELECT name, ptn, 'CREATE TABLE routing.' || name || '_' || ptn || ' PARTITION OF routing.' || name || ' FOR VALUES IN (' || chr(39) || ptn || chr(39) || ')' AS statement
FROM (SELECT unnest(['nodes', 'edges']) AS name), (SELECT {_SQUARE} AS ptn FROM range(48, 61) a(lat), range(-15, 2) o(lon))""")
def s25_partition_ddl(spark, sf_dir):
    return serving.partition_ddl(spark)


@query("""SELECT id, lat, lon, (id % 90)::DOUBLE AS elevation, '50_n1' AS ptn, 'COPY routing.nodes (id, lat, lon, elevation, ptn) FROM STDIN' AS statement FROM nodes""")
def s26_copied_files(spark, sf_dir):
    """Nodes as the database would hold them after every file was copied."""
    n = fx.nodes(spark, sf_dir).select("id", "lat", "lon", (F.col("id") % 90).cast("double").alias("elevation"), F.lit("50_n1").alias("ptn"))
    folder = scratch_path(spark, "copy")
    files.export_tsv(serving.text_rows(n, "nodes"), folder)
    loads = serving.load_scripts(spark, folder, "nodes")
    name = lambda path: F.element_at(F.split(path, "/"), -1)
    rows = spark.read.schema(layer_schema("optimised", "nodes")).option("sep", "\t").option("nullValue", "\\N").option("quote", "").csv(folder)
    rows = rows.select("*", name(F.col("_metadata.file_path")).alias("file"))
    return rows.join(loads.select(name(F.col("path")).alias("file"), "statement"), "file").drop("file")


@query(f"""{TAGGED} SELECT src, dst, way_id, way_inx::INT AS way_inx FROM tagged JOIN nodes ON nodes.id = tagged.src
WHERE {IN_BOX} AND highway IN ('track', 'footway') AND surface IN ('grass')""")
def s28_p10_edge_window(spark, sf_dir):
    e = tg.highway_and_surface(_edges(spark, sf_dir)).withColumn("ptn", geo.partition_key("src_lat", "src_lon"))
    cfg = _config(highway_types=("track", "footway"), surface_types=("grass",))
    return rs.edges_window(e, cfg).select("src", "dst", "way_id", "way_inx")


@query("""SELECT way_id, '{"status":"' || CASE WHEN way_id % 2 = 0 THEN 'success' ELSE 'queued' END || '","detail":"' || way_id || '"}' AS payload FROM ways""")
def s29_job_status(spark, sf_dir):
    w = fx.ways(spark, sf_dir)
    status = F.when(F.col("id") % 2 == 0, "success").otherwise("queued")
    return w.select(F.col("id").alias("way_id"), files.job_status(status, F.col("id").cast("string")).alias("payload"))


@query("""SELECT way_id, count(*) AS n_points, ('r' || way_id) AS name, string_agg('<ele>' || (node % 100)::VARCHAR || '.0</ele>', '' ORDER BY way_inx) AS eles
FROM way_nodes GROUP BY way_id""")
def s30_gpx_export(spark, sf_dir):
    w = fx.ways(spark, sf_dir).select(
        F.col("id").alias("way_id"),
        F.expr("transform(nodes, n -> 50 + (n.nodeId % 90) / 100)").alias("lats"),
        F.expr("transform(nodes, n -> (n.nodeId % 90) / 100 - 2)").alias("lons"),
        F.expr("transform(nodes, n -> cast(n.nodeId % 100 as double))").alias("eles"),
    )
    doc = w.select("way_id", files.gpx(F.concat(F.lit("r"), F.col("way_id").cast("string"))).alias("doc"))
    return doc.select(
        "way_id",
        F.regexp_count("doc", F.lit("<rtept ")).cast("long").alias("n_points"),
        F.regexp_extract("doc", "<name>([^<]*)</name><type>run</type>", 1).alias("name"),
        F.array_join(F.regexp_extract_all("doc", F.lit("(<ele>[^<]*</ele>)"), F.lit(1)), "").alias("eles"),
    )


@query("SELECT way_id, count(*) AS n_points, max(node) AS top FROM way_nodes GROUP BY way_id")
def s31_route_json_round_trip(spark, sf_dir):
    w = fx.ways(spark, sf_dir).select("id", F.expr("transform(nodes, n -> n.nodeId)").alias("points"))
    back = files.routes_from_json(w.select(files.routes_to_json(w).alias("j")), "j", "id long, points array<long>")
    return back.select(F.col("id").alias("way_id"), F.size("points").cast("long").alias("n_points"), F.array_max("points").alias("top"))


# --------------------------------------------------------------------------
# projections


@query("SELECT src, dst, way_id, way_inx::INT AS way_inx, NULL::VARCHAR AS surface, timestamp FROM edges")
def p1_map_to_schema(spark, sf_dir):
    from pyspark.sql.types import StructType

    e = fx.plain_edges(spark, sf_dir).withColumns({"surface": F.lit(None), "extra": F.lit(1), "way_inx": F.col("way_inx").cast("string")})
    return map_to_schema(e, StructType.fromDDL("src long, dst long, way_id long, way_inx int, surface string, timestamp long"))


def _chain(rows: str, *stages: dict[str, str]) -> str:
    """SQL that adds columns stage by stage, each seeing those before it."""
    for stage in stages:
        rows = f"(SELECT *, {', '.join(f'{e} AS {n}' for n, e in stage.items())} FROM {rows})"
    return rows


_E2, _AIRY_E2 = 2 * geo.WGS84_F - geo.WGS84_F**2, 1 - (geo.AIRY_B / geo.AIRY_A) ** 2
_N = (geo.AIRY_A - geo.AIRY_B) / (geo.AIRY_A + geo.AIRY_B)
_RX, _RY, _RZ = (f"radians({x}e0 / 3600)" for x in geo.SHIFT_SEC)
_S = f"(1 + {geo.SHIFT_PPM}e0 / 1000000)"

#: The shift and the projection as published, by the series' numbered terms.
_GRID = _chain(
    "(SELECT id, lat, lon, radians(lat) AS p, radians(lon) AS l FROM nodes)",
    {"v": f"{geo.WGS84_A}e0 / sqrt(1 - {_E2!r} * sin(p) ** 2)"},
    {"x": "v * cos(p) * cos(l)", "y": "v * cos(p) * sin(l)", "z": f"v * (1 - {_E2!r}) * sin(p)"},
    {
        "xx": f"({geo.SHIFT_M[0]}e0) + {_S} * x - ({_RZ}) * y + ({_RY}) * z",
        "yy": f"({geo.SHIFT_M[1]}e0) + ({_RZ}) * x + {_S} * y - ({_RX}) * z",
        "zz": f"({geo.SHIFT_M[2]}e0) - ({_RY}) * x + ({_RX}) * y + {_S} * z",
    },
    {"q": "sqrt(xx * xx + yy * yy)", "dl": f"atan2(yy, xx) - radians({geo.GRID_LON0}e0)", "f0": f"atan2(zz, sqrt(xx * xx + yy * yy) * (1 - {_AIRY_E2!r}))"},
    *[{f"f{k + 1}": f"atan2(zz + {_AIRY_E2!r} * {geo.AIRY_A}e0 / sqrt(1 - {_AIRY_E2!r} * sin(f{k}) ** 2) * sin(f{k}), q)"} for k in range(6)],
    {
        "nu": f"{geo.AIRY_A}e0 * {geo.GRID_F0}e0 * (1 - {_AIRY_E2!r} * sin(f6) ** 2) ** -0.5",
        "rho": f"{geo.AIRY_A}e0 * {geo.GRID_F0}e0 * (1 - {_AIRY_E2!r}) * (1 - {_AIRY_E2!r} * sin(f6) ** 2) ** -1.5",
        "a": f"f6 - radians({geo.GRID_LAT0}e0)",
        "b": f"f6 + radians({geo.GRID_LAT0}e0)",
        "t": "tan(f6)",
    },
    {
        "m": f"{geo.AIRY_B}e0 * {geo.GRID_F0}e0 * ((1 + {_N!r} + 5 / 4 * {_N!r} ** 2 + 5 / 4 * {_N!r} ** 3) * a - (3 * {_N!r} + 3 * {_N!r} ** 2 + 21 / 8 * {_N!r} ** 3) * sin(a) * cos(b) "
        f"+ (15 / 8 * {_N!r} ** 2 + 15 / 8 * {_N!r} ** 3) * sin(2 * a) * cos(2 * b) - 35 / 24 * {_N!r} ** 3 * sin(3 * a) * cos(3 * b))",
        "eta": "nu / rho - 1",
    },
    {
        "i": f"m + ({geo.GRID_N0}e0)",
        "ii": "nu / 2 * sin(f6) * cos(f6)",
        "iii": "nu / 24 * sin(f6) * cos(f6) ** 3 * (5 - t ** 2 + 9 * eta)",
        "iiia": "nu / 720 * sin(f6) * cos(f6) ** 5 * (61 - 58 * t ** 2 + t ** 4)",
        "iv": "nu * cos(f6)",
        "v5": "nu / 6 * cos(f6) ** 3 * (nu / rho - t ** 2)",
        "vi": "nu / 120 * cos(f6) ** 5 * (5 - 18 * t ** 2 + t ** 4 + 14 * eta - 58 * t ** 2 * eta)",
    },
)


@query(f"""SELECT id, lat, lon, trunc({geo.GRID_E0}e0 + iv * dl + v5 * dl ** 3 + vi * dl ** 5)::INT AS easting,
  trunc(i + ii * dl ** 2 + iii * dl ** 4 + iiia * dl ** 6)::INT AS northing FROM {_GRID}""")
def p2_p3_national_grid(spark, sf_dir):
    raw = fx.nodes(spark, sf_dir).select("id", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), "timestamp")
    return ingest.land_nodes(raw).select("id", "lat", "lon", "easting", "northing")


@query("""SELECT way_id, highway, surface, coalesce(maxspeed, 'none set') AS maxspeed FROM tags""")
def p4_p5_unpack_tags(spark, sf_dir):
    w = fx.ways(spark, sf_dir)
    pair = lambda k, v: F.struct(k.cast("binary").alias("key"), v.cast("binary").alias("value"))
    stale = F.array(pair(F.lit("highway"), F.lit("stale")))
    real = F.transform(F.map_entries("tags"), lambda t: pair(t["key"], F.concat(F.lit('"'), t["value"], F.lit('"'))))
    out = tg.unpack_tags(w.withColumn("tags", F.concat(stale, real)))
    return out.select(F.col("id").alias("way_id"), pf.tag("highway").alias("highway"), pf.tag("surface").alias("surface"), F.coalesce(pf.tag("maxspeed"), F.lit("none set")).alias("maxspeed"))


@query("""SELECT id, replace(trunc(lat)::INT::VARCHAR, '-', 'n') || '_' || replace(trunc(lon)::INT::VARCHAR, '-', 'n') AS ptn FROM nodes""")
def p6_p7_partition_key(spark, sf_dir):
    return fx.nodes(spark, sf_dir).select("id", geo.partition_key("lat", "lon").alias("ptn"))


@query(f"{PLACED.format('edges')} SELECT src, dst, way_id, way_inx::INT AS way_inx, de - se AS edge_size_h, dn - sn AS edge_size_v, n AS edge_steps FROM stepped")
def p8_step_metrics(spark, sf_dir):
    return el.edge_steps(_edges(spark, sf_dir)).select("src", "dst", "way_id", "way_inx", "edge_size_h", "edge_size_v", "edge_steps")


@query(f"{PLACED.format('edges')}{SAMPLES} SELECT src, dst, way_id, way_inx::INT AS way_inx, edge_inx, easting, northing FROM samples")
def p11_g2_edge_samples(spark, sf_dir):
    out = el.explode_edges(el.edge_steps(_edges(spark, sf_dir)))
    return out.select("src", "dst", "way_id", "way_inx", "edge_inx", "easting", "northing")


@query("SELECT dst AS src, src AS dst, way_id, way_inx::INT AS way_inx FROM edges")
def p14_swap_columns(spark, sf_dir):
    return net.swap_columns(fx.plain_edges(spark, sf_dir).select("src", "dst", "way_id", "way_inx"), "src", "dst")


#: Labels of the interface and the raw values that they stand for.
CATEGORIES = {"Paths": ("footway", "track"), "Roads": ("residential", "primary"), "Fast roads": ("motorway",)}


@query("""SELECT CASE WHEN highway IN ('footway', 'track') THEN 'Paths' WHEN highway = 'motorway' THEN 'Fast roads' ELSE 'Roads' END AS label,
count(*) AS n FROM tags GROUP BY 1""")
def p15_category_expansion(spark, sf_dir):
    lookup = spark.createDataFrame([(k, v) for k, vs in CATEGORIES.items() for v in vs], "label string, highway string")
    w = fx.ways(spark, sf_dir).select(pf.tag("highway").alias("highway"))
    return w.join(lookup, "highway").groupBy("label").agg(F.count("*").alias("n"))


@query("""SELECT way_id, string_agg((node % 90)::VARCHAR || ' ' || (node % 70)::VARCHAR, ',' ORDER BY way_inx) AS coords FROM way_nodes GROUP BY way_id""")
def p16_zip_coords(spark, sf_dir):
    w = fx.ways(spark, sf_dir).select(
        F.col("id").alias("way_id"), F.expr("transform(nodes, n -> n.nodeId % 90)").alias("lats"), F.expr("transform(nodes, n -> n.nodeId % 70)").alias("lons")
    )
    return w.select("way_id", F.array_join(F.transform(pf.coords(), lambda p: F.concat_ws(" ", p[0], p[1])), ",").alias("coords"))


@query("""SELECT way_id, printf('%d.%d km, ', n * 3 // 10, n * 3 % 10) || format('{:,}', n * 400) || ' m' AS card FROM (SELECT way_id, count(*) AS n FROM way_nodes GROUP BY way_id)""")
def p17_card_text(spark, sf_dir):
    w = fx.ways(spark, sf_dir).select(F.col("id").alias("way_id"), (F.size("nodes") * 300).cast("double").alias("d"), (F.size("nodes") * 400).cast("double").alias("g"))
    return w.select("way_id", pf.card_text("d", "g").alias("card"))


# --------------------------------------------------------------------------
# filters


@query(f"{TAGGED} SELECT way_id, count(*) AS n FROM tagged WHERE surface IS NOT NULL GROUP BY way_id")
def f1_tag_filter(spark, sf_dir):
    e = tg.roads_and_paths(_edges(spark, sf_dir)).where(F.col("tags")["surface"].isNotNull())
    return e.groupBy("way_id").agg(F.count("*").alias("n"))


@query(f"{PLACED.format('edges')}{SAMPLES}{PROFILES} SELECT src, dst, way_id, way_inx::INT AS way_inx FROM profiles WHERE whole")
def f2_f15_drop_without_elevation(spark, sf_dir):
    e = _landed(spark, sf_dir)
    return el.drop_without_elevation(el.tag_edges(e, _cells_along(spark, sf_dir, e))).select("src", "dst", "way_id", "way_inx")


@query(f"{TAGGED}{FLAGS} SELECT way_id, way_inx::INT AS way_inx, explicit_footway, separate_footway FROM flagged")
def f3_footway_flags(spark, sf_dir):
    return tg.flag_footways(_edges(spark, sf_dir)).select("way_id", "way_inx", "explicit_footway", "separate_footway")


@query(f"{TAGGED}{FLAGS} SELECT way_id, way_inx::INT AS way_inx FROM flagged WHERE {ACCESS}")
def f4_access(spark, sf_dir):
    return tg.keep_accessible(tg.flag_footways(_edges(spark, sf_dir))).select("way_id", "way_inx")


@query(f"{TAGGED} SELECT way_id, way_inx::INT AS way_inx FROM tagged WHERE NOT contains(highway, 'motorway')")
def f5_motorways(spark, sf_dir):
    return tg.drop_motorways(_edges(spark, sf_dir)).select("way_id", "way_inx")


@query(f"{TAGGED}{FLAGS} SELECT way_id, way_inx::INT AS way_inx FROM flagged WHERE NOT separate_footway AND coalesce(junction, '') <> 'roundabout'")
def f6_f7_separate_and_roundabouts(spark, sf_dir):
    e = tg.drop_roundabouts(tg.drop_separate_footways(tg.flag_footways(_edges(spark, sf_dir))))
    return e.select("way_id", "way_inx")


@query(f"{TAGGED}{FLAGS} SELECT way_id, way_inx::INT AS way_inx FROM flagged WHERE {SPEED}")
def f8_speed(spark, sf_dir):
    return tg.drop_fast_roads(tg.flag_footways(_edges(spark, sf_dir))).select("way_id", "way_inx")


@query(f"{TAGGED}{FLAGS} SELECT way_id, way_inx::INT AS way_inx FROM flagged WHERE {ACCESS} AND {SAFE}")
def f9_unsafe(spark, sf_dir):
    return tg.drop_unsafe(tg.keep_accessible(tg.flag_footways(_edges(spark, sf_dir)))).select("way_id", "way_inx")


@query(f"{TAGGED} SELECT way_id, way_inx::INT AS way_inx, bridge IS NOT NULL AS is_flat, coalesce(oneway <> 'no', false) AS oneway FROM tagged")
def f10_f11_flat_and_oneway(spark, sf_dir):
    return tg.flag_oneway(tg.flag_flat(_edges(spark, sf_dir))).select("way_id", "way_inx", "is_flat", "oneway")


@query(f"{LINKS.format('edges')} SELECT id, CASE WHEN degree = 2 THEN 1 ELSE 0 END AS contract_flag, CASE WHEN degree = 1 THEN 1 ELSE 0 END AS dead_end_flag FROM degrees")
def f13_node_flags(spark, sf_dir):
    e = fx.plain_edges(spark, sf_dir)
    return net.node_flags(net.add_degrees(fx.nodes(spark, sf_dir), e)).select("id", "contract_flag", "dead_end_flag")


@query("SELECT id, e.elevation FROM nodes JOIN elevation e USING (easting, northing)")
def f14_u4_clear_without_elevation(spark, sf_dir):
    return inc.clear_without_elevation(_placed_nodes(spark, sf_dir)).select("id", "elevation")


# --------------------------------------------------------------------------
# joins


@query("SELECT src, dst, way_id, way_inx::INT AS way_inx, a.easting AS src_easting, a.northing AS src_northing, b.easting AS dst_easting, b.northing AS dst_northing FROM edges JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst")
def j1_j2_edge_coords(spark, sf_dir):
    n = fx.nodes(spark, sf_dir)
    e = net.edge_end_coords(net.edge_start_coords(fx.plain_edges(spark, sf_dir), n), n)
    return e.select("src", "dst", "way_id", "way_inx", "src_easting", "src_northing", "dst_easting", "dst_northing")


@query(f"{TAGGED} SELECT id, easting FROM nodes WHERE id IN (SELECT src FROM tagged WHERE highway = 'footway' UNION ALL SELECT dst FROM tagged WHERE highway = 'footway')")
def j3_x1_used_nodes(spark, sf_dir):
    e = tg.highway_and_surface(_edges(spark, sf_dir)).where("highway = 'footway'")
    return net.used_nodes(fx.nodes(spark, sf_dir), e).select("id", "easting")


@query("SELECT DISTINCT src, dst FROM staged s WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = s.src AND e.dst = s.dst)")
def j4_removals(spark, sf_dir):
    return inc.removals(fx.staged_edges(spark, sf_dir), fx.plain_edges(spark, sf_dir), ["src", "dst"])


_KEYED = ", landed AS (SELECT DISTINCT ON (src, dst) * FROM edges ORDER BY src, dst, way_id, way_inx), kept AS (SELECT DISTINCT ON (src, dst) * FROM staged ORDER BY src, dst, way_id, way_inx)"


def _keyed(df):
    pick = F.min(F.struct("way_id", "way_inx", "timestamp")).alias("m")
    return df.groupBy("src", "dst").agg(pick).select("src", "dst", "m.way_id", "m.way_inx", "m.timestamp")


@query(f"{_KEYED} SELECT l.src, l.dst, l.way_id, l.timestamp FROM landed l LEFT JOIN kept k USING (src, dst) WHERE k.src IS NULL OR l.timestamp > k.timestamp")
def j5_changes(spark, sf_dir):
    out = inc.changes(_keyed(fx.plain_edges(spark, sf_dir)), _keyed(fx.staged_edges(spark, sf_dir)), ["src", "dst"])
    return out.select("src", "dst", "way_id", "timestamp")


@query("SELECT id, file_id FROM nodes JOIN bounds ON easting >= min_easting AND easting < max_easting AND northing >= min_northing AND northing < max_northing")
def j6_node_tiles(spark, sf_dir):
    return el.assign_tiles(fx.nodes(spark, sf_dir), fx.bounds(spark, sf_dir)).select("id", "file_id")


@query(f"""{PLACED.format("edges")}, ends AS (SELECT se AS easting, sn AS northing FROM placed UNION SELECT de, dn FROM placed)
SELECT DISTINCT file_id FROM ends JOIN bounds ON easting >= min_easting AND easting < max_easting AND northing >= min_northing AND northing < max_northing""")
def j7_x3_edge_tiles(spark, sf_dir):
    return el.tiles_of_edges(_edges(spark, sf_dir), fx.bounds(spark, sf_dir))


@query("SELECT id, e.elevation FROM nodes LEFT JOIN elevation e USING (easting, northing)")
def j8_node_elevation(spark, sf_dir):
    return _placed_nodes(spark, sf_dir).select("id", "elevation")


@query(f"{PLACED.format('edges')}{SAMPLES}{PROFILES} SELECT src, dst, way_id, way_inx::INT AS way_inx, n, CASE WHEN whole THEN check_sum END AS check_sum FROM profiles")
def j9_a2_edge_profiles(spark, sf_dir):
    e = _edges(spark, sf_dir)
    samples = el.sample_elevation(el.explode_edges(el.edge_steps(e)), _cells_along(spark, sf_dir, e))
    out = el.implode_edges(samples.withColumn("one", F.lit(1)), ["one"])
    # The NULL profile still says how many samples it had.
    counts = samples.groupBy("src", "dst", "way_id", "way_inx").agg(F.count("*").alias("n"))
    total = F.aggregate(F.transform("elevation", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return out.join(counts, ["src", "dst", "way_id", "way_inx"]).select("src", "dst", "way_id", "way_inx", "n", total.alias("check_sum"))


@query(f"{LINKS.format('edges')} SELECT id, easting, in_degree, out_degree, degree FROM nodes JOIN degrees USING (id)")
def j10_node_degrees(spark, sf_dir):
    return net.add_degrees(fx.nodes(spark, sf_dir), fx.plain_edges(spark, sf_dir)).select("id", "easting", "in_degree", "out_degree", "degree")


def _flagged(spark, sf_dir):
    nodes = net.node_flags(net.add_degrees(fx.nodes(spark, sf_dir), fx.plain_edges(spark, sf_dir)))
    return nodes.withColumn("elevation", F.lit(0.0))


@query(f"{LINKS.format('edges')}{CHAINS} SELECT src, dst, way_id, way_inx::INT AS way_inx, CASE WHEN src_degree = 2 THEN 1 ELSE 0 END AS a, CASE WHEN dst_degree = 1 THEN 1 ELSE 0 END AS b FROM marked")
def j11_endpoint_flags(spark, sf_dir):
    e = ct.endpoint_flags(fx.plain_edges(spark, sf_dir), _flagged(spark, sf_dir))
    return e.select("src", "dst", "way_id", "way_inx", F.col("src_node.link").cast("int").alias("a"), F.col("dst_node.dead").cast("int").alias("b"))


@query("""SELECT src, dst, min(CAST(way_id AS BIGINT)) AS way_id FROM edges JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst
WHERE a.easting BETWEEN 50 AND 399 AND a.northing BETWEEN 50 AND 399 AND b.easting BETWEEN 50 AND 399 AND b.northing BETWEEN 50 AND 399 GROUP BY src, dst""")
def j12_loaded_graph(spark, sf_dir):
    e = fx.plain_edges(spark, sf_dir).select("src", "dst", F.col("way_id").alias("distance"), "way_inx")
    box = fx.nodes(spark, sf_dir).where("easting BETWEEN 50 AND 399 AND northing BETWEEN 50 AND 399")
    return net.loaded_graph(box, e)[1].select("src", "dst", F.col("distance").alias("way_id"))


# --------------------------------------------------------------------------
# aggregations


@query(f"{BOTH}{LINKS.format('both_ways')} SELECT id, in_degree, out_degree, degree FROM degrees")
def a1_node_degrees(spark, sf_dir):
    return net.node_degrees(_both(spark, sf_dir))


def _both(spark, sf_dir):
    e = tg.flag_oneway(_edges(spark, sf_dir)).select("src", "dst", "way_id", "way_inx", "oneway")
    return net.reverse_edges(e)


def _simple(spark, sf_dir):
    """Edges with integer stand-ins for climb and length."""
    e = tg.highway_and_surface(_edges(spark, sf_dir))
    return e.withColumns(
        {
            "elevation_gain": (F.col("src") % 7).cast("double"),
            "elevation_loss": (F.col("dst") % 5).cast("double"),
            "distance": (F.abs(F.col("dst_easting") - F.col("src_easting")) + F.abs(F.col("dst_northing") - F.col("src_northing"))).cast("double"),
        }
    )


_SIMPLE_SQL = """, simple AS (
  SELECT f.*, t.highway, t.surface, (src % 7)::DOUBLE AS gain, (dst % 5)::DOUBLE AS loss,
    (abs((dst * 37) % 499 - (src * 37) % 499) + abs((dst * 91) % 491 - (src * 91) % 491))::DOUBLE AS distance
  FROM filled f JOIN tags t USING (way_id)
), chains AS (
  SELECT chain_src, chain_dst, sum(gain) AS elevation_gain, sum(loss) AS elevation_loss, sum(distance) AS distance,
    CASE WHEN count(DISTINCT highway) = 1 THEN min(highway) ELSE 'unclassified' END AS highway,
    CASE WHEN count(DISTINCT surface) = 1 THEN min(surface) ELSE 'unclassified' END AS surface, count(*) AS n_steps,
    max(way_inx) AS hi, min(way_inx) AS lo
  FROM simple GROUP BY chain_src, chain_dst
)"""


def _chains(spark, sf_dir):
    e = ct.chain_ends(ct.endpoint_flags(ct.way_ends(_simple(spark, sf_dir)), _flagged(spark, sf_dir)))
    return ct.contract_chains(ct.fill_chains(e))


@query(f"{LINKS.format('edges')}{CHAINS}{_SIMPLE_SQL} SELECT chain_src, chain_dst, elevation_gain, elevation_loss, distance, n_steps FROM chains")
def a3_contract_chains(spark, sf_dir):
    return _chains(spark, sf_dir).select(
        "chain_src", "chain_dst", "elevation_gain", "elevation_loss", "distance", F.size("src_points").cast("long").alias("n_steps")
    )


@query(f"{PLACED.format('edges')}{SAMPLES}{PROFILES} SELECT p.src, p.dst, p.way_id, p.way_inx::INT AS way_inx, CASE WHEN bridge IS NOT NULL THEN 0 ELSE gain END AS elevation_gain, CASE WHEN bridge IS NOT NULL THEN 0 ELSE loss END AS elevation_loss FROM profiles p JOIN tags USING (way_id) WHERE whole")
def a4_elevation_changes(spark, sf_dir):
    e = _landed(spark, sf_dir)
    e = el.drop_without_elevation(el.tag_edges(e, _cells_along(spark, sf_dir, e)))
    return el.elevation_changes(tg.flag_flat(e)).select("src", "dst", "way_id", "way_inx", "elevation_gain", "elevation_loss")


@query(f"""{TAGGED} SELECT way_id, sum(d) AS dist, sum(CASE WHEN surface = 'grass' THEN d ELSE 0 END) AS grass, sum(CASE WHEN surface IS NULL THEN d ELSE 0 END) AS unknown
FROM (SELECT way_id, surface, (src % 11)::DOUBLE AS d FROM tagged) GROUP BY way_id""")
def a5_a8_surface_totals(spark, sf_dir):
    e = tg.highway_and_surface(_edges(spark, sf_dir)).select("way_id", "surface", (F.col("src") % 11).cast("double").alias("d"))
    w = e.groupBy("way_id").agg(F.sum("d").alias("dist"), F.collect_list(F.struct("surface", "d")).alias("steps"))
    total = F.aggregate(
        "steps", F.create_map().cast("map<string,double>"), lambda acc, s: pf.add_surface(acc, s["surface"], s["d"])
    )
    w = w.withColumn("s_dists", total)
    return w.select("way_id", "dist", pf.surface_total("s_dists", ["grass"]).alias("grass"), pf.surface_total("s_dists", ["unclassified"]).alias("unknown"))


@query("""SELECT way_id, min(lat_m) AS min_lat, max(lat_m) AS max_lat, min(lon_m) AS min_lon, max(lon_m) AS max_lon, round(avg(lat_m), 6) AS centre_lat
FROM (SELECT way_id, (node % 90)::DOUBLE AS lat_m, (node % 70)::DOUBLE AS lon_m FROM way_nodes) GROUP BY way_id""")
def a6_route_bounds(spark, sf_dir):
    w = fx.ways(spark, sf_dir).select(
        F.col("id").alias("way_id"),
        F.expr("transform(nodes, n -> cast(n.nodeId % 90 as double))").alias("lats"),
        F.expr("transform(nodes, n -> cast(n.nodeId % 70 as double))").alias("lons"),
    )
    b = pf.bounds()
    return w.select("way_id", *[b[c].alias(c) for c in ("min_lat", "max_lat", "min_lon", "max_lon")], F.round(pf.mean("lats"), 6).alias("centre_lat"))


@query(f"{LINKS.format('edges')}{CHAINS}{_SIMPLE_SQL} SELECT chain_src AS src, chain_dst AS dst, highway, surface, distance, n_steps + 1 AS n_points, distance AS dists_sum FROM chains")
def a7_p12_chains_to_edges(spark, sf_dir):
    out = ct.chains_to_edges(_chains(spark, sf_dir))
    total = F.aggregate("dists", F.lit(0.0), lambda a, x: a + x)
    return out.select("src", "dst", "highway", "surface", "distance", F.size("lats").cast("long").alias("n_points"), total.alias("dists_sum"))


@query("SELECT way_id, greatest(l - g, 0)::DOUBLE AS potential, round((g + greatest(l - g, 0)) / nullif(d, 0), 9) AS ratio FROM (SELECT way_id, sum(src % 7)::DOUBLE AS g, sum(dst % 5)::DOUBLE AS l, sum(src % 11)::DOUBLE AS d FROM edges GROUP BY way_id)")
def a9_gain_potential(spark, sf_dir):
    w = fx.plain_edges(spark, sf_dir).groupBy("way_id").agg(
        F.sum(F.expr("cast(src % 7 as double)")).alias("g"), F.sum(F.expr("cast(dst % 5 as double)")).alias("l"), F.sum(F.expr("cast(src % 11 as double)")).alias("d")
    )
    return w.select("way_id", pf.gain_potential("g", "l").alias("potential"), F.round(pf.gain_ratio("g", "l", "d"), 9).alias("ratio"))


@query("""SELECT way_id, way_inx::INT AS way_inx, sum(src % 11) OVER (PARTITION BY way_id ORDER BY way_inx)::BIGINT AS running,
  (SELECT count(*) FROM edges) AS pending FROM edges""")
def a12_running_distance(spark, sf_dir):
    from pyspark.sql import Window

    e = fx.plain_edges(spark, sf_dir)
    order = Window.partitionBy("way_id").orderBy("way_inx").rowsBetween(Window.unboundedPreceding, 0)
    return e.select("way_id", "way_inx", F.sum(F.col("src") % 11).over(order).alias("running"), e.agg(F.count("*")).scalar().alias("pending"))


@query("""SELECT way_id, sum(node % 70)::DOUBLE AS length, round(0.9 * min(node % 90), 9)::DOUBLE AS low, round(1.1 * max(node % 90), 9)::DOUBLE AS high,
  string_agg(place::VARCHAR, ',' ORDER BY way_inx) AS places
FROM (SELECT *, sum(node % 70) OVER (PARTITION BY way_id ORDER BY way_inx)::BIGINT AS place FROM way_nodes) GROUP BY way_id""")
def a11_profile_plot(spark, sf_dir):
    w = fx.ways(spark, sf_dir).select(
        F.col("id").alias("way_id"),
        F.expr("transform(nodes, n -> cast(n.nodeId % 90 as double))").alias("eles"),
        F.expr("transform(nodes, n -> cast(n.nodeId % 70 as double))").alias("dists"),
    )
    plot = w.select("way_id", pf.profile_plot("dists", "eles").alias("plot"))
    places = F.array_join(F.transform("plot.places", lambda x: x.cast("long").cast("string")), ",")
    return plot.select("way_id", "plot.length", F.round("plot.low", 9).alias("low"), F.round("plot.high", 9).alias("high"), places.alias("places"))


# --------------------------------------------------------------------------
# windows


@query("SELECT way_id, way_inx::INT AS way_inx, src, dst FROM all_edges WHERE dst IS NOT NULL")
def w1_way_edges(spark, sf_dir):
    return net.way_edges(fx.ways(spark, sf_dir)).select("way_id", "way_inx", "src", "dst")


@query(f"{LINKS.format('edges')}{CHAINS} SELECT way_id, way_inx::INT AS way_inx, s_flag AS way_start_flag, e_flag AS way_end_flag FROM marked")
def w2_way_ends(spark, sf_dir):
    return ct.way_ends(fx.plain_edges(spark, sf_dir)).select("way_id", "way_inx", "way_start_flag", "way_end_flag")


@query(f"{LINKS.format('edges')}{CHAINS} SELECT way_id, way_inx::INT AS way_inx, c_src AS chain_src, c_dst AS chain_dst FROM marked")
def w3_chain_ends(spark, sf_dir):
    e = ct.chain_ends(ct.endpoint_flags(ct.way_ends(fx.plain_edges(spark, sf_dir)), _flagged(spark, sf_dir)))
    return e.select("way_id", "way_inx", "chain_src", "chain_dst")


@query(f"{LINKS.format('edges')}{CHAINS} SELECT way_id, way_inx::INT AS way_inx, chain_src, chain_dst FROM filled")
def w4_fill_chains(spark, sf_dir):
    e = ct.chain_ends(ct.endpoint_flags(ct.way_ends(fx.plain_edges(spark, sf_dir)), _flagged(spark, sf_dir)))
    return ct.fill_chains(e).select("way_id", "way_inx", "chain_src", "chain_dst")


_CANDS_SQL = """, c AS (
  SELECT way_id, way_id::VARCHAR AS p, avg(node % 90) AS lat, avg(node % 70) AS lon, sum(node % 1500)::DOUBLE AS dist, (count(*) * 13 % 29)::DOUBLE AS gain
  FROM way_nodes GROUP BY way_id
), x AS (SELECT *, (row_number() OVER (ORDER BY lat, p) - 1) // 256 AS x_bin FROM c),
y AS (SELECT *, (row_number() OVER (PARTITION BY x_bin ORDER BY lon, p) - 1) // 64 AS y_bin FROM x)"""


def _cands(spark, sf_dir):
    w = fx.ways(spark, sf_dir)
    return w.select(
        F.lit(0).cast("long").alias("job_id"),
        F.col("id").alias("way_id"),
        F.col("id").cast("string").alias("points"),
        F.expr("transform(nodes, n -> cast(n.nodeId % 90 as double))").alias("lats"),
        F.expr("transform(nodes, n -> cast(n.nodeId % 70 as double))").alias("lons"),
        F.expr("cast(aggregate(nodes, 0L, (a, n) -> a + n.nodeId % 1500) as double)").alias("dist"),
        F.expr("cast(size(nodes) * 13 % 29 as double)").alias("gain"),
    )


@query(f"{_CANDS_SQL} SELECT way_id, x_bin, y_bin FROM y")
def w5_g19_g20_bins(spark, sf_dir):
    return rs.bin_candidates(_cands(spark, sf_dir), 1024, rs.Settings()).select("way_id", "x_bin", "y_bin")


@query(f"""{_CANDS_SQL} SELECT way_id, x_bin, y_bin FROM (SELECT *, row_number() OVER (PARTITION BY x_bin, y_bin
ORDER BY floor(dist / 1000) DESC, trunc(gain)::INT DESC, p) AS n FROM y) WHERE n <= 5""")
def w6_t2_t4_best_in_bins(spark, sf_dir):
    binned = rs.bin_candidates(_cands(spark, sf_dir), 1024, rs.Settings())
    return rs.best_in_bins(binned, 5, 1).select("way_id", "x_bin", "y_bin")


#: Candidates that pruning leaves, and rows of a stripe and of a bin for them.
_KEEP, (_STRIPE, _BIN) = 512, rs.bin_shape(512, 64)


@query(f"""{_CANDS_SQL.replace("// 256", f"// {_STRIPE}").replace("// 64", f"// {_BIN}")}, n AS (SELECT count(*) AS n FROM c),
room AS (SELECT n, CASE WHEN n <= {_KEEP} THEN n ELSE greatest(1, {_KEEP} // ((n // {_STRIPE}) * {-(-_STRIPE // _BIN)} + (n % {_STRIPE} + {_BIN - 1}) // {_BIN})) END AS room FROM n)
SELECT way_id FROM (SELECT way_id, row_number() OVER (PARTITION BY x_bin, y_bin ORDER BY floor(dist / 1000) DESC, trunc(gain)::INT DESC, p) AS place FROM y), room WHERE place <= room""")
def g15_g18_g20_pruned(spark, sf_dir):
    """The ways as candidates of one job, pruned to a beam of ``_KEEP``."""
    c = materialize(_cands(spark, sf_dir), "candidates")
    return rs.prune(c, c.count(), _KEEP, _config(), rs.Settings(pruning_strategy="naive")).select("way_id")


# --------------------------------------------------------------------------
# sorts and sets


@query("SELECT id FROM (SELECT id, row_number() OVER (ORDER BY easting // 50, northing // 50, id) AS n FROM nodes) WHERE n <= 1000")
def t1_spatial_chunk(spark, sf_dir):
    return inc.spatial_chunk(fx.nodes(spark, sf_dir), ["id"], 1000, 50).select("id")


@query("SELECT way_id FROM (SELECT way_id, row_number() OVER (ORDER BY g / d DESC NULLS LAST, way_id::VARCHAR) AS n FROM (SELECT way_id, sum(src % 7)::DOUBLE AS g, nullif(sum(src % 11), 0)::DOUBLE AS d FROM edges GROUP BY way_id)) WHERE n <= 50")
def t3_result_order(spark, sf_dir):
    w = fx.plain_edges(spark, sf_dir).groupBy("way_id").agg(F.sum(F.expr("cast(src % 7 as double)")).alias("gain"), F.sum(F.expr("cast(src % 11 as double)")).alias("dist"))
    return w.withColumn("points", F.col("way_id")).orderBy(*rs.result_order(1)).limit(50).select("way_id")


_HAV = geo.haversine_sql("50.2", "-1.7", "lat", "lon")


@query(f"SELECT id, round({_HAV}, 3) AS away FROM nodes ORDER BY {_HAV}, id LIMIT 1")
def t5_nearest_node(spark, sf_dir):
    return rs.nearest_node(fx.nodes(spark, sf_dir), 50.2, -1.7).select("id", F.round("away", 3).alias("away"))


@query("SELECT way_id, string_agg(k, ',' ORDER BY k) AS kinds FROM (SELECT DISTINCT way_id, (node % 4)::VARCHAR AS k FROM way_nodes) GROUP BY way_id")
def t6_sorted_sets(spark, sf_dir):
    n = fx.way_nodes(spark, sf_dir)
    kinds = F.array_sort(F.collect_set((F.col("node") % 4).cast("string")))
    return n.groupBy("way_id").agg(F.array_join(kinds, ",").alias("kinds"))


@query(f"{BOTH} SELECT src, dst, way_id, way_inx::INT AS way_inx FROM both_ways")
def x2_g1_reverse_edges(spark, sf_dir):
    return _both(spark, sf_dir).select("src", "dst", "way_id", "way_inx")


@query("""SELECT a.way_id, round(count(b.k)::DOUBLE / (SELECT count(DISTINCT k2.k) FROM (SELECT node % 8 AS k FROM way_nodes w WHERE w.way_id IN (a.way_id, 1)) k2), 9) AS similarity
FROM (SELECT DISTINCT way_id, node % 8 AS k FROM way_nodes) a LEFT JOIN (SELECT DISTINCT node % 8 AS k FROM way_nodes WHERE way_id = 1) b USING (k) GROUP BY a.way_id""")
def x4_jaccard(spark, sf_dir):
    n = fx.way_nodes(spark, sf_dir)
    sets = n.groupBy("way_id").agg(F.collect_set(F.col("node") % 8).alias("a"))
    one = n.where("way_id = 1").agg(F.collect_set(F.col("node") % 8).alias("b"))
    return sets.join(F.broadcast(one)).select("way_id", F.round(pf.jaccard("a", "b"), 9).alias("similarity"))


# --------------------------------------------------------------------------
# geodesy and search


_F, _A, _B = geo.WGS84_F, geo.WGS84_A, geo.WGS84_A * (1 - geo.WGS84_F)

#: Vincenty's inverse formula as published, seven rounds of it.
_VINCENTY = _chain(
    """(SELECT src, dst, way_id, way_inx, a.lat AS lat1, b.lat AS lat2, radians(b.lon - a.lon) AS big_l
  FROM edges JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst)""",
    {"u1": f"atan((1 - {_F!r}) * tan(radians(lat1)))", "u2": f"atan((1 - {_F!r}) * tan(radians(lat2)))", "r0": "big_l"},
    *[
        stage
        for k in range(7)
        for stage in (
            {
                f"ss{k}": f"sqrt((cos(u2) * sin(r{k})) ** 2 + (cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(r{k})) ** 2)",
                f"cs{k}": f"sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(r{k})",
            },
            {f"sg{k}": f"atan2(ss{k}, cs{k})", f"sa{k}": f"coalesce(cos(u1) * cos(u2) * sin(r{k}) / nullif(ss{k}, 0), 0)"},
            {f"ca{k}": f"1 - sa{k} ** 2"},
            {f"cm{k}": f"coalesce(cs{k} - 2 * sin(u1) * sin(u2) / nullif(ca{k}, 0), 0)", f"cc{k}": f"{_F!r} / 16 * ca{k} * (4 + {_F!r} * (4 - 3 * ca{k}))"},
            {f"r{k + 1}": f"big_l + (1 - cc{k}) * {_F!r} * sa{k} * (sg{k} + cc{k} * ss{k} * (cm{k} + cc{k} * cs{k} * (2 * cm{k} ** 2 - 1)))"},
        )
    ],
    {"uu": f"ca6 * {(_A * _A - _B * _B) / (_B * _B)!r}"},
    {"big_a": "1 + uu / 16384 * (4096 + uu * (-768 + uu * (320 - 175 * uu)))", "big_b": "uu / 1024 * (256 + uu * (-128 + uu * (74 - 47 * uu)))"},
    {"ds": "big_b * ss6 * (cm6 + big_b / 4 * (cs6 * (2 * cm6 ** 2 - 1) - big_b / 6 * cm6 * (4 * ss6 ** 2 - 3) * (4 * cm6 ** 2 - 3)))"},
)


@query(f"SELECT src, dst, way_id, way_inx::INT AS way_inx, round({_B!r} * big_a * (sg6 - ds), 4) AS distance FROM {_VINCENTY}")
def g3_edge_length(spark, sf_dir):
    e = _edges(spark, sf_dir)
    e = geo.with_geodesic(e.drop("tags"), "src_lat", "src_lon", "dst_lat", "dst_lon")
    return e.select("src", "dst", "way_id", "way_inx", F.round("distance", 4).alias("distance"))


def _search_edges(spark, sf_dir):
    """All ways as a graph with lengths in grid steps."""
    e = _simple(spark, sf_dir).select("src", "dst", "distance")
    return net.loaded_graph(fx.nodes(spark, sf_dir), e)[1]


#: The shortest edge of each pair, the node where most of them end, and the
#: least distance to it of every node: rows are kept by node, so it ends.
_HOPS = """, g AS MATERIALIZED (SELECT src, dst, min(abs((dst * 37) % 499 - (src * 37) % 499) + abs((dst * 91) % 491 - (src * 91) % 491))::DOUBLE AS distance
  FROM edges GROUP BY src, dst
), s AS MATERIALIZED (SELECT dst AS id FROM g GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1),
walk(id, dist) USING KEY (id) AS (
  SELECT id, 0::DOUBLE FROM s
  UNION
  SELECT n.id, n.dist FROM (SELECT g.src AS id, min(walk.dist + g.distance) AS dist FROM walk JOIN g ON g.dst = walk.id GROUP BY g.src) n
  LEFT JOIN recurring.walk k ON k.id = n.id WHERE n.dist <= 900 AND (k.dist IS NULL OR n.dist < k.dist)
)"""


@query(f"{_HOPS} SELECT id, dist AS dist_to_start FROM walk", recursive=True)
def g7_g8_distance_to_start(spark, sf_dir):
    return _from_busiest(spark, sf_dir)[1].select("id", "dist_to_start")


def _from_busiest(spark, sf_dir):
    """Edges, and distances to the node where most of them end."""
    e = materialize(_search_edges(spark, sf_dir), "search")
    return e, rs.distances_to(e, _busiest(spark, sf_dir, e), 900.0)


def _busiest(spark, sf_dir, edges):
    """The node where most edges end, as a search begins with it."""
    top = edges.groupBy("dst").count().orderBy(F.col("count").desc(), "dst").first()
    return rs.start_node(rs.tag_start(fx.nodes(spark, sf_dir), top.dst if top else -1))


@query(f"{_HOPS}, near AS (SELECT id FROM walk WHERE dist <= 450) SELECT src, dst FROM g WHERE src IN (SELECT id FROM near) AND dst IN (SELECT id FROM near)", recursive=True)
def f16_reachable(spark, sf_dir):
    e, dist = _from_busiest(spark, sf_dir)
    return rs.reachable(fx.nodes(spark, sf_dir), e, dist, 900.0)[1].select("src", "dst")


def _nation_config(k: int) -> rs.RouteConfig:
    return rs.RouteConfig(49.0 + k * 0.37, -3.3 + k * 0.21, 5000.0 + 900.0 * k, distance_tolerance=0.25)


def _far(bearing: float) -> str:
    """SQL: latitude and longitude where a corner's great circle leads."""
    a, t = f"(({{m}}) / 2 * sqrt(2) / {geo.SPHERE_M})", f"radians({bearing})"
    lat = f"asin(sin(radians(y)) * cos({a}) + cos(radians(y)) * sin({a}) * cos({t}))"
    lon = f"x + degrees(atan2(sin({t}) * sin({a}) * cos(radians(y)), cos({a}) - sin(radians(y)) * sin({lat})))"
    return f"degrees({lat}) AS lat{int(bearing)}, {lon} AS lon{int(bearing)}".replace("{m}", "m")


_PTN = "replace(trunc({0})::INT::VARCHAR, '-', 'n') || '_' || replace(trunc({1})::INT::VARCHAR, '-', 'n')"
_CORNERS = ", ".join(f"({_PTN.format(a, b)})" for a, b in (("lat225", "lon225"), ("lat225", "lon45"), ("lat45", "lon225"), ("lat45", "lon45")))


@query(f"""SELECT k AS job_id, round(lat225, 9) AS min_lat, round(lon225, 9) AS min_lon, round(lat45, 9) AS max_lat, round(lon45, 9) AS max_lon,
  round((lat45 + lat225) / 2, 9) AS centre_lat, array_to_string(list_sort(list_distinct([{_CORNERS}])), ',') AS ptns
FROM (SELECT k, {_far(45.0)}, {_far(225.0)} FROM (
  SELECT n_nationkey::INT AS k, 49.0::DOUBLE + n_nationkey * 0.37::DOUBLE AS y, -3.3::DOUBLE + n_nationkey * 0.21::DOUBLE AS x, (5000.0 + 900.0 * n_nationkey)::DOUBLE * 1.25::DOUBLE AS m FROM nation))""")
def g4_g5_g6_g26_bounding_box(spark, sf_dir):
    rows = []
    for k in sorted(r.k for r in fx.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("k")).collect()):
        c = _nation_config(k)
        south, west, north, east = geo.bounding_box(c.start_lat, c.start_lon, c.max_distance)
        view = geo.viewport([south, north], [west, east])
        rows.append((k, south, west, north, east, view["centre_lat"], ",".join(sorted(geo.partitions_of_box((south, west, north, east))))))
    df = spark.createDataFrame(rows, "job_id int, min_lat double, min_lon double, max_lat double, max_lon double, centre_lat double, ptns string")
    return df.select("job_id", *[F.round(c, 9).alias(c) for c in ("min_lat", "min_lon", "max_lat", "max_lon", "centre_lat")], "ptns")


@query("""SELECT way_id, step, CASE WHEN dst = pts[1] THEN false
  WHEN len(pts) * 100 >= 300 AND len(pts) >= 2 AND list_contains(pts[1:2], dst) AND NOT list_contains(pts[len(pts) - 1:len(pts)], dst) THEN false
  ELSE list_contains(pts, dst) END AS overlaps
FROM (SELECT way_id, pts, unnest(range(1, len(pts) + 1))::INT AS step, unnest(pts) AS dst
  FROM (SELECT way_id, list(node ORDER BY way_inx) AS pts FROM way_nodes GROUP BY way_id))""")
def g10_overlap(spark, sf_dir):
    w = fx.ways(spark, sf_dir).select(F.col("id").alias("way_id"), F.expr("transform(nodes, n -> n.nodeId)").alias("points"))
    w = w.select("way_id", "points", F.posexplode("points").alias("at", "dst"), (F.size("points") * 100).cast("double").alias("dist"))
    return w.select("way_id", (F.col("at") + 1).alias("step"), rs.overlaps("points", "dst", "dist", 300.0, 2).alias("overlaps"))


@query(f"""{TAGGED}, w AS (SELECT way_id, sum((src % 11))::DOUBLE AS dist, sum(CASE WHEN surface = 'grass' THEN src % 11 ELSE 0 END)::DOUBLE AS grass FROM tagged GROUP BY way_id)
SELECT way_id, grass <= 0.25 * 25 AS surfaces_ok, grass <= 0.25 * 25 AND dist BETWEEN 16 AND 25 AS complete FROM w""")
def g11_g12_g27_completion(spark, sf_dir):
    cfg = rs.RouteConfig(0.0, 0.0, 20.0, distance_tolerance=0.25, restricted_surfaces=("grass",), restricted_surfaces_perc=0.25)
    e = tg.highway_and_surface(_edges(spark, sf_dir)).select("way_id", "surface", (F.col("src") % 11).cast("double").alias("d"))
    w = e.groupBy("way_id").agg(F.sum("d").alias("dist"), F.collect_list(F.struct("surface", "d")).alias("steps"))
    total = F.aggregate("steps", F.create_map().cast("map<string,double>"), lambda acc, s: pf.add_surface(acc, s["surface"], s["d"]))
    w = w.withColumn("s_dists", total)
    ok = rs.surfaces_ok("s_dists", cfg)
    return w.select("way_id", ok.alias("surfaces_ok"), (ok & F.col("dist").between(cfg.min_distance, cfg.max_distance)).alias("complete"))


#: The graph of all ways, in both directions, the shortest edge of each pair.
_TWO_WAY = """, two_way AS MATERIALIZED (
  SELECT src, dst, (abs((dst * 37) % 499 - (src * 37) % 499) + abs((dst * 91) % 491 - (src * 91) % 491))::DOUBLE AS d FROM edges
), g AS MATERIALIZED (
  SELECT src, dst, min(d) AS distance FROM (SELECT src, dst, d FROM two_way UNION ALL SELECT dst, src, d FROM two_way) GROUP BY src, dst
)"""

_STEPS = f"""{_TWO_WAY}, one AS MATERIALIZED (SELECT src AS start, dst AS cur, distance AS dist FROM g WHERE distance + (dst % 11) * 10 <= 625),
two AS (SELECT one.start, one.cur AS via, g.dst AS cur, one.dist + g.distance AS dist,
  CASE WHEN one.dist + g.distance + CASE WHEN g.dst = one.start THEN 0 ELSE (g.dst % 11) * 10 END > 625 THEN 'invalid'
       WHEN g.dst = one.start THEN CASE WHEN one.dist + g.distance >= 400 THEN 'complete' ELSE 'invalid' END ELSE 'valid' END AS status
FROM one JOIN g ON g.src = one.cur)"""


def _two_way(spark, sf_dir):
    e = _simple(spark, sf_dir).select("src", "dst", "distance")
    return e.union(e.select("dst", "src", "distance")).groupBy("src", "dst").agg(F.min("distance").alias("distance"))


def _with_geometry(edges):
    """Stand-ins for the columns of an edge that a search carries along."""
    line = F.array(F.lit(0.0), F.lit(1.0))
    flat = {"elevation_gain": (F.col("src") % 7).cast("double"), "elevation_loss": (F.col("dst") % 5).cast("double")}
    return edges.withColumns({**flat, "surface": F.lit("grass"), **{c: line for c in ("lats", "lons", "eles", "dists")}})


@query(f"{_STEPS} SELECT * FROM two")
def g9_g13_g14_g25_j13_two_steps(spark, sf_dir):
    return _two_steps(spark, sf_dir).select("start", F.element_at("points", -2).alias("via"), "cur", "dist", "status")


def _two_steps(spark, sf_dir):
    cfg = rs.RouteConfig(0.0, 0.0, 500.0, distance_tolerance=0.25)
    e = _with_geometry(_two_way(spark, sf_dir)).withColumn("dist_to_start", ((F.col("dst") % 11) * 10).cast("double"))
    e = materialize(e, "two-steps")
    starts = e.select(F.col("src").alias("job_id"), F.col("src").alias("id")).distinct()
    one = rs.take_steps(rs.seeds(starts), e, cfg, rs.Settings()).where("status = 'valid'").drop("status")
    return rs.take_steps(one, e, cfg, rs.Settings())


@query(f"{_STEPS} SELECT status, count(*) AS n, round(avg(dist), 6) AS mean_dist FROM two GROUP BY status")
def a10_progress(spark, sf_dir):
    out = rs.step_totals(_two_steps(spark, sf_dir))
    return out.select("status", "n", F.round("mean_dist", 6).alias("mean_dist"))


_LOOP = rs.RouteConfig(0.0, 0.0, LOOP_M, distance_tolerance=0.25)
_LO, _HI = repr(_LOOP.min_distance), repr(_LOOP.max_distance)

#: What a search from the node where most edges end can use, and its steps.
_GRAPH = f"""{_TWO_WAY}, s AS MATERIALIZED (SELECT dst AS id FROM g GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1),
home(id, dist) USING KEY (id) AS (
  SELECT id, 0::DOUBLE FROM s
  UNION
  SELECT n.id, n.dist FROM (SELECT g.src AS id, min(home.dist + g.distance) AS dist FROM home JOIN g ON g.dst = home.id GROUP BY g.src) n
  LEFT JOIN recurring.home k ON k.id = n.id WHERE n.dist <= {_HI} AND (k.dist IS NULL OR n.dist < k.dist)
), near AS MATERIALIZED (SELECT id, dist FROM home WHERE dist <= {_HI} / 2),
e AS MATERIALIZED (SELECT g.*, b.dist AS back FROM g JOIN near a ON a.id = g.src JOIN near b ON b.id = g.dst)"""

_WALK = f"""walk(start, cur, pts, dist, gain, loss) AS (
  SELECT id, id, [id], 0::DOUBLE, 0::DOUBLE, 0::DOUBLE FROM s
  UNION ALL
  SELECT start, e.dst, list_append(pts, e.dst), walk.dist + e.distance, gain + e.src % 7, loss + e.dst % 5 FROM walk JOIN e ON e.src = cur
  WHERE (len(pts) = 1 OR cur <> start) AND walk.dist + e.distance + e.back <= {_HI} {{0}}
    AND (e.dst = start OR NOT list_contains(pts, e.dst)
         OR (walk.dist >= {_LO} AND len(pts) >= 3 AND list_contains(pts[1:3], e.dst) AND NOT list_contains(pts[len(pts) - 2:len(pts)], e.dst)))
    AND (e.dst <> start OR walk.dist + e.distance >= {_LO})
)"""

#: Every circular route, by walking all of them.
_LOOPS = f"{_GRAPH}, {_WALK.format('')} SELECT array_to_string(pts, ',') AS points, dist, gain, loss FROM walk WHERE len(pts) > 1 AND cur = start"


@query(_LOOPS, recursive=True)
def g7_g9_g14_g16_g25_all_loops(spark, sf_dir):
    start, e = _loop_graph(spark, sf_dir)
    out = rs.all_loops(e, start, _LOOP)
    out = spark.createDataFrame([], rs.CANDIDATE) if out is None else out
    return out.select(F.array_join("points", ",").alias("points"), "dist", "gain", "loss")


def _loop_graph(spark, sf_dir):
    """Where the loops begin, and the edges that they can use."""
    e = materialize(_two_way(spark, sf_dir), "two-way")
    start = _busiest(spark, sf_dir, e)
    e = rs.search_graph(e, fx.nodes(spark, sf_dir), start, _LOOP.max_distance)
    return start, materialize(_with_geometry(e), "loop-edges")


@query(f"""{_GRAPH}, {_WALK.format("AND len(pts) < 4")},
cands AS MATERIALIZED (SELECT row_number() OVER () AS cid, * FROM walk WHERE len(pts) = 4 AND cur <> start),
way(cid, at_node, dist) USING KEY (cid, at_node) AS (
  SELECT cid, cur, 0::DOUBLE FROM cands
  UNION
  SELECT n.cid, n.id, n.dist FROM (
    SELECT way.cid, e.dst AS id, min(way.dist + e.distance) AS dist FROM way JOIN cands c ON c.cid = way.cid JOIN e ON e.src = way.at_node
    WHERE way.at_node <> c.start AND (e.dst = c.start OR NOT list_contains(c.pts, e.dst)) AND c.dist + way.dist + e.distance < {_HI}
    GROUP BY way.cid, e.dst
  ) n LEFT JOIN recurring.way k ON k.cid = n.cid AND k.at_node = n.id WHERE k.dist IS NULL OR n.dist < k.dist
)
SELECT array_to_string(pts, ',') AS points, c.dist FROM cands c JOIN way ON way.cid = c.cid AND way.at_node = c.start""", recursive=True)
def g23_return_paths(spark, sf_dir):
    """Of the candidates after three steps, those that get home by another way."""
    start, e = _loop_graph(spark, sf_dir)
    front = rs.seeds(start)
    for _ in range(3):
        front = materialize(rs.take_steps(front, e, _LOOP, rs.Settings()).where("status = 'valid'").drop("status"), "steps")
    return rs.return_paths(front, e, 1, _LOOP.max_distance).select(F.array_join("points", ",").alias("points"), "dist")


@query("SELECT n_nationkey::INT AS n_edges, a::INT AS attempt, least(n_nationkey * a * a, 64)::INT AS width FROM nation, range(1, 4) t(a)")
def g15_g17_beam_width(spark, sf_dir):
    rows = [(r.k, a, rs.beam_width(r.k, a, 64)) for r in fx.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("k")).collect() for a in (1, 2, 3)]
    return spark.createDataFrame(rows, "n_edges int, attempt int, width int")


def _lattice(spark, sf_dir):
    """A grid of as many streets as customers allow: a graph with many loops."""
    n = fx.table(spark, sf_dir, "customer").count()
    side = max(6, int(n**0.5))
    cells = spark.range(side * side).select(F.col("id"), (F.col("id") % side).cast("int").alias("x"), F.floor(F.col("id") / side).cast("int").alias("y"))
    node = cells.select("id", (F.lit(50.2) + F.col("y") * 0.001).alias("lat"), (F.lit(-1.7) + F.col("x") * 0.0015).alias("lon"), ((F.col("x") * 7 + F.col("y") * 13) % 40).cast("double").alias("elevation"))
    node = node.withColumn("ptn", geo.partition_key("lat", "lon"))
    right = cells.where(f"x < {side - 1}").select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    up = cells.where(f"y < {side - 1}").select(F.col("id").alias("src"), (F.col("id") + side).alias("dst"))
    e = right.union(up)
    e = e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    a, b = node.select(*[F.col(c).alias(f"a_{c}") for c in node.columns]), node.select(*[F.col(c).alias(f"b_{c}") for c in node.columns])
    e = e.join(a, F.col("src") == F.col("a_id")).join(b, F.col("dst") == F.col("b_id"))
    rise = F.col("b_elevation") - F.col("a_elevation")
    return node, e.select(
        "src", "dst", F.col("a_lat").alias("src_lat"), F.col("a_lon").alias("src_lon"), F.col("a_ptn").alias("ptn"),
        F.lit("footway").alias("highway"), F.when(F.col("src") % 3 == 0, "grass").otherwise("asphalt").alias("surface"),
        F.lit(100.0).alias("distance"), F.greatest(rise, F.lit(0.0)).alias("elevation_gain"), F.greatest(-rise, F.lit(0.0)).alias("elevation_loss"),
        F.array("a_lat", "b_lat").alias("lats"), F.array("a_lon", "b_lon").alias("lons"), F.array("a_elevation", "b_elevation").alias("eles"),
        F.array(F.lit(0.0), F.lit(100.0)).alias("dists"),
    )


def _loop_config(mode: str = "hilly", **restricted) -> rs.RouteConfig:
    """A loop on the network, whose ways go far: a step is 40 km on average."""
    return rs.RouteConfig(50.2, -1.7, 100_000.0, mode, 0.25, **restricted)


def _network(spark, sf_dir):
    """The optimised tables with the lengths of edges in metres."""
    n, e = _optimised(spark, sf_dir, metres=True)
    return materialize(n, "network-nodes"), e


@query()
def g16_g18_route_search_naive(spark, sf_dir):
    out = rs.find_routes(spark, *_network(spark, sf_dir), _loop_config(), rs.Settings(pruning_strategy="naive"))
    return out.select("id", "dist", "gain", "loss", F.array_join("points", ",").alias("points"))


@query()
def g21_g24_route_search_fuzzy(spark, sf_dir):
    cfg = _loop_config("flat", restricted_surfaces=("grass",), restricted_surfaces_perc=0.5)
    out = rs.find_routes(spark, *_network(spark, sf_dir), cfg, rs.Settings())
    return out.select("id", "dist", "gain", "bbox.min_lat", "bbox.max_lat", "centre.lat", F.array_join("points", ",").alias("points"))


# --------------------------------------------------------------------------
# incremental load


@query(f"""{_KEYED} SELECT src, dst, way_id, timestamp FROM landed l WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.src = l.src AND k.dst = l.dst AND k.timestamp >= l.timestamp)
UNION ALL SELECT k.src, k.dst, k.way_id, k.timestamp FROM kept k JOIN landed l USING (src, dst) WHERE k.timestamp >= l.timestamp""")
def u1_u2_u3_u6_refresh(spark, sf_dir):
    landed, staged = _keyed(fx.plain_edges(spark, sf_dir)), _keyed(fx.staged_edges(spark, sf_dir))
    table = inc.SnapshotTable(spark, scratch_path(spark, "refresh"), staged.schema)
    assert not table.exists()
    table.write(staged)
    table.write(inc.refresh(table.read(), landed, ["src", "dst"], lambda rows: rows), files=4)
    table.vacuum()
    return table.read().select("src", "dst", "way_id", "timestamp")


@query(f"""{_KEYED} SELECT src, dst, way_id, timestamp FROM landed l WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.src = l.src AND k.dst = l.dst AND k.timestamp >= l.timestamp)
UNION ALL SELECT k.src, k.dst, k.way_id, k.timestamp FROM kept k JOIN landed l USING (src, dst) WHERE k.timestamp >= l.timestamp""")
def u2_u3_partitions(spark, sf_dir):
    """The same load as a change of the partitions that it touches."""
    landed, staged = _keyed(fx.plain_edges(spark, sf_dir)), _keyed(fx.staged_edges(spark, sf_dir))
    part = F.expr("concat((src * 37) % 499 div 50, '_', (src * 91) % 491 div 50)")
    table = inc.SnapshotTable(spark, scratch_path(spark, "parts"), staged.schema, part)
    base = table.write(staged)
    now = table.read()
    table.change(["src", "dst"], inc.changes(landed, now, ["src", "dst"]), inc.removals(now, landed, ["src", "dst"]), base)
    return table.read().select("src", "dst", "way_id", "timestamp")


@query(f"{_KEYED} SELECT src, dst FROM kept WHERE src > 0")
def u3_delete(spark, sf_dir):
    staged = _keyed(fx.staged_edges(spark, sf_dir))
    return inc.delete(staged, staged.where("src <= 0").select("src", "dst"), ["src", "dst"]).select("src", "dst")


@query("SELECT string_agg(file_id, ',' ORDER BY file_id) AS manifest FROM bounds")
def u5_s2_manifest(spark, sf_dir):
    now = files.manifest(fx.bounds(spark, sf_dir))
    path = scratch_path(spark, "manifest")
    text = now.first().manifest
    assert files.changed(spark, path, text)
    files.remember(spark, path, text)
    assert not files.changed(spark, path, text)
    return now


# --------------------------------------------------------------------------
# whole plans


_SANE = f"""{TAGGED}{FLAGS}{PLACED.format('edges')}{SAMPLES}{PROFILES}, sane AS MATERIALIZED (
  SELECT f.src, f.dst, f.way_id, f.way_inx, f.highway, f.surface, f.oneway, CASE WHEN bridge IS NOT NULL THEN 0 ELSE gain END AS g, CASE WHEN bridge IS NOT NULL THEN 0 ELSE loss END AS l
  FROM flagged f JOIN profiles p USING (src, dst, way_id, way_inx) WHERE whole AND {ACCESS} AND {SAFE}
), sane_both AS MATERIALIZED (
  SELECT src, dst, way_id, way_inx, highway, surface, g, l FROM sane UNION ALL
  SELECT dst, src, -way_id, -way_inx, highway, surface, l, g FROM sane WHERE oneway IS NULL OR oneway = 'no'
)"""


@query(f"{_SANE} SELECT src, dst, way_id, way_inx::INT AS way_inx, highway, surface, g AS elevation_gain, l AS elevation_loss FROM sane_both")
def plan_sanitised_edges(spark, sf_dir):
    out = ingest.load_edges(_edges(spark, sf_dir), fx.elevation(spark, sf_dir), fx.bounds(spark, sf_dir), F.lit(1.0))
    return out.select("src", "dst", "way_id", "way_inx", "highway", "surface", "elevation_gain", "elevation_loss")


def _optimised(spark, sf_dir, metres=False):
    cells, tiles = fx.elevation(spark, sf_dir), fx.bounds(spark, sf_dir)
    e = materialize(ingest.load_edges(_edges(spark, sf_dir), cells, tiles, None if metres else F.lit(1.0)), "sanitised")
    return ingest.optimise(ingest.load_nodes(fx.nodes(spark, sf_dir), e, cells, tiles), e)


_OPT = f"""{_SANE}{LINKS.format('sane_both')}{CHAINS.replace('FROM edges e', 'FROM sane_both e')}, opt AS (
  SELECT chain_src AS src, chain_dst AS dst, sum(g) AS elevation_gain, sum(l) AS elevation_loss, count(*)::DOUBLE AS distance,
    CASE WHEN count(DISTINCT highway) = 1 THEN min(highway) ELSE 'unclassified' END AS highway,
    CASE WHEN count(DISTINCT surface) = 1 THEN min(surface) ELSE 'unclassified' END AS surface,
    arg_min(CASE WHEN src_degree = 1 THEN 1 ELSE 0 END, way_inx) AS sd, arg_max(CASE WHEN dst_degree = 1 THEN 1 ELSE 0 END, way_inx) AS dd,
    count(*) + 1 AS n_points
  FROM filled GROUP BY chain_src, chain_dst
)"""


@query(f"{_OPT} SELECT src, dst, elevation_gain, elevation_loss, distance, highway, surface, n_points FROM opt WHERE sd = 0 AND dd = 0")
def plan_f12_optimised_edges(spark, sf_dir):
    e = _optimised(spark, sf_dir)[1]
    return e.select("src", "dst", "elevation_gain", "elevation_loss", "distance", "highway", "surface", F.size("lats").cast("long").alias("n_points"))


@query(f"""{_OPT} SELECT id, e.elevation, CASE WHEN easting = 0 THEN '50_n2' ELSE '50_n1' END AS ptn FROM nodes JOIN elevation e USING (easting, northing)
WHERE id IN (SELECT src FROM opt WHERE sd = 0 AND dd = 0 UNION ALL SELECT dst FROM opt WHERE sd = 0 AND dd = 0)""")
def plan_optimised_nodes(spark, sf_dir):
    return _optimised(spark, sf_dir)[0].select("id", "elevation", "ptn")


_FLAGSHIP = f"{BOTH}{LINKS.format('both_ways')} SELECT id, in_degree, out_degree, degree FROM degrees ORDER BY degree DESC, id LIMIT 20"


@query(_FLAGSHIP)
def flagship_busiest_junctions(spark, sf_dir):
    return net.node_degrees(_both(spark, sf_dir)).orderBy(F.col("degree").desc(), "id").limit(20)
