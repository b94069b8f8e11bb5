"""Rasters, tiles, and elevation along edges (S12, S14-S16, S18-S20, S22, J6-J9,
P8, P11, G2, A2, A4, F2, F14, F15)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.profile import climb, counted_steps, sample_points, step_metrics, whole_or_null
from ridgeline.runtime import materialize, spread
from ridgeline.schema import layer_schema, map_to_schema

#: Side of the cells that tiles are cut into for the range join.
CELL = 1000
#: Side of the squares in which edges meet the raster, metres.
SQUARE = 128


def bounds_from_xml(tiles: DataFrame, xml: str = "xml") -> DataFrame:
    """``min_easting, min_northing, max_easting, max_northing`` from corner
    positions; rows without any corner are NULL, a malformed number raises."""
    number = lambda i: F.transform("__pos", lambda c: F.split(F.trim(c), "\\s+")[i].cast("double").cast("int"))
    out = tiles.withColumn("__pos", F.xpath(F.col(xml), F.lit("//spatRepInfo/Georect/cornerPts/pos/text()")))
    out = out.withColumns({"__e": number(0), "__n": number(1)})
    return out.withColumns(
        {
            "min_easting": F.array_min("__e"),
            "min_northing": F.array_min("__n"),
            "max_easting": F.array_max("__e"),
            "max_northing": F.array_max("__n"),
        }
    ).drop("__pos", "__e", "__n")


def valid_rasters(tiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tiles whose rows fill their box, and the others."""
    width, height = F.col("max_easting") - F.col("min_easting"), F.col("max_northing") - F.col("min_northing")
    fits = (F.size("raster") == height) & F.forall("raster", lambda r: F.size(r) == width)
    fits = F.coalesce(fits, F.lit(False))
    return tiles.where(fits), tiles.where(~fits)


def melt_raster(tiles: DataFrame) -> DataFrame:
    """``file_id, easting, northing, elevation`` of every cell of
    ``raster array<array>``. The first row is the northernmost."""
    rows = tiles.select("file_id", "min_easting", "max_northing", F.posexplode("raster").alias("row", "cells"))
    cells = rows.select("file_id", "min_easting", "max_northing", "row", F.posexplode("cells").alias("col", "elevation"))
    cells = cells.select(
        "file_id",
        (F.col("min_easting") + F.col("col")).alias("easting"),
        (F.col("max_northing") - 1 - F.col("row")).alias("northing"),
        "elevation",
    )
    return map_to_schema(cells, layer_schema("landing", "elevation").add("file_id", "string"))


def merge_bounds(old: DataFrame | None, new: DataFrame) -> DataFrame:
    return new.distinct() if old is None else old.unionByName(new).distinct()


def assign_tiles(points: DataFrame, bounds: DataFrame, e: str = "easting", n: str = "northing") -> DataFrame:
    """Points with the ``file_id`` of the half-open tiles they lie in.

    Tiles are cut into cells of ``CELL``; points meet them by cell, an equi
    join that needs no broadcast, and the box is checked again.
    """
    span = lambda a, b: F.sequence(F.floor(F.col(a) / CELL), F.floor((F.col(b) - 1) / CELL))
    cells = bounds.withColumn("__ce", F.explode(span("min_easting", "max_easting")))
    cells = cells.withColumn("__cn", F.explode(span("min_northing", "max_northing")))
    keyed = points.withColumns({"__ce": F.floor(F.col(e) / CELL), "__cn": F.floor(F.col(n) / CELL)})
    inside = (
        (F.col(e) >= F.col("min_easting")) & (F.col(e) < F.col("max_easting"))
        & (F.col(n) >= F.col("min_northing")) & (F.col(n) < F.col("max_northing"))
    )
    return keyed.join(cells, ["__ce", "__cn"]).where(inside).select(*points.columns, "file_id")


def tiles_of_edges(edges: DataFrame, bounds: DataFrame) -> DataFrame:
    """Distinct ``file_id`` of tiles at either end of an edge: each edge gives
    two points, so no disjunction is joined on."""
    point = lambda end: F.struct(F.col(f"{end}_easting").alias("easting"), F.col(f"{end}_northing").alias("northing"))
    ends = edges.select(F.inline(F.array(point("src"), point("dst"))))
    return assign_tiles(ends, bounds).select("file_id").distinct()


#: So many tile ids, counted first, are broadcast to the raster that they prune.
FEW = 100_000


def _few(df: DataFrame, name: str) -> DataFrame:
    """``df`` stored, to be broadcast if it has no more than ``FEW`` narrow rows."""
    df = materialize(df, name)
    return F.broadcast(df) if df.count() <= FEW else df


def read_tiles(elevation: DataFrame, tiles: DataFrame) -> DataFrame:
    """The elevation of the named tiles. On a table partitioned by ``file_id``
    Spark prunes partitions at run time from the join's other side."""
    return elevation.join(_few(tiles.select("file_id").distinct(), "tile-ids"), "file_id", "left_semi")


def cells_around(squares: DataFrame, elevation: DataFrame, bounds: DataFrame) -> DataFrame:
    """One row a cell of the ``squares``, ``be, bn``; tiles that hold none of
    them are not read. Tiles that overlap give a cell its lowest elevation."""
    squares = _few(squares.distinct(), "squares")
    span = lambda a, b: F.sequence(F.floor(a / CELL), F.floor(b / CELL))
    over = lambda c: span(F.col(c) * SQUARE, F.col(c) * SQUARE + (SQUARE - 1))
    met = squares.select(F.explode(over("be")).alias("__ce"), "bn").select("__ce", F.explode(over("bn")).alias("__cn")).distinct()
    tiles = bounds.select("file_id", F.explode(span(F.col("min_easting"), F.col("max_easting") - 1)).alias("__ce"), "min_northing", "max_northing")
    tiles = tiles.select("file_id", "__ce", F.explode(span(F.col("min_northing"), F.col("max_northing") - 1)).alias("__cn"))
    cells = read_tiles(elevation, tiles.join(met, ["__ce", "__cn"], "left_semi"))
    return distinct_elevation(cells.withColumns(_square("easting", "northing")).join(squares, ["be", "bn"], "left_semi"))


def _square(e: str, n: str) -> dict[str, Column]:
    """The square of a point."""
    return {"be": F.floor(F.col(e) / SQUARE).cast("int"), "bn": F.floor(F.col(n) / SQUARE).cast("int")}


def squares_of_points(points: DataFrame) -> DataFrame:
    return points.select([c.alias(k) for k, c in _square("easting", "northing").items()])


def squares_of_edges(edges: DataFrame) -> DataFrame:
    return edge_squares(edges.select(*[f"{end}_{c}" for end in ("src", "dst") for c in ("easting", "northing")])).select("be", "bn")


def distinct_elevation(elevation: DataFrame) -> DataFrame:
    """One row a cell: where tiles overlap, the lowest."""
    return elevation.groupBy("easting", "northing").agg(F.min("elevation").alias("elevation"))


def node_elevation(nodes: DataFrame, elevation: DataFrame, rows: int = 0) -> DataFrame:
    """Nodes with the elevation of their cell, NULL where there is none. Many
    nodes, if they were counted as ``rows``, are spread by cell, and the cells
    with them, which may lie so over fewer partitions."""
    cell = ["easting", "northing"]
    return spread(nodes, rows, *cell).join(spread(elevation.select(*cell, "elevation"), rows, *cell), cell, "left")


def edge_steps(edges: DataFrame) -> DataFrame:
    return edges.withColumns(step_metrics("src_easting", "src_northing", "dst_easting", "dst_northing"))


def explode_edges(edges: DataFrame) -> DataFrame:
    """A row for each sample of an edge with ``edge_steps``: ``edge_inx``, and
    integer ``easting`` and ``northing`` (rounded)."""
    points = sample_points(
        F.col("edge_steps"), F.col("src_easting"), F.col("src_northing"), F.col("dst_easting"), F.col("dst_northing")
    )
    out = edges.select(*edges.columns, F.explode(points).alias("__p"))
    return out.select(
        *edges.columns,
        F.col("__p.inx").alias("edge_inx"),
        F.round("__p.easting").cast("int").alias("easting"),
        F.round("__p.northing").cast("int").alias("northing"),
    )


def sample_elevation(samples: DataFrame, elevation: DataFrame) -> DataFrame:
    return samples.join(elevation.select("easting", "northing", "elevation"), ["easting", "northing"], "left")


def implode_edges(samples: DataFrame, carry: list[str]) -> DataFrame:
    """Samples back to edges with an elevation array, NULL if a sample is.

    The way and place are part of the key, so edges that share both nodes do
    not mix.
    """
    keys = ["src", "dst", "way_id", "way_inx"]
    keys = [k for k in keys if k in samples.columns]
    other = [c for c in carry if c not in keys]
    out = samples.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in other],
        F.transform(F.sort_array(F.collect_list(F.struct("edge_inx", "elevation"))), lambda p: p["elevation"]).alias("elevation"),
    )
    return out.withColumn("elevation", whole_or_null(F.col("elevation")))


#: Edges of a square, about, that go to one group: more of them go to several.
GROUP = 1 << 16
#: Edges of a group that are sampled at once.
_EDGES = 1 << 13
_KEY = ["src", "dst", "way_id", "way_inx"]
_PART = "src long, dst long, way_id long, way_inx int, first int, missing boolean, heights array<double>"


def edge_squares(edges: DataFrame) -> DataFrame:
    """A row for each edge with ``edge_steps`` and each square, ``be, bn``, that
    its samples can lie in: column by column of squares, the rows that the line
    crosses there, with half a metre more for rounding."""
    se, sn, de, dn = (F.col(f"{end}_{c}") for end in ("src", "dst") for c in ("easting", "northing"))
    squares = lambda a, b: F.sequence(F.floor(a / SQUARE).cast("int"), F.floor(b / SQUARE).cast("int"))
    out = edges.select("*", F.explode(squares(F.least(se, de), F.greatest(se, de))).alias("be"))

    def at(e):
        """Northing where the line passes an easting, at most where it ends."""
        e = F.greatest(F.least(se, de), F.least(F.greatest(se, de), e))
        return sn + (dn - sn) * F.coalesce(F.try_divide(e - se, de - se), F.lit(0.0))

    into, out_of = at(F.col("be") * SQUARE - 0.5), at(F.col("be") * SQUARE + (SQUARE - 0.5))
    # A line from south to north stays in one column, from end to end.
    low = F.when(se == de, F.least(sn, dn)).otherwise(F.least(into, out_of)) - 0.5
    high = F.when(se == de, F.greatest(sn, dn)).otherwise(F.greatest(into, out_of)) + 0.5
    return out.select("*", F.explode(squares(low, high)).alias("bn"))


def _half_up(x: np.ndarray) -> np.ndarray:
    """Rounded to whole numbers, halves away from zero, as ``round`` does."""
    whole = np.trunc(x)
    return (whole + np.where(np.abs(x - whole) >= 0.5, np.sign(x), 0.0)).astype(np.int64)


def _within(a: np.ndarray, b: np.ndarray, steps: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last place along each edge, from 0 to ``steps``, that can
    lie in a square which begins at ``low``: a metre more than rounding needs."""
    with np.errstate(divide="ignore", invalid="ignore"):
        ends = [(edge - a) / (b - a) * steps for edge in (low - 1.5, low + SQUARE + 0.5)]
    level = a == b
    first = np.where(level, 0, np.ceil(np.clip(np.minimum(*ends), 0, steps + 1)))
    last = np.where(level, steps, np.floor(np.clip(np.maximum(*ends), -1, steps)))
    return first.astype(np.int64), last.astype(np.int64)


def _sampled(columns: dict[str, np.ndarray], be: int, bn: int, grid: np.ndarray) -> pa.Table:
    """The stretch of each edge whose samples lie in a square, with its heights.
    Samples far from the square are not made, however long the edge."""
    most = np.maximum(columns["edge_steps"].astype(np.int64) - 1, 1)
    ends = {k: columns[k].astype(np.int64) for k in columns if k.endswith("ing")}
    first_e, last_e = _within(ends["src_easting"], ends["dst_easting"], most, be * SQUARE)
    first_n, last_n = _within(ends["src_northing"], ends["dst_northing"], most, bn * SQUARE)
    low = np.maximum(first_e, first_n)
    n = np.maximum(np.minimum(last_e, last_n) - low + 1, 0)
    edge = np.repeat(np.arange(len(n)), n)
    inx = np.arange(len(edge)) - np.repeat(np.cumsum(n) - n - low, n)
    steps = most[edge]

    def along(a: str, b: str) -> np.ndarray:
        a, b = ends[a][edge], ends[b][edge]
        return _half_up(np.where(inx == 0, a, np.where(inx == steps, b, a + (b - a) / steps * inx)))

    e, h = along("src_easting", "dst_easting") - be * SQUARE, along("src_northing", "dst_northing") - bn * SQUARE
    inside = (e >= 0) & (e < SQUARE) & (h >= 0) & (h < SQUARE)
    edge, inx, value = edge[inside], inx[inside], grid[e[inside], h[inside]]
    # Along a line both coordinates only grow or only fall, so a stretch has no gaps.
    first = np.flatnonzero(np.diff(edge, prepend=-1))
    known = np.isfinite(value)
    missing = np.bincount(np.cumsum(np.diff(edge, prepend=-1) > 0) - 1, ~known, len(first)) > 0 if len(edge) else np.empty(0, dtype=bool)
    offsets = np.append(first, len(edge)).astype(np.int32)
    heights = pa.ListArray.from_arrays(pa.array(offsets), pa.array(value, mask=~known))
    rows = edge[first]
    return pa.table(
        [*[pa.array(columns[k][rows]) for k in _KEY], pa.array(inx[first].astype(np.int32)), pa.array(missing), heights],
        names=[f.split()[0] for f in _PART.split(", ")],
    )


def _heights(key: tuple, edges: pa.Table, cells: pa.Table) -> pa.Table:
    """Edges of one square, or a deal of them, and its raster cells; of a cell that
    is there more than once the lowest counts."""
    be, bn, _ = (k.as_py() for k in key)
    names = [*_KEY, "edge_steps", "src_easting", "src_northing", "dst_easting", "dst_northing"]
    grid = np.full((SQUARE, SQUARE), np.inf)
    if cells.num_rows:
        e, n, h = (cells[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("easting", "northing", "elevation"))
        np.minimum.at(grid, (e - be * SQUARE, n - bn * SQUARE), np.where(np.isnan(h), np.inf, h))
    columns = {c: edges[c].combine_chunks().to_numpy() if edges.num_rows else np.empty(0, np.int64) for c in names}
    parts = [_sampled({c: v[i : i + _EDGES] for c, v in columns.items()}, be, bn, grid) for i in range(0, max(1, edges.num_rows), _EDGES)]
    return pa.concat_tables(parts).cast(_PART_SCHEMA)


_PART_SCHEMA = pa.schema(
    [("src", pa.int64()), ("dst", pa.int64()), ("way_id", pa.int64()), ("way_inx", pa.int32()), ("first", pa.int32()), ("missing", pa.bool_()), ("heights", pa.list_(pa.float64()))]
)


def profiles(edges: DataFrame, elevation: DataFrame) -> DataFrame:
    """``src, dst, way_id, way_inx, elevation``: the profile of each edge, NULL
    if a sample has no elevation.

    Edges meet the raster by square, each as one narrow row a square that it
    crosses; its samples come into being beside the square's cells, and leave as
    a stretch of the profile. So what is shuffled goes with the edges and the
    cells, which ``cells_around`` has cut to the squares, not with the samples.

    The edges of each square are counted first. A square of more than ``GROUP``
    is dealt over several groups, each with all of its cells, so no task holds
    more at once however many edges cross a square. Groups and stretches are
    spread by the same count over as many partitions as they need.
    """
    placed = edge_squares(edge_steps(edges.select(*_KEY, *[f"{end}_{c}" for end in ("src", "dst") for c in ("easting", "northing")])))
    placed = placed.drop("edge_size", "edge_size_h", "edge_size_v")
    counted = materialize(placed.groupBy("be", "bn").agg(F.count("*").alias("n")), "counted")
    rows = counted.agg(F.sum("n")).first()[0] or 0
    dealt = _few(counted.select("be", "bn", F.ceil(F.col("n") / GROUP).cast("int").alias("deals")).where("deals > 1"), "crowded")
    hand = F.pmod(F.xxhash64(*_KEY), F.coalesce("deals", F.lit(1))).cast("int")
    placed = placed.join(dealt, ["be", "bn"], "left").withColumn("deal", hand).drop("deals")
    cells = elevation.select("easting", "northing", "elevation").withColumns(_square("easting", "northing")).join(dealt, ["be", "bn"], "left")
    cells = cells.withColumn("deal", F.explode(F.sequence(F.lit(0), F.coalesce("deals", F.lit(1)) - 1))).drop("deals")
    placed = spread(placed, rows, "be", "bn", "deal")
    parts = placed.groupBy("be", "bn", "deal").cogroup(cells.groupBy("be", "bn", "deal")).applyInArrow(_heights, _PART)
    parts = spread(parts, rows, *_KEY)
    whole = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("first", "heights"))), lambda p: p["heights"]))
    return parts.groupBy(*_KEY).agg(F.max("missing").alias("missing"), whole.alias("elevation")).select(
        *_KEY, F.when(~F.col("missing"), F.col("elevation")).alias("elevation")
    )


def tag_edges(edges: DataFrame, elevation: DataFrame) -> DataFrame:
    """Edges with their elevation profile. Tags and coordinates do not travel
    with the samples; they join again."""
    return edges.join(profiles(edges, elevation), _KEY)


def drop_without_elevation(edges: DataFrame) -> DataFrame:
    return edges.where("elevation IS NOT NULL")


def elevation_changes(edges: DataFrame) -> DataFrame:
    """``elevation_gain`` and ``elevation_loss`` of a profile with ``is_flat``."""
    out = edges.withColumn("__steps", counted_steps(F.col("elevation")))
    both = {"elevation_gain": climb(F.col("__steps"), F.col("is_flat"), 1), "elevation_loss": climb(F.col("__steps"), F.col("is_flat"), -1)}
    return out.withColumns(both).drop("__steps")
