"""The batch load from raw ways to a contracted graph, layer by layer."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ridgeline.functions.geo import partition_key, with_geodesic, with_national_grid
from ridgeline.operators import contract, elevation, network, tags
from ridgeline.runtime import materialize
from ridgeline.schema import layer_schema, map_to_schema


def land_nodes(raw: DataFrame) -> DataFrame:
    """Raw ``id, latitude, longitude, timestamp`` with grid coordinates, cut to
    whole metres by the cast to the schema."""
    grid = with_national_grid(tags.rename_coordinates(raw), "lat", "lon")
    return map_to_schema(grid, layer_schema("landing", "nodes"))


def land_edges(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of roads and paths with both ends' coordinates; ``ways`` with
    unpacked tags."""
    edges = network.way_edges(tags.roads_and_paths(ways))
    edges = network.edge_end_coords(network.edge_start_coords(edges, nodes), nodes)
    return map_to_schema(edges, layer_schema("landing", "edges"))


def stage_nodes(nodes: DataFrame, cells: DataFrame, bounds: DataFrame, rows: int = 0) -> DataFrame:
    """Nodes, if counted ``rows`` of them, with elevations; of the raster only
    the tiles around them are read."""
    near = elevation.cells_around(elevation.squares_of_points(nodes), cells, bounds)
    return map_to_schema(elevation.node_elevation(nodes, near, rows), layer_schema("staging", "nodes"))


def stage_edges(edges: DataFrame, cells: DataFrame, bounds: DataFrame) -> DataFrame:
    """Edges with profiles; of the raster only the tiles that they cross are read."""
    near = elevation.cells_around(elevation.squares_of_edges(edges), cells, bounds)
    return map_to_schema(elevation.tag_edges(edges, near), layer_schema("staging", "edges"))


def safe_edges(edges: DataFrame) -> DataFrame:
    """Edges that the rules of access and safety keep, with what later layers
    need of the tags in place of them. The rules look at tags alone."""
    out = tags.drop_unsafe(tags.keep_accessible(tags.flag_footways(edges)))
    out = tags.highway_and_surface(tags.flag_oneway(tags.flag_flat(out)))
    return out.drop("tags", "timestamp", "explicit_footway", "separate_footway")


def _climbed(edges: DataFrame, distance) -> DataFrame:
    """Safe edges with profiles: their climb and length, in both directions."""
    out = elevation.elevation_changes(elevation.drop_without_elevation(edges)).drop("elevation")
    if distance is None:
        out = with_geodesic(out, "src_lat", "src_lon", "dst_lat", "dst_lon", "distance")
    else:
        out = out.withColumn("distance", distance)
    return map_to_schema(network.reverse_edges(out), layer_schema("sanitised", "edges"))


def sanitise_edges(edges: DataFrame, distance=None) -> DataFrame:
    """Staged edges that are safe and accessible, with climb and length, in both directions."""
    return _climbed(safe_edges(edges), distance)


def load_edges(edges: DataFrame, cells: DataFrame, bounds: DataFrame, distance=None) -> DataFrame:
    """Landed edges to sanitised ones, the same rows as staged and sanitised one
    after the other. What the rules drop gets no profile, and no tags are dealt
    or sorted; what they keep is stored once, narrow."""
    kept = materialize(safe_edges(edges), "safe")
    near = elevation.cells_around(elevation.squares_of_edges(kept), cells, bounds)
    return _climbed(elevation.tag_edges(kept, near), distance)


def sanitise_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return map_to_schema(network.used_nodes(nodes, edges), layer_schema("sanitised", "nodes"))


def load_nodes(nodes: DataFrame, edges: DataFrame, cells: DataFrame, bounds: DataFrame) -> DataFrame:
    """Landed nodes to sanitised ones, the same rows as staged and sanitised one
    after the other. Those without one of the sanitised ``edges`` go first; the
    others are stored, for the load of the edges reads them again and again."""
    used = materialize(network.used_nodes(nodes, edges, edges.count()), "used")
    staged = stage_nodes(used, cells, bounds, used.count())
    return materialize(map_to_schema(staged, layer_schema("sanitised", "nodes")), "sanitised-nodes")


def optimise(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contracted nodes and edges with partition keys. The edges are stored, as
    the nodes come out of them too; ``edges``, which are counted, should be."""
    rows = edges.count()
    flagged = network.node_flags(network.add_degrees(nodes, edges, rows))
    out = contract.contract(edges, flagged, rows).withColumn("ptn", partition_key("src_lat", "src_lon"))
    out = materialize(map_to_schema(out, layer_schema("optimised", "edges")), "optimised-edges")
    kept = network.used_nodes(nodes, out).withColumn("ptn", partition_key("lat", "lon"))
    return map_to_schema(kept, layer_schema("optimised", "nodes")), out
