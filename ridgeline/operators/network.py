"""Ways to edges, and the graph around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.runtime import spread


def way_edges(ways: DataFrame) -> DataFrame:
    """A way of n nodes gives n - 1 edges, ``way_inx`` being the first's place.

    The nodes of a way lie in one row, so its edges do too: every node but the
    last beside every node but the first. Nothing is shuffled.
    """
    kept = [F.col("id").alias("way_id"), *[c for c in ("tags", "timestamp") if c in ways.columns]]
    nodes = ways.select(*kept, F.array_sort("nodes").alias("nodes"))
    rest = F.greatest(F.size("nodes") - 1, F.lit(0))
    pairs = F.arrays_zip(F.slice("nodes", F.lit(1), rest).alias("a"), F.slice("nodes", F.lit(2), rest).alias("b"))
    names = [c for c in nodes.columns if c != "nodes"]
    edges = nodes.select(*names, F.inline(pairs))
    return edges.select(*names, F.col("a.index").alias("way_inx"), F.col("a.nodeId").alias("src"), F.col("b.nodeId").alias("dst")).where("dst IS NOT NULL")


def _with_end(edges: DataFrame, nodes: DataFrame, end: str) -> DataFrame:
    there = nodes.select(F.col("id").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in ("lat", "lon", "easting", "northing")])
    return edges.join(there, end)


def edge_start_coords(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return _with_end(edges, nodes, "src")


def edge_end_coords(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return _with_end(edges, nodes, "dst")


def used_nodes(nodes: DataFrame, edges: DataFrame, rows: int = 0) -> DataFrame:
    """Nodes at an end of an edge: a semi join, so the ends need no distinct.
    Both ends come out of one pass over the edges. Many edges, if they were
    counted as ``rows``, are spread by node."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return nodes.join(spread(ends, 2 * rows, "id"), "id", "left_semi")


def node_degrees(edges: DataFrame, rows: int = 0) -> DataFrame:
    """``id, in_degree, out_degree, degree``: edges in and out, and distinct
    neighbours either way.

    One pass over the edges sees each from both ends. They are first summed by
    pair, in part before the shuffle, so no distinct aggregate expands rows.
    Many edges, if they were counted as ``rows``, are spread by node first.
    """
    seen = lambda a, b, i: F.struct(F.col(a).alias("id"), F.col(b).alias("other"), F.lit(i).alias("i"), F.lit(1 - i).alias("o"))
    pairs = edges.select(F.inline(F.array(seen("src", "dst", 0), seen("dst", "src", 1))))
    by_pair = spread(pairs, 2 * rows, "id").groupBy("id", "other").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    return by_pair.groupBy("id").agg(
        F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.count("other").alias("degree")
    )


def add_degrees(nodes: DataFrame, edges: DataFrame, rows: int = 0) -> DataFrame:
    """Nodes with their degrees; nodes without an edge go."""
    return nodes.join(node_degrees(edges, rows), "id")


def node_flags(nodes: DataFrame) -> DataFrame:
    flag = lambda n: F.when(F.col("degree") == n, 1).otherwise(0)
    return nodes.withColumns({"contract_flag": flag(2), "dead_end_flag": flag(1)})


def reverse_edges(edges: DataFrame) -> DataFrame:
    """Edges and, unless one way, the same edges backwards: ends, gain and loss
    swap, way id and place turn negative."""
    swap = {
        "src": "dst", "src_lat": "dst_lat", "src_lon": "dst_lon", "elevation_gain": "elevation_loss",
        "src_easting": "dst_easting", "src_northing": "dst_northing",
    }
    swap |= {v: k for k, v in swap.items()}
    kept = [(c, t) for c, t in edges.dtypes if c != "oneway"]
    there = F.struct(*[F.col(c) for c, _ in kept])
    back = F.struct(
        *[
            (-F.col(c)).cast(t).alias(c) if c in ("way_id", "way_inx") else F.col(swap[c] if swap.get(c) in edges.columns else c).alias(c)
            for c, t in kept
        ]
    )
    # Both directions come out of one pass over the edges.
    return edges.select(F.inline(F.when(F.col("oneway"), F.array(there)).otherwise(F.array(there, back))))


def swap_columns(df: DataFrame, a: str, b: str) -> DataFrame:
    """``df`` with two columns' contents exchanged."""
    other = {a: b, b: a}
    return df.select([F.col(other.get(c, c)).alias(c) for c in df.columns])


def loaded_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with an edge, edges with both nodes, one edge a pair.

    Of several edges between the same nodes the shortest stays; ties go by a
    hash of the other columns, so the choice does not depend on the order of rows.
    """
    ids = nodes.select("id")
    inside = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(
        ids.withColumnRenamed("id", "dst"), "dst", "left_semi"
    )
    rest = [c for c, t in edges.dtypes if c not in ("src", "dst", "distance") and not t.startswith("map")]
    # Aggregated in part before the shuffle; of all columns only the length and a hash are compared.
    best = F.min_by(F.struct(*edges.columns), F.struct("distance", F.xxhash64(*rest)) if rest else F.col("distance"))
    inside = inside.groupBy("src", "dst").agg(best.alias("e")).select("e.*")
    return used_nodes(nodes, inside), inside
