"""Contraction of chains between junctions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.runtime import spread

UNCLASSIFIED = "unclassified"



def _along():
    """Edges of a way in their order. All windows here are of this kind, so a
    load shuffles and sorts its edges by way once."""
    return Window.partitionBy("way_id").orderBy("way_inx")


def way_ends(edges: DataFrame) -> DataFrame:
    """``way_start_flag`` where no edge of the way comes before, ``way_end_flag``
    where none comes after."""
    alone = lambda beside: F.when(beside("way_inx").over(_along()).isNull(), 1).otherwise(0)
    return edges.withColumns({"way_start_flag": alone(F.lag), "way_end_flag": alone(F.lead)})


def endpoint_flags(edges: DataFrame, nodes: DataFrame, rows: int = 0) -> DataFrame:
    """``src_node`` and ``dst_node``: if the node at that end is a mere link or
    a dead end, and its elevation."""
    node = F.struct((F.col("contract_flag") == 1).alias("link"), (F.col("dead_end_flag") == 1).alias("dead"), "elevation")
    known = nodes.select("id", node.alias("node"))
    for end in ("src", "dst"):
        edges = spread(edges, rows, end).join(known.select(F.col("id").alias(end), F.col("node").alias(f"{end}_node")), end)
    return edges


def chain_ends(edges: DataFrame) -> DataFrame:
    """``chain_src`` of an edge that begins a chain: the first of its way, or
    one from a node that is no link; ``chain_dst`` of one that ends a chain."""
    out = edges
    for end, flag in (("src", "way_start_flag"), ("dst", "way_end_flag")):
        out = out.withColumn(f"chain_{end}", F.expr(f"CASE WHEN {flag} = 1 OR NOT {end}_node.link THEN {end} END"))
    return out


def fill_chains(edges: DataFrame) -> DataFrame:
    """Every edge of a way gets the last start before and the next end after it."""
    before = _along().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = _along().rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return edges.withColumns(
        {
            "chain_src": F.last("chain_src", ignorenulls=True).over(before),
            "chain_dst": F.first("chain_dst", ignorenulls=True).over(after),
        }
    )


def contract_chains(edges: DataFrame, rows: int = 0) -> DataFrame:
    """One row for each (chain_src, chain_dst): sums, sets of kinds, and the
    points and distances in the order of ``way_inx``."""
    place = lambda end: F.struct(F.col(f"{end}_lat").alias("lat"), F.col(f"{end}_lon").alias("lon"), F.col(f"{end}_node.elevation").alias("ele"), F.col(f"{end}_node.dead").alias("dead_end"))
    point = F.struct("way_inx", "distance", place("src").alias("s"), place("dst").alias("d"))
    out = spread(edges, rows, "chain_src", "chain_dst").groupBy("chain_src", "chain_dst").agg(
        F.sum("elevation_gain").alias("elevation_gain"),
        F.sum("elevation_loss").alias("elevation_loss"),
        F.sum("distance").alias("distance"),
        F.array_sort(F.collect_set("highway")).alias("highways"),
        F.array_sort(F.collect_set("surface")).alias("surfaces"),
        F.sort_array(F.collect_list(point)).alias("steps"),
    )
    return out.withColumns(
        {
            "step_dists": F.transform("steps", lambda s: s["distance"]),
            "src_points": F.transform("steps", lambda s: s["s"]),
            "dst_points": F.transform("steps", lambda s: s["d"]),
        }
    ).drop("steps")


def chains_to_edges(chains: DataFrame) -> DataFrame:
    """Contracted edges: one kind or ``unclassified``, geometry arrays, and the
    dead-end flags of both ends."""
    single = lambda c: F.when(F.size(c) == 1, F.element_at(F.col(c), 1)).otherwise(F.lit(UNCLASSIFIED))
    end = F.element_at("dst_points", -1)
    line = lambda f: F.array_append(F.transform("src_points", lambda p: p[f]), end[f])
    return chains.select(
        F.col("chain_src").alias("src"),
        F.col("chain_dst").alias("dst"),
        F.element_at("src_points", 1)["lat"].alias("src_lat"),
        F.element_at("src_points", 1)["lon"].alias("src_lon"),
        single("highways").alias("highway"),
        single("surfaces").alias("surface"),
        "elevation_gain",
        "elevation_loss",
        "distance",
        line("lat").alias("lats"),
        line("lon").alias("lons"),
        line("ele").alias("eles"),
        F.array_prepend("step_dists", F.lit(0.0)).alias("dists"),
        F.element_at("src_points", 1)["dead_end"].alias("src_dead_end_flag"),
        end["dead_end"].alias("dst_dead_end_flag"),
    )


def drop_dead_ends(edges: DataFrame) -> DataFrame:
    """Edges that touch a dead end go, in one pass: those that this exposes stay."""
    return edges.where("NOT (src_dead_end_flag OR dst_dead_end_flag)").drop("src_dead_end_flag", "dst_dead_end_flag")


def contract(edges: DataFrame, flagged_nodes: DataFrame, rows: int = 0) -> DataFrame:
    """Nodes first, then all that goes along a way: one shuffle by way. Many
    edges, if they were counted as ``rows``, are spread at each shuffle."""
    known = way_ends(spread(endpoint_flags(edges, flagged_nodes, rows), rows, "way_id"))
    return drop_dead_ends(chains_to_edges(contract_chains(fill_chains(chain_ends(known)), rows)))
