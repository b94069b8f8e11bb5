"""Tags and the safety and access rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.profile import tag

FOOT_TAGS = ("foot", "sidewalk", "sidewalk:left", "sidewalk:right", "sidewalk:both")
OPEN_ACCESS = ("yes", "permissive", "designated")
MAX_SPEED = 50


def rename_coordinates(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"latitude": "lat", "longitude": "lon"})


def unpack_tags(ways: DataFrame) -> DataFrame:
    """Binary key and value pairs to a map; of equal keys the last one wins."""
    text = F.transform("tags", lambda t: F.struct(t["key"].cast("string").alias("key"), t["value"].cast("string").alias("value")))
    keys = F.transform(F.col("__tags"), lambda t: t["key"])
    last = F.filter(
        "__tags",
        lambda t, i: ~F.array_contains(F.slice(keys, i + 2, F.greatest(F.size("__tags") - i - 1, F.lit(0))), t["key"]),
    )
    return ways.withColumn("__tags", text).withColumn("tags", F.map_from_entries(last)).drop("__tags")


def roads_and_paths(ways: DataFrame) -> DataFrame:
    return ways.where(F.col("tags")["highway"].isNotNull())


def _any(conditions: list[Column]) -> Column:
    return reduce(Column.__or__, [F.coalesce(c, F.lit(False)) for c in conditions])


def flag_footways(edges: DataFrame) -> DataFrame:
    values = [tag(t) for t in FOOT_TAGS]
    return edges.withColumns(
        {
            "explicit_footway": _any([v.isNotNull() & ~v.isin("no", "separate") for v in values]),
            "separate_footway": _any([v == "separate" for v in values]),
        }
    )


def keep_accessible(edges: DataFrame) -> DataFrame:
    access = tag("access")
    return edges.where(access.isNull() | access.isin(*OPEN_ACCESS) | F.col("explicit_footway"))


def drop_motorways(edges: DataFrame) -> DataFrame:
    highway = tag("highway")
    return edges.where(highway.isNull() | ~highway.contains("motorway"))


def drop_separate_footways(edges: DataFrame) -> DataFrame:
    return edges.where(~F.col("separate_footway"))


def drop_roundabouts(edges: DataFrame) -> DataFrame:
    junction = tag("junction")
    return edges.where(junction.isNull() | (junction != "roundabout"))


def drop_fast_roads(edges: DataFrame) -> DataFrame:
    """Below ``MAX_SPEED``, without a readable limit, or with a footway."""
    speed = F.regexp_extract(tag("maxspeed"), "([0-9]{1,3})", 1).try_cast("int")
    return edges.where(speed.isNull() | (speed < MAX_SPEED) | F.col("explicit_footway"))


def drop_unsafe(edges: DataFrame) -> DataFrame:
    for rule in (drop_motorways, drop_separate_footways, drop_roundabouts, drop_fast_roads):
        edges = rule(edges)
    return edges


def flag_flat(edges: DataFrame) -> DataFrame:
    """Bridges and tunnels, whatever the tag's value."""
    return edges.withColumn("is_flat", tag("bridge").isNotNull() | tag("tunnel").isNotNull())


def flag_oneway(edges: DataFrame) -> DataFrame:
    """Any value but ``no`` is one way, forwards."""
    oneway = tag("oneway")
    return edges.withColumn("oneway", oneway.isNotNull() & (oneway != "no"))


def highway_and_surface(edges: DataFrame) -> DataFrame:
    return edges.withColumns({"highway": tag("highway"), "surface": tag("surface")})
