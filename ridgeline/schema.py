"""Declared schemas of the layers, and projection onto them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_LAYERS = {
    ("landing", "elevation"): "easting int, northing int, elevation double",
    ("landing", "nodes"): "id long, lat double, lon double, easting int, northing int, timestamp long",
    ("landing", "edges"): (
        "src long, dst long, way_id long, way_inx int, src_lat double, src_lon double, dst_lat double, dst_lon double, "
        "src_easting int, src_northing int, dst_easting int, dst_northing int, tags map<string,string>, timestamp long"
    ),
    ("staging", "nodes"): "id long, lat double, lon double, elevation double, timestamp long",
    ("staging", "edges"): (
        "src long, dst long, way_id long, way_inx int, src_lat double, src_lon double, dst_lat double, dst_lon double, "
        "elevation array<double>, tags map<string,string>, timestamp long"
    ),
    ("sanitised", "nodes"): "id long, lat double, lon double, elevation double",
    ("sanitised", "edges"): (
        "src long, dst long, way_id long, way_inx int, src_lat double, src_lon double, dst_lat double, dst_lon double, "
        "highway string, surface string, elevation_gain double, elevation_loss double, distance double"
    ),
    ("optimised", "nodes"): "id long, lat double, lon double, elevation double, ptn string",
    ("optimised", "edges"): (
        "src long, dst long, src_lat double, src_lon double, highway string, surface string, elevation_gain double, "
        "elevation_loss double, distance double, lats array<double>, lons array<double>, eles array<double>, "
        "dists array<double>, ptn string"
    ),
    ("landing", "bounds"): "file_id string, min_easting int, min_northing int, max_easting int, max_northing int",
}


def layer_schema(layer: str, dataset: str) -> StructType:
    return StructType.fromDDL(_LAYERS[layer, dataset])


def map_to_schema(df: DataFrame, schema: StructType, cast: bool = True) -> DataFrame:
    """Exactly the declared columns in their order, cast to their types; other
    columns go. Without ``cast`` it only selects."""
    return df.select([F.col(f.name).cast(f.dataType) if cast else F.col(f.name) for f in schema.fields])
