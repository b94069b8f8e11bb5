import math

import pytest
from pyspark.sql import functions as F

from ridgeline.functions import geo


def test_national_grid_published_point(spark):
    # Worked example of the national mapping agency's guide: the Caister tower,
    # 52 39 28.8282 N, 1 42 57.8663 E in WGS84; the shift is good to some metres.
    lat, lon = 52 + 39 / 60 + 28.8282 / 3600, 1 + 42 / 60 + 57.8663 / 3600
    df = spark.createDataFrame([(lat, lon), (None, lon)], "lat double, lon double")
    a, b = geo.with_national_grid(df, "lat", "lon").collect()
    assert abs(a.easting - 651409.9) < 8 and abs(a.northing - 313177.3) < 8
    assert b.easting is None and b.northing is None


@pytest.mark.parametrize(
    "points,metres",
    [
        # Vincenty's published test line (Flinders Peak to Buninyong), on a sister ellipsoid within a metre.
        ((-37.95103341666667, 144.42486788888888, -37.65282113888889, 143.92649552777777), 54972.271),
        ((0.0, 0.0, 0.0, 1.0), 111319.491),
        ((51.0, -1.0, 51.0, -1.0), 0.0),
        ((51.0, -1.0, 51.001, -1.0), 111.24),
    ],
)
def test_geodesic(spark, points, metres):
    df = spark.createDataFrame([points], "a double, b double, c double, d double")
    got = geo.with_geodesic(df, "a", "b", "c", "d").first().distance
    assert got == pytest.approx(metres, abs=0.05)


def test_geodesic_null_and_haversine(spark):
    df = spark.createDataFrame([(None, 1.0, 2.0, 3.0), (50.0, -1.0, 50.1, -1.1)], "a double, b double, c double, d double")
    v = geo.with_geodesic(df, "a", "b", "c", "d", "v").withColumn("h", geo.haversine("a", "b", "c", "d")).collect()
    assert v[0].v is None and v[0].h is None
    assert v[1].h == pytest.approx(v[1].v, rel=0.005)


def test_bounding_box_corners():
    south, west, north, east = geo.bounding_box(0.0, 0.0, 10_000.0)
    assert south == pytest.approx(-0.044966013570321796, abs=1e-15)
    assert (north, east) == (pytest.approx(0.04496601357032179, abs=1e-15), pytest.approx(0.044966027418013255, abs=1e-12))
    assert west == pytest.approx(-east, abs=1e-12)


@pytest.mark.parametrize(
    "lat,lon,key",
    [(50.0, 50.0, "50_50"), (45.5, -45.5, "45_n45"), (-40.9, 40.1, "n40_40"), (-35.0, -35.9, "n35_n35"), (-0.5, 0.5, "0_0")],
)
def test_partition_key(spark, lat, lon, key):
    df = spark.createDataFrame([(lat, lon)], "lat double, lon double")
    assert df.select(geo.partition_key("lat", "lon")).first()[0] == key == geo.partition_of(lat, lon)


def test_partition_key_null_and_box(spark):
    df = spark.createDataFrame([(None, 1.0)], "lat double, lon double")
    assert df.select(geo.partition_key("lat", "lon")).first()[0] is None
    assert geo.partitions_of_box((50.9553663, -1.4242919, 51.0012009, -1.3387398)) == ["50_n1", "51_n1"]
    assert geo.viewport([1.0, 3.0], [5.0, 9.0])["centre_lat"] == 2.0


def test_destination_round_trip(spark):
    lat, lon = geo.destination(51.0, -1.0, 45.0, 5000.0)
    df = spark.createDataFrame([(51.0, -1.0, lat, lon)], "a double, b double, c double, d double")
    assert df.select(geo.haversine("a", "b", "c", "d")).first()[0] == pytest.approx(5000.0)
    assert math.isclose(df.select(F.lit(1)).first()[0], 1)
