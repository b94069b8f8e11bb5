"""Geodesy and grid expressions.

Formulae are SQL text over column names, so Spark compiles them and no Python
runs per row. Angles come and go in degrees.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Mean radius of the sphere, metres.
SPHERE_M = 6371008.8
#: WGS84 ellipsoid.
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563
#: Airy 1830 ellipsoid and the national grid's transverse Mercator projection.
AIRY_A, AIRY_B = 6377563.396, 6356256.909
GRID_F0, GRID_LAT0, GRID_LON0, GRID_E0, GRID_N0 = 0.9996012717, 49.0, -2.0, 400000.0, -100000.0
#: Published seven-parameter shift from WGS84: metres, parts per million, arc seconds.
SHIFT_M = (-446.448, 125.157, -542.060)
SHIFT_PPM = 20.4894
SHIFT_SEC = (-0.1502, -0.2470, -0.8421)


def degree_part(x: str) -> str:
    """SQL: whole degrees toward zero as text, a minus sign written ``n``."""
    return f"replace(cast(cast({x} as int) as string), '-', 'n')"


def partition_key(lat: str, lon: str) -> Column:
    """``int(lat)_int(lon)``, truncated toward zero; NULL in, NULL out."""
    return F.expr(f"concat({degree_part(lat)}, '_', {degree_part(lon)})")


def partition_of(lat: float, lon: float) -> str:
    """The same key for two numbers."""
    return "_".join(str(int(x)).replace("-", "n") for x in (lat, lon))


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (
        f"(2 * {SPHERE_M} * asin(sqrt(pow(sin(radians(({lat2}) - ({lat1})) / 2), 2) + cos(radians({lat1})) * "
        f"cos(radians({lat2})) * pow(sin(radians(({lon2}) - ({lon1})) / 2), 2))))"
    )


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> Column:
    """Great-circle metres on the sphere."""
    return F.expr(haversine_sql(lat1, lon1, lat2, lon2))


def _staged(df: DataFrame, stages: list[dict[str, str]], out: dict[str, str]) -> DataFrame:
    """Evaluate ``stages`` of named SQL expressions one after the other, each
    seeing the names before it, and add ``out``.

    Every stage is a projection of its own. Spark keeps those apart whose names
    are used more than once, so each value is computed once and all of it
    compiles into one loop, which lambdas over arrays would not.
    """
    kept = df
    for stage in stages:
        kept = kept.selectExpr("*", *[f"{e} AS __{n}" for n, e in stage.items()])
    return kept.withColumns({n: F.expr(e) for n, e in out.items()}).select(*[c for c in df.columns if c not in out], *out)


def with_geodesic(df: DataFrame, lat1: str, lon1: str, lat2: str, lon2: str, name: str = "distance", steps: int = 7) -> DataFrame:
    """``df`` with metres on the WGS84 ellipsoid by Vincenty's inverse formula
    (G3).

    A fixed number of steps stands for the iteration: a millimetre within four
    for points up to a hundred kilometres apart. Nearly antipodal points, where
    it does not converge, do not occur between neighbours on a path. Equal
    points are 0 apart, a NULL anywhere gives NULL.
    """
    f, a = WGS84_F, WGS84_A
    b = a * (1 - f)
    stages = [
        {
            "u1": f"atan({1 - f} * tan(radians({lat1})))",
            "u2": f"atan({1 - f} * tan(radians({lat2})))",
            "l0": f"radians({lon2} - {lon1})",
        },
        {"s1": "sin(__u1)", "c1": "cos(__u1)", "s2": "sin(__u2)", "c2": "cos(__u2)", "lam0": "__l0"},
    ]
    for k in range(steps):
        last = k == steps - 1
        stages += [
            {f"sl{k}": f"sin(__lam{k})", f"cl{k}": f"cos(__lam{k})"},
            {
                f"ss{k}": f"sqrt((__c2 * __sl{k}) * (__c2 * __sl{k}) + (__c1 * __s2 - __s1 * __c2 * __cl{k}) * (__c1 * __s2 - __s1 * __c2 * __cl{k}))",
                f"cs{k}": f"__s1 * __s2 + __c1 * __c2 * __cl{k}",
            },
            {f"sa{k}": f"coalesce(try_divide(__c1 * __c2 * __sl{k}, __ss{k}), 0.0D)", f"sg{k}": f"atan2(__ss{k}, __cs{k})"},
            {f"ca{k}": f"1 - __sa{k} * __sa{k}"},
            {f"cm{k}": f"coalesce(__cs{k} - try_divide(2 * __s1 * __s2, __ca{k}), 0.0D)", f"cc{k}": f"{f / 16} * __ca{k} * (4 + {f} * (4 - 3 * __ca{k}))"},
        ]
        if not last:
            stages.append(
                {
                    f"lam{k + 1}": f"__l0 + (1 - __cc{k}) * {f} * __sa{k} * (__sg{k} + __cc{k} * __ss{k} * "
                    f"(__cm{k} + __cc{k} * __cs{k} * (2 * __cm{k} * __cm{k} - 1)))"
                }
            )
    k = steps - 1
    stages += [
        {"usq": f"__ca{k} * {(a * a - b * b) / (b * b)}"},
        {
            "big_a": "1 + __usq / 16384 * (4096 + __usq * (-768 + __usq * (320 - 175 * __usq)))",
            "big_b": "__usq / 1024 * (256 + __usq * (-128 + __usq * (74 - 47 * __usq)))",
        },
        {
            "delta": f"__big_b * __ss{k} * (__cm{k} + __big_b / 4 * (__cs{k} * (2 * __cm{k} * __cm{k} - 1) - __big_b / 6 * __cm{k} "
            f"* (4 * __ss{k} * __ss{k} - 3) * (4 * __cm{k} * __cm{k} - 3)))"
        },
    ]
    missing = " OR ".join(f"{c} IS NULL" for c in (lat1, lon1, lat2, lon2))
    return _staged(df, stages, {name: f"CASE WHEN NOT ({missing}) THEN {b} * __big_a * (__sg{k} - __delta) END"})


def with_national_grid(df: DataFrame, lat: str, lon: str, easting: str = "easting", northing: str = "northing") -> DataFrame:
    """``df`` with double coordinates on the national grid.

    WGS84 to Cartesian, Helmert shift, back to latitude and longitude on the
    Airy ellipsoid, then transverse Mercator by the published series. Accurate
    to some five metres, as the shift is. NULL in, NULL out.
    """
    e2 = 2 * WGS84_F - WGS84_F**2
    airy_e2 = 1 - (AIRY_B / AIRY_A) ** 2
    n = (AIRY_A - AIRY_B) / (AIRY_A + AIRY_B)
    tx, ty, tz = SHIFT_M
    s = 1 + SHIFT_PPM * 1e-6
    rx, ry, rz = (math.radians(x / 3600) for x in SHIFT_SEC)
    phi0, lam0 = math.radians(GRID_LAT0), math.radians(GRID_LON0)
    stages = [
        {"sp": f"sin(radians({lat}))", "cp": f"cos(radians({lat}))", "l": f"radians({lon})"},
        {"n": f"{WGS84_A} / sqrt(1 - {e2} * __sp * __sp)"},
        {"x": "__n * __cp * cos(__l)", "y": "__n * __cp * sin(__l)", "z": f"__n * {1 - e2} * __sp"},
        {
            "x2": f"{tx} + {s} * __x - ({rz}) * __y + ({ry}) * __z",
            "y2": f"{ty} + ({rz}) * __x + {s} * __y - ({rx}) * __z",
            "z2": f"{tz} - ({ry}) * __x + ({rx}) * __y + {s} * __z",
        },
        {"q": "sqrt(__x2 * __x2 + __y2 * __y2)", "d": f"atan2(__y2, __x2) - ({lam0})"},
        {"p0": f"atan2(__z2, __q * {1 - airy_e2})"},
    ]
    # Latitude on the other ellipsoid by fixed-point steps.
    for k in range(5):
        stages.append({f"r{k}": f"sin(__p{k})"})
        stages.append({f"p{k + 1}": f"atan2(__z2 + {airy_e2 * AIRY_A} / sqrt(1 - {airy_e2} * __r{k} * __r{k}) * __r{k}, __q)"})
    stages += [
        {"s": "sin(__p5)", "c": "cos(__p5)", "u": f"__p5 - {phi0}", "v": f"__p5 + {phi0}"},
        {
            "w": f"1 - {airy_e2} * __s * __s",
            "t2": "(__s / __c) * (__s / __c)",
            "m": f"{AIRY_B * GRID_F0} * ({1 + n + 1.25 * n**2 + 1.25 * n**3} * __u - {3 * n + 3 * n**2 + 21 / 8 * n**3} * sin(__u) * cos(__v) "
            f"+ {15 / 8 * (n**2 + n**3)} * sin(2 * __u) * cos(2 * __v) - {35 / 24 * n**3} * sin(3 * __u) * cos(3 * __v))",
        },
        {"nu": f"{AIRY_A * GRID_F0} / sqrt(__w)", "rho": f"{AIRY_A * GRID_F0 * (1 - airy_e2)} / (__w * sqrt(__w))", "cd": "__c * __d"},
        {"eta2": "__nu / __rho - 1", "cd2": "__cd * __cd"},
    ]
    out = {
        easting: f"{GRID_E0} + __nu * __cd * (1 + __cd2 / 6 * (__nu / __rho - __t2) "
        "+ __cd2 * __cd2 / 120 * (5 - 18 * __t2 + __t2 * __t2 + 14 * __eta2 - 58 * __t2 * __eta2))",
        northing: f"__m + {GRID_N0} + __nu * __s / __c * __cd2 * (0.5D + __cd2 / 24 * (5 - __t2 + 9 * __eta2) "
        "+ __cd2 * __cd2 / 720 * (61 - 58 * __t2 + __t2 * __t2))",
    }
    return _staged(df, stages, out)


def destination(lat: float, lon: float, bearing: float, metres: float) -> tuple[float, float]:
    """Where a great circle leads from a point."""
    p, a, t = math.radians(lat), metres / SPHERE_M, math.radians(bearing)
    p2 = math.asin(math.sin(p) * math.cos(a) + math.cos(p) * math.sin(a) * math.cos(t))
    dl = math.atan2(math.sin(t) * math.sin(a) * math.cos(p), math.cos(a) - math.sin(p) * math.sin(p2))
    return math.degrees(p2), (lon + math.degrees(dl) + 540) % 360 - 180


def bounding_box(lat: float, lon: float, max_distance: float) -> tuple[float, float, float, float]:
    """(min_lat, min_lon, max_lat, max_lon): the square that a loop of
    ``max_distance`` cannot leave, by its corners at 45 and 225 degrees (G4)."""
    reach = max_distance / 2 * math.sqrt(2)
    north, east = destination(lat, lon, 45.0, reach)
    south, west = destination(lat, lon, 225.0, reach)
    return south, west, north, east


def partitions_of_box(box: tuple[float, float, float, float]) -> list[str]:
    """Partition keys that a box meets, corners first (G5). Boxes over more
    than two degrees get the keys between the corners as well."""
    south, west, north, east = box
    span = lambda a, b: range(int(a), int(b) + 1)
    return list(dict.fromkeys(partition_of(y, x) for y in span(south, north) for x in span(west, east)))


def viewport(lats: list[float], lons: list[float]) -> dict[str, float]:
    """Bounds and centre for a map."""
    return {
        "min_lat": min(lats), "min_lon": min(lons), "max_lat": max(lats), "max_lon": max(lons),
        "centre_lat": (min(lats) + max(lats)) / 2, "centre_lon": (min(lons) + max(lons)) / 2,
    }
