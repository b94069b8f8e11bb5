"""Expressions over edges, profiles and geometries (P5, P8, P13, P16, P17,
A4, A5, A6, A8, A9, F15, G2, G20, G25)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres between elevation samples along an edge.
SAMPLE_M = 10
#: A step of this many metres or more between samples is taken for an artefact.
MAX_STEP_M = 6.0


def tag(name: str, tags: str = "tags") -> Column:
    """A tag's value without quotation marks; NULL if the tag is absent."""
    return F.regexp_replace(F.col(tags)[name], '"', "")


def step_metrics(se: str, sn: str, de: str, dn: str) -> dict[str, Column]:
    """Offsets, length and number of samples of an edge; at least both ends."""
    h, v = F.col(de) - F.col(se), F.col(dn) - F.col(sn)
    size = F.sqrt(h * h + v * v)
    return {
        "edge_size_h": h,
        "edge_size_v": v,
        "edge_size": size,
        "edge_steps": F.greatest(F.lit(2), F.round(size / F.lit(SAMPLE_M) + F.lit(1)).cast("int")),
    }


def sample_points(steps: Column, se: Column, sn: Column, de: Column, dn: Column) -> Column:
    """Array of (inx, easting, northing), evenly spaced, both ends included."""
    at = lambda a, b, i: F.when(i == 0, a.cast("double")).when(i == steps - 1, b.cast("double")).otherwise(
        a + (b - a) / (steps - 1) * i
    )
    return F.transform(
        F.sequence(F.lit(0), steps - 1),
        lambda i: F.struct(i.alias("inx"), at(se, de, i).alias("easting"), at(sn, dn, i).alias("northing")),
    )


def whole_or_null(values: Column) -> Column:
    """An array that has a NULL is NULL altogether."""
    return F.when(~F.exists(values, lambda x: x.isNull()), values)


def counted_steps(elevation: Column) -> Column:
    """Differences between neighbouring samples, without those of
    ``MAX_STEP_M`` or more."""
    rest = F.greatest(F.size(elevation) - 1, F.lit(0))
    steps = F.zip_with(F.slice(elevation, F.lit(2), rest), F.slice(elevation, F.lit(1), rest), lambda b, a: b - a)
    return F.filter(steps, lambda d: F.abs(d) < MAX_STEP_M)


def climb(steps: Column, flat: Column, sign: int) -> Column:
    """Gain (sign 1) or loss (sign -1) over steps; bridges and tunnels are flat.
    A sum of plain doubles: a pair of sums would cost an object a step."""
    total = F.aggregate(steps, F.lit(0.0), lambda acc, d: acc + F.greatest(d * sign, F.lit(0.0)))
    return F.when(flat, F.lit(0.0)).otherwise(total)


def array_literal(values: Column) -> Column:
    """``{a,b,c}`` with NULL elements written out."""
    return F.concat(F.lit("{"), F.array_join(values, ",", "NULL"), F.lit("}"))


def coords(lats: str = "lats", lons: str = "lons") -> Column:
    return F.transform(F.arrays_zip(lats, lons), lambda p: F.array(p[lats], p[lons]))


def profile_plot(dists: str, eles: str) -> Column:
    """What a plot of a route's profile needs (A11): the ``places`` of its points
    along the way, its ``length``, and the range of heights from ``low``, a
    tenth below the lowest, to ``high``, a tenth above the highest."""
    # A walk that keeps the last place and appends; routes have some thousand points.
    none = F.array().cast("array<double>")
    places = F.aggregate(F.col(dists), none, lambda acc, d: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)) + d))
    total = F.aggregate(F.col(dists), F.lit(0.0), lambda acc, d: acc + d)
    return F.struct(places.alias("places"), total.alias("length"), (F.array_min(eles) * 0.9).alias("low"), (F.array_max(eles) * 1.1).alias("high"))


def bounds(lats: str = "lats", lons: str = "lons") -> Column:
    return F.struct(
        F.array_min(lats).alias("min_lat"),
        F.array_min(lons).alias("min_lon"),
        F.array_max(lats).alias("max_lat"),
        F.array_max(lons).alias("max_lon"),
    )


def mean(values: str) -> Column:
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values))


def last(values: str) -> Column:
    return F.try_element_at(F.col(values), F.lit(-1))


def surface_total(s_dists: str, surfaces: list[str]) -> Column:
    """Distance on any of the surfaces."""
    out = F.lit(0.0)
    for s in surfaces:
        out = out + F.coalesce(F.col(s_dists)[s], F.lit(0.0))
    return out


def add_surface(s_dists: Column, surface: Column, distance: Column) -> Column:
    """The map of distances with one more stretch of a surface."""
    one = F.create_map(F.coalesce(surface, F.lit("unclassified")), distance)
    return F.map_zip_with(s_dists, one, lambda _, a, b: F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)))


def gain_potential(gain: str, loss: str) -> Column:
    return F.greatest(F.col(loss) - F.col(gain), F.lit(0.0))


def gain_ratio(gain: str, loss: str, dist: str) -> Column:
    return F.try_divide(F.col(gain) + gain_potential(gain, loss), F.col(dist))


def card_text(dist: str, gain: str) -> Column:
    """``12.3 km, 1,234 m`` for a route's card."""
    return F.concat(F.format_number(F.col(dist) / 1000, 1), F.lit(" km, "), F.format_number(F.col(gain), 0), F.lit(" m"))


def jaccard(a: str, b: str) -> Column:
    """Shared over all distinct elements of two arrays."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))
