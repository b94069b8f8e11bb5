"""Circular routes over a graph.

A candidate is a row; one step of the search joins all candidates with the
edges that leave their last node, and a single projection judges every step.
Tables between steps are written to the shared folder, which cuts lineage and
survives lost executors. Several searches run side by side under a ``job_id``.
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.functions.geo import bounding_box, haversine, partitions_of_box
from ridgeline.functions.profile import add_surface, bounds, last, mean, surface_total
from ridgeline.operators.network import loaded_graph
from ridgeline.runtime import materialize

#: Edges up to this many bytes, counted before each search, are broadcast.
BROADCAST_BYTES = 64 << 20


@dataclass(frozen=True)
class RouteConfig:
    """What a user asks for (G26, G27). Distances in metres."""

    start_lat: float
    start_lon: float
    target_distance: float
    route_mode: str = "hilly"
    distance_tolerance: float = 0.1
    highway_types: tuple[str, ...] = ()
    surface_types: tuple[str, ...] = ()
    restricted_surfaces: tuple[str, ...] | None = None
    restricted_surfaces_perc: float | None = None

    def __post_init__(self):
        if self.route_mode not in ("hilly", "flat"):
            raise ValueError(f"route_mode must be hilly or flat, not {self.route_mode!r}")

    @property
    def min_distance(self) -> float:
        return self.target_distance / (1 + self.distance_tolerance)

    @property
    def max_distance(self) -> float:
        return self.target_distance * (1 + self.distance_tolerance)

    @property
    def sign(self) -> int:
        return 1 if self.route_mode == "hilly" else -1

    @property
    def restriction(self) -> tuple[tuple[str, ...], float] | None:
        """Surfaces and the part of the maximum distance they may make up; only
        if both are given. Zero is a restriction too."""
        if self.restricted_surfaces is None or self.restricted_surfaces_perc is None:
            return None
        return self.restricted_surfaces, self.restricted_surfaces_perc

    @staticmethod
    def parse(args: dict[str, str]) -> RouteConfig:
        """From request arguments: lists are separated by commas."""
        split = lambda k: tuple(args[k].split(",")) if args.get(k) else ()
        return RouteConfig(
            float(args["start_lat"]),
            float(args["start_lon"]),
            float(args["target_distance"]),
            args.get("route_mode", "hilly"),
            float(args.get("distance_tolerance", 0.1)),
            split("highway_types"),
            split("surface_types"),
            split("restricted_surfaces") if "restricted_surfaces" in args else None,
            float(args["restricted_surfaces_perc"]) if "restricted_surfaces_perc" in args else None,
        )


@dataclass(frozen=True)
class Settings:
    """How hard the engine tries."""

    max_candidates: int = 1024
    max_routes: int = 32
    bin_size: int = 64
    bin_strategy: str = "centre"
    pruning_strategy: str = "fuzzy"
    pruning_threshold: float = 0.95
    display_threshold: float = 0.8
    finishing_overlaps: int = 3
    return_path_check: bool = False
    max_job_seconds: float = 300.0
    max_steps: int = 10_000
    attempts: int = 3

    def __post_init__(self):
        if self.pruning_strategy not in ("naive", "fuzzy") or self.bin_strategy not in ("centre", "last"):
            raise ValueError("pruning_strategy is naive or fuzzy, bin_strategy centre or last")

    @staticmethod
    def from_environment(prefix: str = "RIDGELINE_") -> Settings:
        """Every field from ``PREFIX_FIELD``; unset or unreadable is an error."""
        out = {}
        for name, f in Settings.__dataclass_fields__.items():
            raw = os.environ.get(prefix + name.upper())
            if raw is None:
                raise KeyError(f"{prefix}{name.upper()} is not set")
            kind = type(f.default)
            out[name] = raw.lower() in ("1", "true") if kind is bool else raw.lower() if kind is str else kind(raw)
        return Settings(**out)


# --------------------------------------------------------------------------
# loading


def nodes_window(nodes: DataFrame, config: RouteConfig) -> DataFrame:
    """Nodes that a route can reach: partitions first, then the exact box."""
    box = bounding_box(config.start_lat, config.start_lon, config.max_distance)
    return nodes.where(F.col("ptn").isin(partitions_of_box(box)) & F.col("lat").between(box[0], box[2]) & F.col("lon").between(box[1], box[3]))


def edges_window(edges: DataFrame, config: RouteConfig) -> DataFrame:
    """As for nodes, by the edges' starts, and of the wanted kinds (P10)."""
    box = bounding_box(config.start_lat, config.start_lon, config.max_distance)
    out = edges.where(
        F.col("ptn").isin(partitions_of_box(box)) & F.col("src_lat").between(box[0], box[2]) & F.col("src_lon").between(box[1], box[3])
    )
    if config.highway_types:
        out = out.where(F.col("highway").isin(*config.highway_types))
    if config.surface_types:
        out = out.where(F.col("surface").isin(*config.surface_types))
    return out


def nearest_node(nodes: DataFrame, lat: float, lon: float) -> DataFrame:
    """One row: the node nearest to a point, of equals the smallest id (T5)."""
    away = haversine(str(float(lat)), str(float(lon)), "lat", "lon")
    return nodes.withColumn("away", away).orderBy("away", "id").limit(1)


def tag_start(nodes: DataFrame, start_id: int) -> DataFrame:
    """Nodes with ``is_start``, true for one of them."""
    return nodes.withColumn("is_start", F.col("id") == start_id)


def start_node(tagged: DataFrame) -> DataFrame:
    """``job_id, id`` of the tagged start."""
    return tagged.where("is_start").select(F.lit(0).cast("long").alias("job_id"), "id")


#: Fronts of a walk that are read side by side before they are put together.
FRONTS = 12


def _shortest(front: DataFrame, expand: Callable[[DataFrame], DataFrame], keys: list[str], name: str) -> DataFrame:
    """The least ``dist`` of every ``keys`` that rows of ``front`` lead to.

    Rounds of label correction until nothing comes down any more: only the front,
    the rows that came down in the last round, is expanded and stored; what is known
    already is only read, and written again once in ``FRONTS`` rounds. Distances
    are not negative, so the rounds end.
    """
    known = [materialize(front.select(*keys, "dist"), name)]
    every = lambda: reduce(DataFrame.unionByName, known)
    while True:
        # What is known and what is new meet in one aggregate; only what is lower is stored.
        both = every().withColumn("__old", F.lit(True)).unionByName(expand(known[-1]).withColumn("__old", F.lit(False)))
        least = both.groupBy(*keys).agg(F.min("dist").alias("dist"), F.min(F.when(F.col("__old"), F.col("dist"))).alias("__before"))
        lower = materialize(least.where("__before IS NULL OR dist < __before").select(*keys, "dist"), name)
        if lower.isEmpty():
            return every().groupBy(*keys).agg(F.min("dist").alias("dist"))
        if len(known) == FRONTS:
            known = [materialize(every().groupBy(*keys).agg(F.min("dist").alias("dist")), name)]
        known.append(lower)


def distances_to(edges: DataFrame, starts: DataFrame, max_distance: float | None = None) -> DataFrame:
    """``job_id, id, dist_to_start``: the shortest way along edges to the start
    of each job (G7). Distances above ``max_distance`` are not followed."""
    back = edges.groupBy(F.col("dst").alias("id"), "src").agg(F.min("distance").alias("distance"))
    back = materialize(back, "back")

    def expand(front: DataFrame) -> DataFrame:
        step = front.join(back, "id").select("job_id", F.col("src").alias("id"), (F.col("dist") + F.col("distance")).alias("dist"))
        return step if max_distance is None else step.where(F.col("dist") <= max_distance)

    front = starts.select("job_id", "id", F.lit(0.0).alias("dist"))
    return _shortest(front, expand, ["job_id", "id"], "dist").withColumnRenamed("dist", "dist_to_start")


def reachable(nodes: DataFrame, edges: DataFrame, dist: DataFrame, max_distance: float) -> tuple[DataFrame, DataFrame]:
    """Nodes no farther than half the maximum from the start, and edges between
    two such nodes (F16)."""
    near = dist.where(F.col("dist_to_start") <= max_distance / 2).select("id", "dist_to_start")
    kept = nodes.join(near, "id")
    ids = kept.select("id")
    inside = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return kept, inside


# --------------------------------------------------------------------------
# one step

CANDIDATE = (
    "job_id long, start long, cur long, points array<long>, dist double, gain double, loss double, "
    "s_dists map<string,double>, lats array<double>, lons array<double>, eles array<double>, dists array<double>"
)


def seeds(starts: DataFrame) -> DataFrame:
    """A candidate for each ``job_id, id``: at the start, with nothing behind."""
    none = F.array().cast("array<double>")
    return starts.select(
        F.col("job_id").cast("long").alias("job_id"),
        F.col("id").cast("long").alias("start"),
        F.col("id").cast("long").alias("cur"),
        F.array(F.col("id").cast("long")).alias("points"),
        *[F.lit(0.0).alias(c) for c in ("dist", "gain", "loss")],
        F.create_map().cast("map<string,double>").alias("s_dists"),
        *[none.alias(c) for c in ("lats", "lons", "eles", "dists")],
    )


def overlaps(points: str, dst: str, dist: str, min_distance: float, n: int) -> Column:
    """Whether a step meets the candidate's own path (G10). The start is always
    open; near the end so are the first ``n`` nodes, unless among the last."""
    p, d = F.col(points), F.col(dst)
    size = F.size(p)
    nearly = (F.col(dist) >= min_distance) & (size >= n)
    if n > 0:
        nearly = nearly & F.array_contains(F.slice(p, 1, n), d) & ~F.array_contains(F.slice(p, F.greatest(size - n + 1, F.lit(1)), F.lit(n)), d)
    else:
        nearly = F.lit(False)
    return F.when(d == F.element_at(p, 1), F.lit(False)).when(nearly, F.lit(False)).otherwise(F.array_contains(p, d))


def surfaces_ok(s_dists: str, config: RouteConfig) -> Column:
    if config.restriction is None:
        return F.lit(True)
    surfaces, part = config.restriction
    return surface_total(s_dists, list(surfaces)) <= part * config.max_distance


def take_steps(candidates: DataFrame, edges: DataFrame, config: RouteConfig, settings: Settings) -> DataFrame:
    """Every candidate along every edge from its last node, with a ``status``:
    ``complete``, ``valid`` or ``invalid`` (G13). ``edges`` have
    ``dist_to_start`` of their end."""
    e = edges.select(
        F.col("src").alias("cur"),
        F.col("dst").alias("__dst"),
        F.col("distance").alias("__d"),
        F.col("elevation_gain").alias("__gain"),
        F.col("elevation_loss").alias("__loss"),
        F.col("surface").alias("__surface"),
        F.col("dist_to_start").alias("__left"),
        *[F.col(c).alias(f"__{c}") for c in ("lats", "lons", "eles", "dists")],
    )
    both = candidates.join(e, "cur")
    home = F.col("__dst") == F.col("start")
    left = F.when(home, F.lit(0.0)).otherwise(F.col("__left"))
    legal = ~overlaps("points", "__dst", "dist", config.min_distance, settings.finishing_overlaps) & left.isNotNull()
    legal = legal & (F.col("dist") + F.col("__d") + left <= config.max_distance)
    stepped = both.withColumn("__legal", F.coalesce(legal, F.lit(False))).select(
        "job_id",
        "start",
        F.col("__dst").alias("cur"),
        F.array_append("points", F.col("__dst")).alias("points"),
        (F.col("dist") + F.col("__d")).alias("dist"),
        (F.col("gain") + F.col("__gain")).alias("gain"),
        (F.col("loss") + F.col("__loss")).alias("loss"),
        add_surface(F.col("s_dists"), F.col("__surface"), F.col("__d")).alias("s_dists"),
        *[F.concat(c, f"__{c}").alias(c) for c in ("lats", "lons", "eles", "dists")],
        "__legal",
    )
    ok = surfaces_ok("s_dists", config)
    done = ok & F.col("dist").between(config.min_distance, config.max_distance)
    status = (
        F.when(~F.col("__legal"), "invalid")
        .when(F.col("cur") == F.col("start"), F.when(done, "complete").otherwise("invalid"))
        .otherwise(F.when(ok, "valid").otherwise("invalid"))
    )
    return stepped.withColumn("status", status).drop("__legal")


# --------------------------------------------------------------------------
# pruning


def beam_width(n_edges: int, attempt: int, max_candidates: int) -> int:
    return min(n_edges * attempt**2, max_candidates)


def bin_shape(max_candidates: int, bin_size: int) -> tuple[int, int]:
    """Rows of a stripe of latitude, and of a bin within it."""
    bins = math.ceil(max_candidates / bin_size)
    x = math.ceil(math.sqrt(bins))
    y = math.ceil(bins / x)
    return bin_size * y, bin_size


def candidate_order(sign: int) -> list[Column]:
    """Longer routes first, by whole kilometres, then climb by whole metres
    (T2); the points settle ties."""
    return [F.floor(F.col("dist") / 1000).desc(), (sign * F.col("gain")).cast("int").desc(), F.col("points").cast("string")]


def result_order(sign: int) -> list[Column]:
    return [F.try_divide(sign * F.col("gain"), F.col("dist")).desc_nulls_last(), F.col("points").cast("string")]


def bin_candidates(candidates: DataFrame, max_candidates: int, settings: Settings) -> DataFrame:
    """``x_bin, y_bin``: stripes of equal size by latitude, each cut by
    longitude (W5, G20). Candidates without a position come first."""
    stripe, size = bin_shape(max_candidates, settings.bin_size)
    at = last if settings.bin_strategy == "last" else mean
    by_lat = Window.partitionBy("job_id").orderBy(at("lats").asc_nulls_first(), F.col("points").cast("string"))
    out = candidates.withColumn("x_bin", F.floor((F.row_number().over(by_lat) - 1) / stripe))
    by_lon = Window.partitionBy("job_id", "x_bin").orderBy(at("lons").asc_nulls_first(), F.col("points").cast("string"))
    return out.withColumn("y_bin", F.floor((F.row_number().over(by_lon) - 1) / size))


def best_in_bins(binned: DataFrame, target: int, sign: int, keys: tuple[str, ...] = ("job_id", "x_bin", "y_bin")) -> DataFrame:
    """The first ``target`` rows of each group."""
    order = Window.partitionBy(*keys).orderBy(*candidate_order(sign))
    return binned.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= target).drop("__n")


def pick_dissimilar(sets: list[frozenset], target: int, most: float, start: float = 0.7, step: float = 0.1) -> list[int]:
    """Places of the rows kept, of sets in order of preference.

    A row joins if it is unlike all rows kept: of similar size, and with a
    Jaccard similarity up to a threshold that rises until there are enough.
    Sets too different in size count as alike, as sizes are compared first. A
    target below one keeps nothing.
    """
    if len(sets) <= target:
        return list(range(len(sets)))
    if target < 1:
        return []
    kept, rest, limit = [0], list(range(1, len(sets))), start
    while len(kept) < target:
        missed = []
        for place, i in enumerate(rest):
            if len(kept) == target:
                missed += rest[place:]
                break
            a = sets[i]
            for k in kept:
                b = sets[k]
                small, large = sorted((len(a), len(b)))
                if small < large * limit or large > small * (2.0 - limit) or len(a & b) > limit * len(a | b):
                    missed.append(i)
                    break
            else:
                kept.append(i)
        if limit >= most:
            break
        rest, limit = missed, min(limit + step, most)
    return kept


def dissimilar_in_bins(binned: DataFrame, target: int, sign: int, most: float, keys: tuple[str, ...] = ("job_id", "x_bin", "y_bin")) -> DataFrame:
    """G21 in each group, whose size the bins bound. Only the points go to
    Python; the rows come back by a join on their rank."""
    order = Window.partitionBy(*keys).orderBy(*candidate_order(sign))
    ranked = binned.withColumn("__rank", F.row_number().over(order))
    names = [*keys, "__rank", "points"]
    schema = ", ".join(f"{k} long" for k in keys) + ", __rank int"

    def pick(pdf):
        pdf = pdf.sort_values("__rank", ignore_index=True)
        return pdf.iloc[pick_dissimilar([frozenset(p) for p in pdf["points"]], target, most)][[*keys, "__rank"]]

    kept = ranked.select(*names).groupBy(*keys).applyInPandas(pick, schema)
    return ranked.join(kept, [*keys, "__rank"], "left_semi").drop("__rank")


def return_paths(candidates: DataFrame, edges: DataFrame, n: int, max_distance: float) -> DataFrame:
    """Candidates with a way home that avoids their own path but for its first
    ``n`` nodes, and with which they stay below ``max_distance`` (G23); walked
    for all candidates at once, until none has a shorter way anywhere."""
    # Equal candidates of a job have the same answer.
    c = candidates.withColumn("__id", F.xxhash64("job_id", "points"))
    step = materialize(edges.groupBy(F.col("src").alias("at"), F.col("dst").alias("__dst")).agg(F.min("distance").alias("__d")), "ways-home")
    own = c.select("__id", F.col("start").alias("__start"), F.slice("points", 1, max(n, 1)).alias("__first"), "points", F.col("dist").alias("__behind"))
    own = materialize(own.dropDuplicates(["__id"]), "paths")

    def expand(front: DataFrame) -> DataFrame:
        # Who is home walks no further.
        away = front.join(own, "__id").where(F.col("at") != F.col("__start")).join(step, "at")
        free = (F.col("__dst") == F.col("__start")) | F.array_contains("__first", F.col("__dst")) | ~F.array_contains("points", F.col("__dst"))
        total = F.col("dist") + F.col("__d")
        nxt = away.where(free & (F.col("__behind") + total < max_distance))
        return nxt.select("__id", F.col("__dst").alias("at"), total.alias("dist"))

    # A candidate's last node may be its start only before the first step.
    begun = c.select("__id", F.col("cur").alias("at"), F.lit(0.0).alias("dist")).dropDuplicates(["__id"])
    reached = _shortest(begun, expand, ["__id", "at"], "walk").join(own.select("__id", F.col("__start").alias("at")), ["__id", "at"], "left_semi")
    return c.join(reached.select("__id"), "__id", "left_semi").drop("__id")


def bin_count(n: int, max_candidates: int, bin_size: int) -> int:
    """How many bins ``n`` candidates fill."""
    stripe, size = bin_shape(max_candidates, bin_size)
    full, rest = divmod(n, stripe)
    return full * -(-stripe // size) + -(-rest // size)


def prune(candidates: DataFrame, n: int, width: int, config: RouteConfig, settings: Settings, edges: DataFrame | None = None) -> DataFrame:
    """At most about ``width`` candidates a job, spread over the map.
    ``n`` is the number of candidates of the largest job."""
    if n <= width:
        return candidates
    if settings.return_path_check and edges is not None:
        candidates = materialize(return_paths(candidates, edges, settings.finishing_overlaps, config.max_distance), "returning")
        n = candidates.groupBy("job_id").count().agg(F.max("count")).first()[0] or 0
    binned = bin_candidates(candidates, width, settings)
    target = max(1, width // max(1, bin_count(n, width, settings.bin_size)))
    if settings.pruning_strategy == "naive":
        out = best_in_bins(binned, target, config.sign)
    else:
        out = dissimilar_in_bins(materialize(binned, "binned"), target, config.sign, settings.pruning_threshold)
    return out.drop("x_bin", "y_bin")


# --------------------------------------------------------------------------
# the whole search


@dataclass
class Progress:
    """What a run did, step by step: candidates, completed, mean distance."""

    steps: list[tuple[int, int, float | None]] = field(default_factory=list)


class SearchTimeout(RuntimeError):
    pass


def finalise(routes: DataFrame) -> DataFrame:
    """Completed candidates with ``id``, ``bbox`` and ``centre``."""
    return routes.withColumns(
        {
            "id": F.xxhash64("points"),
            "bbox": bounds(),
            "centre": F.struct(mean("lats").alias("lat"), mean("lons").alias("lon")),
        }
    )


def step_totals(stepped: DataFrame) -> DataFrame:
    """``status, n, most, mean_dist``: candidates after a step, those of the
    largest job, and the mean of their lengths (A10). A row a status."""
    by_job = stepped.groupBy("status", "job_id").agg(F.count("*").alias("n"), F.sum("dist").alias("d"))
    return by_job.groupBy("status").agg(F.sum("n").alias("n"), F.max("n").alias("most"), (F.sum("d") / F.sum("n")).alias("mean_dist"))


def _attempt(starts, edges, width, config, settings, until, progress) -> DataFrame | None:
    front, done = seeds(starts), []
    size = edges.agg(F.sum(F.lit(200) + F.lit(32) * F.size("lats"))).first()[0] or 0
    small = size <= BROADCAST_BYTES
    for _ in range(settings.max_steps):
        if time.monotonic() > until:
            raise SearchTimeout("the search took too long")
        out = materialize(take_steps(front, F.broadcast(edges) if small else edges, config, settings).where("status <> 'invalid'"), "steps")
        counts = {r.status: r for r in step_totals(out).collect()}
        valid = counts["valid"].n if "valid" in counts else 0
        most = counts["valid"].most if valid else 0
        if "complete" in counts:
            done.append(out.where("status = 'complete'").drop("status"))
        progress.steps.append((valid, counts["complete"].n if "complete" in counts else 0, counts["valid"].mean_dist if valid else None))
        if not valid:
            break
        # The pruning plan is short and reads a stored table; it runs with the next step.
        front = prune(out.where("status = 'valid'").drop("status"), most, width, config, settings, edges)
    else:
        raise SearchTimeout(f"the search took more than {settings.max_steps} steps")
    return reduce(DataFrame.unionByName, done) if done else None


def search_graph(edges: DataFrame, nodes: DataFrame, start: DataFrame, max_distance: float) -> DataFrame:
    """The edges that a loop from the start can use, with ``dist_to_start`` of
    their ends (F16, G7), stored."""
    dist = distances_to(edges, start, max_distance)
    nodes, edges = reachable(nodes, edges, dist, max_distance)
    left = nodes.select(F.col("id").alias("dst"), "dist_to_start")
    return materialize(edges.join(left, "dst", "left"), "search-edges")


def all_loops(edges: DataFrame, start: DataFrame, config: RouteConfig, settings: Settings | None = None) -> DataFrame | None:
    """Every circular route of a graph as by ``search_graph``: the search with
    a beam that is never pruned. None if there is no route."""
    settings = settings or Settings()
    return _attempt(start, edges, sys.maxsize, config, settings, time.monotonic() + settings.max_job_seconds, Progress())


def find_routes(
    spark: SparkSession, nodes: DataFrame, edges: DataFrame, config: RouteConfig, settings: Settings | None = None, progress: Progress | None = None
) -> DataFrame:
    """The best circular routes from the node nearest to the start, best first.

    Tries wider beams only while nothing was completed (G17).
    """
    settings, progress = settings or Settings(), progress or Progress()
    until = time.monotonic() + settings.max_job_seconds
    nodes, edges = loaded_graph(nodes_window(nodes, config), edges_window(edges, config))
    nodes, edges = materialize(nodes, "route-nodes"), materialize(edges, "route-edges")
    nearest = nearest_node(nodes, config.start_lat, config.start_lon).first()
    if nearest is None:
        return finalise(spark.createDataFrame([], CANDIDATE))
    start = start_node(tag_start(nodes, nearest.id))
    edges = search_graph(edges, nodes, start, config.max_distance)
    n_edges, found = edges.count(), None
    for attempt in range(1, settings.attempts + 1):
        width = max(1, beam_width(n_edges, attempt, settings.max_candidates))
        found = _attempt(start, edges, width, config, settings, until, progress)
        if found is not None or width >= settings.max_candidates:
            break
    if found is None:
        return finalise(spark.createDataFrame([], CANDIDATE))
    best = dissimilar_in_bins(found.withColumn("one", F.lit(0).cast("long")), settings.max_routes, config.sign, settings.display_threshold, ("job_id", "one"))
    return finalise(best.drop("one")).orderBy(*result_order(config.sign))
