import math
from functools import reduce
from operator import add

import pytest
from pyspark.sql import functions as F

from ridgeline.operators import search as rs
from ridgeline.plans.catalog import _lattice

EDGE = (
    "src long, dst long, distance double, elevation_gain double, elevation_loss double, surface string, dist_to_start double, "
    "lats array<double>, lons array<double>, eles array<double>, dists array<double>"
)


def edge(src, dst, distance, left, surface="grass"):
    return (src, dst, distance, 1.0, 2.0, surface, left, [0.0, 1.0], [0.0, 1.0], [0.0, 0.0], [0.0, distance])


def candidate(spark, points, dist, s_dists=None):
    row = (0, points[0], points[-1], points, dist, 0.0, 0.0, s_dists or {}, [], [], [], [])
    return spark.createDataFrame([row], rs.CANDIDATE)


def config(**kw):
    return rs.RouteConfig(**({"start_lat": 0.0, "start_lon": 0.0, "target_distance": 950.0, "distance_tolerance": 1 / 19} | kw))


@pytest.mark.parametrize(
    "points,dist,step,status",
    [
        ([0, 1, 2], 875.0, edge(2, 0, 50.0, None), "complete"),  # home, long enough
        ([0, 1, 2], 800.0, edge(2, 0, 50.0, None), "invalid"),  # home too early
        ([0, 1, 2], 875.0, edge(2, 3, 50.0, 60.0), "valid"),
        ([0, 1, 2], 875.0, edge(2, 3, 50.0, 100.0), "invalid"),  # no way back in time
        ([0, 1, 2], 875.0, edge(2, 3, 50.0, None), "invalid"),  # no way back at all
        ([0, 1, 2], 875.0, edge(2, 1, 10.0, 10.0), "invalid"),  # visited
        ([0, 1, 2, 3, 4, 5, 6], 905.0, edge(6, 1, 10.0, 10.0), "valid"),  # near the end
        ([0, 1, 2, 3, 4, 5, 6], 895.0, edge(6, 1, 10.0, 10.0), "invalid"),  # not yet
        ([0, 1, 2, 3, 4, 5, 6], 905.0, edge(6, 5, 10.0, 10.0), "invalid"),  # backtracks
    ],
)
def test_step_outcomes(spark, points, dist, step, status):
    e = spark.createDataFrame([step], EDGE)
    out = rs.take_steps(candidate(spark, points, dist), e, config(), rs.Settings()).first()
    assert out.status == status
    assert out.points == [*points, step[1]] and out.dist == dist + step[2] and out.s_dists == {"grass": step[2]}


def test_surface_restriction(spark):
    e = spark.createDataFrame([edge(2, 3, 50.0, 10.0)], EDGE)
    cand = candidate(spark, [0, 1, 2], 500.0, {"grass": 60.0})
    cfg = lambda p: config(restricted_surfaces=("grass",), restricted_surfaces_perc=p)
    got = [rs.take_steps(cand, e, cfg(p), rs.Settings()).first().status for p in (0.0, 0.1, 0.2)]
    assert got == ["invalid", "invalid", "valid"]
    assert config(restricted_surfaces=("grass",)).restriction is None


def test_config():
    c = rs.RouteConfig.parse({"start_lat": "1", "start_lon": "2", "target_distance": "1000", "highway_types": "a,b", "distance_tolerance": "0.25"})
    assert (c.min_distance, c.max_distance, c.highway_types) == (800.0, 1250.0, ("a", "b"))
    with pytest.raises(ValueError):
        rs.RouteConfig(0, 0, 1, "steep")
    with pytest.raises(KeyError):
        rs.Settings.from_environment("NOT_SET_")


@pytest.mark.parametrize("cap,shape", [(1024, (256, 64)), (1280, (256, 64)), (5432, (576, 64))])
def test_bin_shape(cap, shape):
    assert rs.bin_shape(cap, 64) == shape
    assert rs.bin_count(cap, cap, 64) == -(-cap // 64) and rs.bin_count(1, cap, 64) == 1


def test_bins(spark):
    rows = [(0, f"{i}", [float(i // 8 % 8)], [float(i % 8)]) for i in range(512)]
    df = spark.createDataFrame(rows, "job_id long, points string, lats array<double>, lons array<double>")
    out = rs.bin_candidates(df, 1024, rs.Settings(bin_size=32))
    counts = [r["count"] for r in out.groupBy("x_bin", "y_bin").count().collect()]
    assert counts == [32] * 16


def test_order_and_beam(spark):
    rows = [(0, "a", 5500.0, 10.0), (0, "b", 5100.0, 20.0), (0, "c", 6000.0, 1.0), (0, "d", 4000.0, 99.0)]
    df = spark.createDataFrame(rows, "job_id long, points string, dist double, gain double")
    assert [r.points for r in df.orderBy(*rs.candidate_order(1)).collect()] == ["c", "b", "a", "d"]
    assert [r.points for r in df.orderBy(*rs.candidate_order(-1)).collect()] == ["c", "a", "b", "d"]
    assert sorted(r.points for r in rs.best_in_bins(df, 2, 1, ("job_id",)).collect()) == ["b", "c"]
    assert [rs.beam_width(10, a, 64) for a in (1, 2, 3)] == [10, 40, 64]


def test_pick_dissimilar():
    s = [frozenset(range(10)), frozenset(range(1, 11)), frozenset(range(20, 30)), frozenset(range(30, 33))]
    assert rs.pick_dissimilar(s, 5, 0.95) == [0, 1, 2, 3]
    assert rs.pick_dissimilar(s, 2, 0.95) == [0, 2]
    assert rs.pick_dissimilar(s, 3, 0.95) == [0, 2, 1]
    assert rs.pick_dissimilar([s[0]] * 4, 3, 0.95) == [0]
    assert rs.pick_dissimilar(s, 0, 0.95) == []


def test_distances(spark):
    e = spark.createDataFrame([(1, 2, 5.0), (2, 3, 5.0), (1, 3, 20.0), (3, 4, 1.0), (4, 1, 1.0), (9, 3, 500.0)], "src long, dst long, distance double")
    start = spark.createDataFrame([(0, 3), (1, 1)], "job_id long, id long")
    got = {(r.job_id, r.id): r.dist_to_start for r in rs.distances_to(e, start, 100.0).collect()}
    assert got == {(0, 3): 0.0, (0, 2): 5.0, (0, 1): 10.0, (0, 4): 11.0, (1, 1): 0.0, (1, 4): 1.0, (1, 3): 2.0, (1, 2): 7.0}


def test_return_paths(spark):
    e = spark.createDataFrame([(2, 3, 1.0), (3, 0, 1.0), (5, 1, 1.0), (1, 0, 1.0), (7, 8, 1.0)], "src long, dst long, distance double")
    rows = [(0, 0, 2, [0, 1, 2], 2.0), (1, 0, 5, [0, 1, 5], 2.0), (2, 0, 7, [0, 1, 7], 2.0)]
    c = spark.createDataFrame(rows, "job_id long, start long, cur long, points array<long>, dist double")
    assert sorted(r.job_id for r in rs.return_paths(c, e, 1, 100.0).collect()) == [0]
    assert sorted(r.job_id for r in rs.return_paths(c, e, 2, 100.0).collect()) == [0, 1]


def test_return_paths_are_short_enough(spark):
    """A loop of six kilometres is no way home for a route of 1.5."""
    ring = [(i, (i + 1) % 6, 1000.0) for i in range(6)] + [(1, 9, 10.0), (9, 0, 10.0)]
    e = spark.createDataFrame(ring, "src long, dst long, distance double")
    c = spark.createDataFrame([(0, 0, 1, [0, 1], 1000.0), (1, 0, 3, [0, 1, 2, 3], 3000.0)], "job_id long, start long, cur long, points array<long>, dist double")
    got = lambda most: sorted(r.job_id for r in rs.return_paths(c, e, 1, most).collect())
    assert got(1500.0) == [0] and got(1020.0) == [] and got(6000.0) == [0] and got(6000.1) == [0, 1]


def test_a_long_way_home_is_walked_to_its_end(spark):
    n = 40
    e = spark.createDataFrame([(i, (i + 1) % n, 1.0) for i in range(n)], "src long, dst long, distance double")
    c = spark.createDataFrame([(0, 0, 1, [0, 1], 1.0)], "job_id long, start long, cur long, points array<long>, dist double")
    assert rs.return_paths(c, e, 1, n + 1.0).count() == 1 and rs.return_paths(c, e, 1, float(n)).count() == 0


@pytest.mark.parametrize("mode,strategy", [("hilly", "fuzzy"), ("flat", "naive")])
def test_search_finds_loops(spark, mode, strategy):
    n, e = _lattice(spark, "/root/testdata/sf0.001")
    cfg = rs.RouteConfig(50.205, -1.69, 800.0, mode, 0.15)
    progress = rs.Progress()
    out = rs.find_routes(spark, n, e, cfg, rs.Settings(max_candidates=64, max_routes=6, pruning_strategy=strategy), progress).collect()
    assert 0 < len(out) <= 6 and len({r.id for r in out}) == len(out) and progress.steps
    step = {(r.src, r.dst): r for r in e.collect()}
    start = n.orderBy(F.expr("pow(lat - 50.205, 2) + pow((lon + 1.69) * cos(radians(50.205)), 2)"), "id").first().id
    for r in out:
        assert r.points[0] == r.points[-1] == start
        assert cfg.min_distance <= r.dist <= cfg.max_distance
        assert r.dist == sum(step[a, b].distance for a, b in zip(r.points, r.points[1:]))
        assert r.gain == sum(step[a, b].elevation_gain for a, b in zip(r.points, r.points[1:]))
        assert len(r.lats) == 2 * (len(r.points) - 1) and r.bbox.min_lat == min(r.lats)
    ratio = [r.gain / r.dist for r in out]
    assert ratio == sorted(ratio, reverse=mode == "hilly")


def beam(nodes, edges, cfg, settings):
    """The pruned search in plain Python, step by step; the completed routes.

    ``edges`` as the search has them, with the distance home of their ends.
    """
    start = min(nodes, key=lambda n: ((n.lat - cfg.start_lat) ** 2 + ((n.lon - cfg.start_lon) * math.cos(math.radians(cfg.start_lat))) ** 2, n.id)).id
    out = {}
    for e in edges:
        out.setdefault(e.src, []).append(e)
    width = min(len(edges), settings.max_candidates)
    front, done = [((start,), 0.0, 0.0, [], [])], []
    while front:
        valid = []
        for points, dist, gain, lats, lons in front:
            for e in out.get(points[-1], []):
                first, recent = points[:3], points[-3:]
                nearly = dist >= cfg.min_distance and len(points) >= 3 and e.dst in first and e.dst not in recent
                total = dist + e.distance
                if e.dst != start and e.dst in points and not nearly:
                    continue
                home = 0.0 if e.dst == start else e.dist_to_start
                if home is None or total + home > cfg.max_distance:
                    continue
                row = (points + (e.dst,), total, gain + e.elevation_gain, lats + e.lats, lons + e.lons)
                if e.dst != start:
                    valid.append(row)
                elif cfg.min_distance <= total <= cfg.max_distance:
                    done.append(row)
        front = valid if len(valid) <= width else pruned(valid, width, cfg, settings)
    return {p: (d, g) for p, d, g, *_ in done}


def pruned(rows, width, cfg, settings):
    text = lambda r: "[" + ", ".join(map(str, r[0])) + "]"
    middle = lambda x: reduce(add, x) / len(x)  # noqa: E731 - sum() rounds otherwise
    bins = math.ceil(width / settings.bin_size)
    across = math.ceil(math.sqrt(bins))
    stripe = settings.bin_size * math.ceil(bins / across)
    rows = sorted(rows, key=lambda r: (middle(r[3]), text(r)))
    stripes = [sorted(rows[i : i + stripe], key=lambda r: (middle(r[4]), text(r))) for i in range(0, len(rows), stripe)]
    bins = [s[i : i + settings.bin_size] for s in stripes for i in range(0, len(s), settings.bin_size)]
    target = max(1, width // len(bins))
    best = lambda r: (-(r[1] // 1000), -int(cfg.sign * r[2]), text(r))
    kept = []
    for b in bins:
        b = sorted(b, key=best)
        kept += b[:target] if settings.pruning_strategy == "naive" else unlike(b, target, settings.pruning_threshold)
    return kept


def unlike(rows, target, most):
    """The best rows that are not too much like better ones, the limit rising
    from 0.7 by 0.1 while there are too few."""
    if len(rows) <= target:
        return rows
    kept, rest, limit = [rows[0]], rows[1:], 0.7
    while True:
        again = []
        for r in rest:
            a = set(r[0])

            def alike(k, a=a):
                b = set(k[0])
                sizes = sorted((len(a), len(b)))
                return sizes[0] < sizes[1] * limit or sizes[1] > sizes[0] * (2 - limit) or len(a & b) > limit * len(a | b)

            if len(kept) < target and not any(alike(k) for k in kept):
                kept.append(r)
            else:
                again.append(r)
        if len(kept) >= target or limit >= most:
            return kept
        rest, limit = again, min(limit + 0.1, most)


@pytest.mark.parametrize("mode,strategy,most", [("hilly", "naive", 64), ("flat", "fuzzy", 100)])
def test_pruned_search_against_plain_python(spark, mode, strategy, most):
    """The beam keeps just the candidates that a plain search keeps (G16-G18,
    G20, G21)."""
    n, e = _lattice(spark, "/root/testdata/sf0.001")
    cfg = rs.RouteConfig(50.205, -1.69, 900.0, mode, 0.15)
    settings = rs.Settings(max_candidates=most, bin_size=16, max_routes=10_000, display_threshold=1.0, pruning_strategy=strategy)
    nodes, edges = rs.loaded_graph(rs.nodes_window(n, cfg), rs.edges_window(e, cfg))
    start = rs.start_node(rs.tag_start(nodes, rs.nearest_node(nodes, cfg.start_lat, cfg.start_lon).first().id))
    graph = rs.search_graph(edges, nodes, start, cfg.max_distance)
    want = beam(nodes.collect(), graph.collect(), cfg, settings)
    found = rs._attempt(start, graph, most, cfg, settings, float("inf"), rs.Progress())
    got = {tuple(r.points): (r.dist, r.gain) for r in found.collect()}
    assert got == want and len(want) > 5


def test_no_route_and_timeout(spark):
    n, e = _lattice(spark, "/root/testdata/sf0.001")
    far = rs.RouteConfig(50.205, -1.69, 150.0, distance_tolerance=0.01)
    assert rs.find_routes(spark, n, e, far, rs.Settings(max_candidates=8)).count() == 0
    with pytest.raises(rs.SearchTimeout):
        rs.find_routes(spark, n, e, rs.RouteConfig(50.205, -1.69, 800.0), rs.Settings(max_job_seconds=0.0))


def test_wider_beams_only_without_a_route(spark, monkeypatch):
    """An attempt that completes nothing is followed by one with a beam
    four and nine times as wide, up to the cap; the first routes end it."""
    n, e = _lattice(spark, "/root/testdata/sf0.001")
    cfg = rs.RouteConfig(50.205, -1.69, 800.0)
    run, widths = rs._attempt, []

    def attempt(after):
        def f(start, edges, width, *rest):
            widths.append(width)
            return run(start, edges, width, *rest) if len(widths) > after else None

        return f

    for after, cap, most in ((0, 10**6, 1), (1, 10**6, 2), (5, 10**6, 3), (5, 1, 1)):
        widths.clear()
        monkeypatch.setattr(rs, "_attempt", attempt(after))
        found = rs.find_routes(spark, n, e, cfg, rs.Settings(max_candidates=cap, max_routes=4, pruning_strategy="naive", max_steps=40)).count()
        assert len(widths) == most and (found > 0) == (after < most)
        assert widths == [min(widths[0] * k * k, cap) for k in range(1, most + 1)]
