"""Queries over whole tables against brute force on small ones."""

import math
import random
from collections import defaultdict
from datetime import date, timedelta

import pytest

from ridgeline.functions import geo
from ridgeline.operators import search as rs
from ridgeline.plans import catalog
from ridgeline.sources import fixtures as fx


def save(spark, path, ways):
    """``ways``: parts of each order, in order."""
    rows = [(w, i + 1, p, 1, 1.0, date(1995, 1, 1) + timedelta(w)) for w, parts in ways.items() for i, p in enumerate(parts)]
    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_shipdate date"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/lineitem.parquet")
    return str(path)


def run(spark, sf_dir, name):
    return catalog.QUERIES[name](spark, sf_dir).collect()


def place(node):
    return node * 37 % 499, node * 91 % 491


@pytest.fixture(scope="module")
def town(spark, tmp_path_factory):
    """A folder of tables, and the nodes of each way."""
    rnd = random.Random(8)
    ways = {w: [4 * rnd.randrange(1, 41) for _ in range(rnd.randrange(2, 9))] for w in range(1, 90)}
    return save(spark, tmp_path_factory.mktemp("town"), ways), ways


def steps(ways):
    return [(a, b, w) for w, nodes in ways.items() for a, b in zip(nodes, nodes[1:]) if a != b]


def test_tiles_of_every_way(spark, tmp_path):
    ways = {7: [8, 12], 8: [4, 16]}  # the second is in another tile
    at = lambda n: next(f for f, a, b, c, d in fx.BOUNDS if a <= place(n)[0] < c and b <= place(n)[1] < d)
    want = {at(n) for nodes in ways.values() for n in nodes}
    assert {at(8), at(12)} < want
    assert {r.file_id for r in run(spark, save(spark, tmp_path, ways), "j7_x3_edge_tiles")} == want


def lengths(ways):
    out = {}
    for a, b, _ in steps(ways):
        out[a, b] = float(abs(place(a)[0] - place(b)[0]) + abs(place(a)[1] - place(b)[1]))
    return out


def test_distances_over_every_way(spark, town):
    sf_dir, ways = town
    edges = lengths(ways)
    into = defaultdict(int)
    for _, b in edges:
        into[b] += 1
    dist = {min(into, key=lambda n: (-into[n], n)): 0.0}
    for _ in range(len(into)):
        for (a, b), d in edges.items():
            if b in dist and dist[b] + d <= min(900.0, dist.get(a, 900.0)):
                dist[a] = dist[b] + d
    got = {r.id: r.dist_to_start for r in run(spark, sf_dir, "g7_g8_distance_to_start")}
    assert got == dist
    near = {n for n, d in dist.items() if d <= 450}
    want = {(a, b) for a, b in edges if a in near and b in near}
    assert {tuple(r) for r in run(spark, sf_dir, "f16_reachable")} == want


def test_every_way_has_a_bin(spark, town):
    sf_dir, ways = town
    mean = lambda w, m: sum(n % m for n in ways[w]) / len(ways[w])
    by_lat = sorted(ways, key=lambda w: (mean(w, 90), str(w)))
    assert len(by_lat) <= 256  # one stripe
    by_lon = sorted(ways, key=lambda w: (mean(w, 70), str(w)))
    bins = {w: (0, i // 64) for i, w in enumerate(by_lon)}
    assert {r.way_id: (r.x_bin, r.y_bin) for r in run(spark, sf_dir, "w5_g19_g20_bins")} == bins
    want = set()
    for b in set(bins.values()):
        rank = lambda w: (-(sum(n % 1500 for n in ways[w]) // 1000), -(len(ways[w]) * 13 % 29), str(w))
        want |= set(sorted((w for w in bins if bins[w] == b), key=rank)[:5])
    assert {r.way_id for r in run(spark, sf_dir, "w6_t2_t4_best_in_bins")} == want


def test_steps_from_every_node(spark, town):
    sf_dir, ways = town
    both = lengths(ways) | {(b, a): d for (a, b), d in lengths(ways).items()}
    one = {(a, b): d for (a, b), d in both.items() if d + b % 11 * 10 <= 625}
    want = {(a, b, c) for a, b in one for (x, c) in both if x == b}
    got = run(spark, sf_dir, "g9_g13_g14_g25_j13_two_steps")
    assert sorted((r.start, r.via, r.cur) for r in got) == sorted(want) and max(r.start for r in got) >= 100


def test_every_point_of_a_way(spark, town):
    sf_dir, ways = town

    def overlap(p, d):
        nearly = len(p) * 100 >= 300 and len(p) >= 2 and d in p[:2] and d not in p[-2:]
        return d != p[0] and not nearly

    got = {(r.way_id, r.step): r.overlaps for r in run(spark, sf_dir, "g10_overlap")}
    assert got == {(w, i + 1): overlap(p, d) for w, p in ways.items() for i, d in enumerate(p)}


def test_semi_joins_by_attributes(spark, town):
    sf_dir, ways = town
    foot = {n for a, b, w in steps(ways) if w % 5 == 0 for n in (a, b)}
    assert {r.id for r in run(spark, sf_dir, "j3_x1_used_nodes")} == foot
    inside = lambda n: all(50 <= x <= 399 for x in place(n))
    want = defaultdict(lambda: 10**9)
    for a, b, w in steps(ways):
        if inside(a) and inside(b):
            want[a, b] = min(want[a, b], w)
    assert {(r.src, r.dst): r.way_id for r in run(spark, sf_dir, "j12_loaded_graph")} == want


def loops(nodes, edges, cfg, surfaces, overlap=3):
    """Every circular route, by walking all of them; points, length and climb."""
    south, west, north, east = geo.bounding_box(cfg.start_lat, cfg.start_lon, cfg.max_distance)
    inside = {n.id for n in nodes if south <= n.lat <= north and west <= n.lon <= east}
    edges = [e for e in edges if e.src in inside and e.dst in inside]
    scale = math.cos(math.radians(cfg.start_lat))
    start = min((n for n in nodes if n.id in inside), key=lambda n: ((n.lat - cfg.start_lat) ** 2 + ((n.lon - cfg.start_lon) * scale) ** 2, n.id)).id
    left = {start: 0.0}
    for _ in inside:
        for e in edges:
            if e.dst in left and left[e.dst] + e.distance < left.get(e.src, math.inf):
                left[e.src] = left[e.dst] + e.distance
    near = {n for n, d in left.items() if d <= cfg.max_distance / 2}  # what F16 loads
    out = defaultdict(list)
    for e in edges:
        if e.src in near and e.dst in near:
            out[e.src].append(e)
    found, front = {}, [((start,), 0.0, 0.0, 0.0)]
    while front:
        points, dist, gain, bad = front.pop()
        for e in out[points[-1]]:
            d, g, s = dist + e.distance, gain + e.elevation_gain, bad + e.distance * (e.surface in surfaces)
            nearly = dist >= cfg.min_distance and len(points) >= overlap and e.dst in points[:overlap] and e.dst not in points[-overlap:]
            if e.dst != start and e.dst in points and not nearly:
                continue
            if e.dst not in left or d + left[e.dst] > cfg.max_distance or (surfaces and s > 0.5 * cfg.max_distance):
                continue
            if e.dst != start:
                front.append((points + (e.dst,), d, g, s))
            elif cfg.min_distance <= d:
                found[points + (start,)] = d, g
    return found


@pytest.mark.parametrize("name,sign,surfaces", [("g16_g18_route_search_naive", 1, ()), ("g21_g24_route_search_fuzzy", -1, ("grass",))])
def test_routes_on_the_network(spark, name, sign, surfaces):
    sf_dir = "/root/testdata/sf0.001"
    nodes, edges = (df.collect() for df in catalog._network(spark, sf_dir))
    cfg = catalog._loop_config("hilly" if sign > 0 else "flat")
    want = loops(nodes, edges, cfg, surfaces)
    got = [(tuple(map(int, r.points.split(","))), r.dist, r.gain) for r in run(spark, sf_dir, name)]
    assert 0 < len(got) <= 32 and len({p for p, *_ in got}) == len(got)
    for points, dist, gain in got:
        assert (dist, gain) == pytest.approx(want[points])
    ratios = [sign * gain / dist for _, dist, gain in got]
    assert ratios == sorted(ratios, reverse=True)


def test_a_wide_beam_finds_every_route(spark, monkeypatch):
    n, e = catalog._network(spark, "/root/testdata/sf0.001")
    cfg, progress = rs.RouteConfig(50.2, -1.7, 80_000.0, "hilly", 0.25), rs.Progress()
    want = loops(n.collect(), e.collect(), cfg, ())
    monkeypatch.setattr(rs, "beam_width", lambda n_edges, attempt, most: most)
    got = rs.find_routes(spark, n, e, cfg, rs.Settings(), progress).collect()
    assert sum(done for _, done, _ in progress.steps) == len(want) > 20
    assert {tuple(r.points) for r in got} <= set(want)
    assert got[0].gain / got[0].dist == pytest.approx(max(g / d for d, g in want.values()))


def test_lattice_grows_with_the_customers(spark, tmp_path):
    spark.range(2500).select("id").write.parquet(f"{tmp_path}/customer.parquet")
    assert catalog._lattice(spark, str(tmp_path))[0].count() == 2500
