"""Per-line and per-tile helpers against plain rules, and the trail network on a small map."""

import heapq
import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.operators import assembly as A
from waymark.operators import catalogue as C
from waymark.operators import lines as L
from waymark.operators import listings as I
from waymark.operators import network as N
from waymark.operators import refine as R
from waymark.operators import routing
from waymark.operators import wetness as W
from waymark.operators.rounds import settled
from waymark.sources import dem_catalog


def flooded(z):
    """Pits raised by visiting cells from the lowest edge inwards."""
    h, w = z.shape
    out, seen, heap = {}, set(), []
    near = lambda r, c: [(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
    for r in range(h):
        for c in range(w):
            if np.isfinite(z[r, c]) and any(not (0 <= a < h and 0 <= b < w) or not np.isfinite(z[a, b]) for a, b in near(r, c)):
                heapq.heappush(heap, (z[r, c], r, c))
                seen.add((r, c))
    while heap:
        e, r, c = heapq.heappop(heap)
        out[r, c] = e
        for a, b in near(r, c):
            if 0 <= a < h and 0 <= b < w and np.isfinite(z[a, b]) and (a, b) not in seen:
                seen.add((a, b))
                heapq.heappush(heap, (z[a, b] if z[a, b] > e else e + W.RISE, a, b))
    return out


def drained(z, res):
    """The index cell by cell, from the highest down."""
    f = flooded(z)
    area = dict.fromkeys(f, 1.0)
    out = {}
    for (r, c), e in sorted(f.items(), key=lambda x: -x[1]):
        falls = {(r + i, c + j): max(e - f[r + i, c + j], 0) / (math.hypot(i, j) * res) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and (r + i, c + j) in f}
        total = sum(s**W.POWER for s in falls.values())
        for k, s in falls.items():
            area[k] += area[r, c] * s**W.POWER / total if total else 0
    for r, c in f:
        tan = max([(z[r, c] - z[a, b]) / (math.hypot(a - r, b - c) * res) for a in (r - 1, r, r + 1) for b in (c - 1, c, c + 1) if (a, b) in f and (a, b) != (r, c)] + [W.LEAST_SLOPE])
        out[r, c] = math.log(area[r, c] * res / tan)
    return out


def test_pits_are_filled_over_any_tiles(spark):
    """A lake and its only outlet in different tiles, holes without data, a moat round an island of data: cell by cell as on one grid."""
    rng = np.random.default_rng(7)
    r, c = np.mgrid[0:45, 0:38]
    z = 50 + 8 * np.sin(r / 6.0) * np.cos(c / 5.0) + rng.normal(0, 0.6, r.shape)
    z[6:30, 5:33] -= 30  # a basin over many tiles
    z[17, 0:6] = 31.0  # and its outlet
    z[33:36, 10:13] = np.nan
    z[40:44, 20] = np.nan
    cells = spark.createDataFrame([(int(i) - 11, int(j) - 5, float(z[i, j])) for i, j in np.argwhere(np.isfinite(z))], "r int, c int, z double")
    want = {(i - 11, j - 5): v for (i, j), v in flooded(z).items()}
    for side in (7, 16, 64):
        got = {(x.r, x.c): (x.z, x.filled) for x in W.fill_pits(cells, side).collect()}
        assert got.keys() == want.keys() and all(abs(got[k][1] - v) < 1e-12 for k, v in want.items())
    lake = {round(want[i - 11, j - 5], 1) for i in range(10, 26) for j in range(9, 29)}
    assert lake == {31.0}
    assert W.fill_pits(cells.limit(0)).count() == 0


def test_wetness_against_cell_by_cell(spark):
    rng = np.random.default_rng(8)
    z = np.round(rng.normal(50, 4, (18, 23)), 1) + np.arange(23) * 0.4
    z[4:6, 7:9] = np.nan
    want = drained(z, 5.0)
    surface = np.full(z.shape, np.nan)
    for (r, c), v in flooded(z).items():
        surface[r, c] = v
    got = W.wetness(z, surface, 5.0)
    assert all(abs(got[k] - v) < 1e-6 for k, v in want.items()) and np.isnan(got[4, 7])
    cells = spark.createDataFrame([(r, c, None if np.isnan(z[r, c]) else float(z[r, c])) for r in range(18) for c in range(23)], "r int, c int, z double")
    rows = W.twi(cells, 5.0, core=64, halo=30).collect()
    assert len(rows) == len(want) and all(abs(want[r.r, r.c] - r.twi) < 1e-6 for r in rows)
    tiled = {(r.r, r.c): r.twi for r in W.twi(cells, 5.0, core=8, halo=30).collect()}
    assert len(tiled) == len(want)  # a halo over the whole grid: tiles agree with it
    assert all(abs(tiled[k] - v) < 1e-6 for k, v in want.items())


def hairpin(spark):
    """Up along x on a slope that falls to +y, round a half circle of 6 m, and back."""
    xy, heading = [], []
    for k in range(40):
        xy.append((float(k), 0.0))
        heading.append(0.0)
    for k in range(1, 19):
        a = math.pi * k / 19
        xy.append((39 + 6 * math.sin(a), 6 - 6 * math.cos(a)))
        heading.append(a)
    for k in range(40):
        xy.append((39.0 - k, 12.0))
        heading.append(math.pi)
    d, rows = 0.0, []
    for i, ((x, y), h) in enumerate(zip(xy, heading)):
        d += math.dist(xy[i - 1], (x, y)) if i else 0.0
        gx, gy = 0.0, -0.3
        along, cross = gx * math.cos(h) + gy * math.sin(h), -gx * math.sin(h) + gy * math.cos(h)
        kappa = 1 / 6 if 40 <= i < 58 else 0.0
        rows.append((1, i, d, x, y, h, h, kappa, 6.0 if kappa else 1000.0, cross, along, math.degrees(math.atan2(abs(cross), abs(along))), 30.0, 100 - 0.3 * y, 100 - 0.3 * y))
    return spark.createDataFrame(rows, "line_id int, i int, d double, x double, y double, heading double, theta double, kappa double, bend_r double, s_cross double, s_along double, tsa double, side double, z double, zd double")


def test_a_hairpin_is_one_corner_and_may_be_dug(spark):
    s = hairpin(spark)
    (c,) = R.corners(s, 0.05, 30.0).collect()
    assert 38 <= c.a <= 42 and 55 <= c.b <= 59 and abs(c.turn_deg - 180) < 25 and c.kind == "switchback" and c.r <= 6.0 and c.tsa_min < 30
    curves = {"grade": [(0, 0.01), (10, 1), (40, 100)], "cutfill": [(-4, 2), (0, 0.01), (4, 2)]}
    corners = R.corners(s, 0.05, 30.0)
    kept = R.dig_corners(s, corners, curves, {"grade": 1.0, "cutfill": 1e6}, 4.0).collect()
    assert all(abs(r.zd - b.zd) < 1e-9 for r, b in zip(sorted(kept, key=lambda r: r.i), s.orderBy("i").collect()))
    dug = {r.i: r.zd for r in R.dig_corners(s, corners, curves, {"grade": 1.0, "cutfill": 1e-6}, 4.0).collect()}
    ground = {r.i: r.zd for r in s.collect()}
    assert dug[0] == ground[0] and dug[97] == ground[97] and max(abs(dug[i] - ground[i]) for i in dug) > 0.5
    assert R.corners(s.limit(0), 0.05, 30.0).count() == 0


def test_corners_that_overlap_are_dug_in_order_in_one_go(spark, monkeypatch):
    """As if each were dug by itself into the line that the one before left; no table is written for it."""
    s = hairpin(spark).select("line_id", "i", "d", "z", (F.col("zd") + F.sin("i")).alias("zd")).cache()
    curves = {"grade": [(0, 0.01), (10, 1), (40, 100)], "cutfill": [(-4, 2), (0, 0.01), (4, 2)]}
    dig = lambda rows, *ends: R.dig_corners(rows, spark.createDataFrame([(1, a, b) for a, b in ends], "line_id int, a int, b int"), curves, {"grade": 1.0, "cutfill": 0.1}, 4.0, 30.0)
    ends, line = [(35, 45), (40, 58), (52, 70)], {r.i: r.zd for r in s.collect()}
    monkeypatch.setattr(R, "settled", None)
    once = {r.i: r.zd for r in dig(s, *ends[::-1]).collect()}
    for e in ends:
        rows = s.drop("zd").join(spark.createDataFrame(list(line.items()), "i int, zd double"), "i")
        line = {r.i: r.zd for r in dig(rows, e).collect()}
    assert once == line and once != {r.i: r.zd for r in s.collect()}


def test_fill_matches_a_cut(spark):
    curve = [(-2, 8), (0, 1), (4, 8)]
    got = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (None,)], "c double").select(R.fill_for(F.col("c"), curve).alias("f")).collect()
    assert [None if r.f is None else round(r.f, 2) for r in got] == [0.0, 2.0, 4.0, None]


def test_lost_climb_is_spread_over_the_fall(spark):
    s = spark.createDataFrame([(1, i, float(i), z) for i, z in enumerate([0.0, 5.0, 3.0, 1.0, 6.0])], "line_id int, i int, d double, zd double")
    got = {r.i: r.climbs for r in R.lost_climb(s, [(0, 1), (10, 1)], 1.0).collect()}
    assert got == {0: 0.0, 1: 0.0, 2: 2.0, 3: 2.0, 4: 0.0}


def test_network_edges_and_ways(spark):
    rows = [(1, [(0, 0), (100, 0)]), (2, [(50, -50), (50, 50)]), (3, [(80, 3), (80, 60)]), (4, [(500, 500), (600, 500)])]
    v = spark.createDataFrame([(i, k, float(x), float(y)) for i, p in rows for k, (x, y) in enumerate(p)], "line_id int, seq int, x double, y double")
    edges = N.trail_network_edges(v)
    got = {(r.line_id, r.edge): round(r.length, 3) for r in edges.collect()}
    assert got == {(1, 0): 50, (1, 1): 30, (1, 2): 20, (2, 0): 50, (2, 1): 50, (3, 0): 57, (4, 0): 100}
    pairs = spark.createDataFrame([(1, 0.0, 2.0, 80.0, 60.0), (2, 10.0, 0.0, 30.0, 0.0), (3, 0.0, 0.0, 600.0, 500.0), (4, 0.0, 0.0, 5000.0, 0.0), (5, 10.0, 0.0, 10.0, 1.0)], "pair_id int, x double, y double, x2 double, y2 double")
    found = routing.follow_network(v, edges, pairs).persist()
    ways = {r.pair_id: r for r in found.collect()}
    assert abs(ways[1].length - 137) < 1e-6 and [(t.line_id, round(t.length, 6)) for t in ways[1].trails] == [(1, 80), (3, 57)] and ways[1].start_off == 2
    assert abs(ways[2].length - 20) < 1e-6 and [t.line_id for t in ways[2].trails] == [1]
    assert [ways[k].error for k in (3, 4, 5)] == ["not connected", "too far", "same place"]
    path = [(r.x, r.y) for r in routing.route_vertices(found, v).filter("pair_id = 1").orderBy("seq").collect()]
    assert path == [(0, 0), (50, 0), (80, 0), (80, 3), (80, 60)]
    assert routing.follow_network(v, edges.limit(0), pairs).filter("error = 'no trails'").count() == 5
    far = pairs.select("pair_id", *[(F.col(c) + 50_000).alias(c) for c in ("x", "y", "x2", "y2")])
    assert routing.follow_network(v, edges, far).filter("error = 'no trails'").count() == 5
    with pytest.raises(RuntimeError, match="rounds"):
        routing.follow_network(v, edges, pairs, most_rounds=1)
    found.unpersist()


def lattice(spark, n, gap=100.0, missing=()):
    """n rows and n columns of straight lines, some cells of the rows left out."""
    rows = [(k, [(0.0, k * gap), ((n - 1) * gap, k * gap)]) for k in range(n) if k not in missing]
    rows += [(n + k, [(k * gap, 0.0), (k * gap, (n - 1) * gap)]) for k in range(n)]
    return rows, spark.createDataFrame([(i, k, x, y) for i, p in rows for k, (x, y) in enumerate(p)], "line_id int, seq int, x double, y double")


def test_ways_against_one_search_a_pair(spark):
    """Random slanted lines and pairs; lengths against a search over the same edges, paths against their lengths."""
    rng = random.Random(12)
    rows = [(i, [(rng.uniform(0, 900), rng.uniform(0, 900)) for _ in range(4)]) for i in range(9)]
    v = spark.createDataFrame([(i, k, x, y) for i, p in rows for k, (x, y) in enumerate(p)], "line_id int, seq int, x double, y double")
    edges = N.trail_network_edges(v)
    pairs = spark.createDataFrame([(k, *[rng.uniform(100, 800) for _ in range(4)]) for k in range(12)], "pair_id int, x double, y double, x2 double, y2 double")
    found = routing.follow_network(v, edges, pairs).persist()
    held = edges.collect()
    on = {}
    for r in routing._places(v, edges, pairs, 250.0).collect():
        on[r.pair_id, r.end] = r
    near = lambda p: {n: p.along - p.d0 if n == p.a else p.d1 - p.along for n in (p.a, p.b)}
    for r in found.collect():
        s, g = on.get((r.pair_id, 0)), on.get((r.pair_id, 1))
        if s is None or g is None:
            assert r.error == "too far"
            continue
        best = dict(near(s))
        for _ in range(len(held)):
            for e in held:
                for a, b in ((e.a, e.b), (e.b, e.a)):
                    if a in best and best[a] + e.length < best.get(b, math.inf):
                        best[b] = best[a] + e.length
        want = min([best[n] + m for n, m in near(g).items() if n in best] + [abs(s.along - g.along)] * ((s.line_id, s.edge) == (g.line_id, g.edge)), default=None)
        assert r.error == "same place" if want is not None and want < 1e-6 else (r.length is None) == (want is None) and (want is None or abs(r.length - want) < 1e-6), r
    paths = {}
    for r in routing.route_vertices(found, v, 120.0).orderBy("pair_id", "seq").collect():
        paths.setdefault(r.pair_id, []).append((r.x, r.y))
    whole = [r for r in found.collect() if r.error is None]
    assert len(whole) > 6
    for r in whole:
        assert abs(sum(math.dist(a, b) for a, b in zip(paths[r.pair_id], paths[r.pair_id][1:])) - r.length) < 0.01
        assert abs(sum(t.length for t in r.trails) - r.length) < 1e-6
    found.unpersist()


def test_ways_stay_in_the_box_and_near_the_best(spark, monkeypatch):
    """On a wide lattice a short pair's ways reach no farther than its best way allows; outside the box there are none at all."""
    rows, v = lattice(spark, 12, missing=(5,))
    edges = N.trail_network_edges(v)
    pairs = spark.createDataFrame([(1, 210.0, 200.0, 390.0, 200.0), (2, 200.0, 450.0, 300.0, 550.0)], "pair_id int, x double, y double, x2 double, y2 double")
    seen = []
    real = routing.settled
    monkeypatch.setattr(routing, "settled", lambda df: seen.append(real(df)) or seen[-1])
    got = {r.pair_id: r for r in routing.follow_network(v, edges, pairs).collect()}
    assert abs(got[1].length - 180) < 1e-6 and abs(got[2].length - 300) < 1e-6
    reached = {(r.pair_id, r.node.x, r.node.y) for df in seen if df.columns == ["pair_id", "node", *routing._WAY] for r in df.collect()}
    assert len(reached) < 60 and all(100_000 <= x <= 500_000 for _, x, _ in reached)
    seen.clear()
    routing.follow_network(v, edges, pairs.filter("pair_id = 1"), margin=-250.0, share=0.0).collect()
    assert max(df.count() for df in seen if df.columns == ["pair_id", "node", *routing._WAY]) <= 2


def test_segments_walk_their_own_cells(spark):
    rng = random.Random(6)
    rows = [(k, *[rng.uniform(-300, 300) for _ in range(4)]) for k in range(200)] + [(900, 0.0, 0.0, 100_000.0, 90_000.0), (901, 50.0, 0.0, 50.0, 200.0), (902, 0.0, 50.0, 200.0, 50.0)]
    frame = spark.createDataFrame(rows, "k int, x double, y double, x2 double, y2 double")
    for r in frame.select("*", L._segment_cells(50.0).alias("cells")).collect():
        cells = {(c.cx, c.cy) for c in r.cells}
        assert len(cells) == len(r.cells) <= 4 + 2 * math.dist((r.x, r.y), (r.x2, r.y2)) / 50
        for t in range(501):
            x, y = r.x + (r.x2 - r.x) * t / 500, r.y + (r.y2 - r.y) * t / 500
            assert (math.floor(x / 50), math.floor(y / 50)) in cells


def test_merged_parts_are_not_sent_to_the_driver(spark):
    frame = spark.createDataFrame([(1, p, k, float(p + k), 0.0) for p in range(3) for k in range(2)], "line_id int, part int, seq int, x double, y double")
    merged = N.merge_parts(frame)
    assert merged.count() == 4
    assert "Broadcast" not in merged._jdf.queryExecution().executedPlan().toString()


def test_parts_that_touch_are_merged(spark):
    parts = [(1, 0, [(0, 0), (1, 0)]), (1, 1, [(3, 0), (2, 0), (1, 0)]), (1, 2, [(3, 0), (4, 0)]), (1, 3, [(9, 9), (9, 8)]), (2, 0, [(0, 0), (1, 1)]), (2, 1, [(1, 1), (2, 0)]), (2, 2, [(1, 1), (1, 5)])]
    frame = spark.createDataFrame([(i, p, k, float(x), float(y)) for i, p, v in parts for k, (x, y) in enumerate(v)], "line_id int, part int, seq int, x double, y double")
    out = {}
    for r in N.merge_parts(frame).orderBy("line_id", "part", "seq").collect():
        out.setdefault((r.line_id, r.part), []).append((r.x, r.y))
    one = out[1, 0]
    assert one in ([(0, 0), (1, 0), (2, 0), (3, 0), (4, 0)], [(4, 0), (3, 0), (2, 0), (1, 0), (0, 0)])
    assert len(out) == 2 + 3 and sorted(map(len, out.values())) == [2, 2, 2, 2, 5]


def test_catalogue_file(spark, tmp_path):
    ring = [[[1, 2], [3, 4], [5, 6], [1, 2]]]
    features = [{"properties": {"id": "a", "title": "A", "year": 2020, "native_res_m": 0.5}, "geometry": {"type": "Polygon", "coordinates": ring}}, {"properties": {"title": "no id"}, "geometry": None}, {"properties": {"id": "b", "notes": None}, "geometry": {"type": "Point", "coordinates": [1, 2]}}]
    (tmp_path / "c.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features, "context": {"id": "ctx", "pmtiles_url": "p", "max_zoom": 0}}))
    rows = {r.slug: r for r in dem_catalog.read_dem_catalog(spark, str(tmp_path / "c.geojson")).collect()}
    assert set(rows) == {"a", "b", "ctx", "terrarium", "usgs3dep"}
    assert rows["a"].year == 2020 and json.loads(rows["a"].footprint) == [ring] and rows["b"].footprint is None and rows["b"].notes == ""
    assert (rows["ctx"].min_zoom, rows["ctx"].max_zoom, rows["ctx"].native_res_m, rows["ctx"].title) == (0, 13, 10.0, "ctx") and not rows["usgs3dep"].enabled


def test_trees_deeper_than_a_hundred(spark):
    n = 400
    nodes = spark.range(1, n + 1).select(F.col("id").alias("a"), F.when(F.col("id") > 1, F.col("id") - 1).alias("parent_id"))
    ring = spark.createDataFrame([(1001, 1002), (1002, 1003), (1003, 1001), (1004, 1001)], "a long, parent_id long")
    tree = {r.id: (r.root, r.depth) for r in C.variant_tree(spark, nodes.union(ring), "a").collect()}
    assert tree == {k: (1, k - 1) for k in range(1, n + 1)}
    up = C.ancestors(spark, nodes.filter("a > 250").union(ring), "a").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("depth", "ancestor"))).alias("x")).collect()
    chains = {r.id: [y.ancestor for y in r.x] for r in up}
    assert chains[400] == list(range(399, 249, -1)) and chains[1001] == [1002, 1003] and chains[1004] == [1001, 1002, 1003]
    sections = spark.createDataFrame([(1, None, 5), (2, 1, 5), (3, 2, 6), (4, 3, 5), (5, 2, 5)], "a int, parent_id int, section_id int")
    assert {r.id: r.section_id for r in C.move_with_variants(spark, sections, "a", 2, 9).collect()} == {1: 5, 2: 9, 3: 6, 4: 5, 5: 9}


def test_arcs_keep_their_radius(spark):
    v = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 50.0, 0.0), (1, 2, 50.0, 50.0), (1, 3, 50.5, 50.0), (1, 4, 50.5, 90.0)], "line_id int, seq int, x double, y double")
    rows = L.fillet(v, 8.0, 1.0).filter("seq = 1").collect()
    assert all(abs(math.dist((r.x, r.y), (42.0, 8.0)) - 8) < 1e-6 for r in rows) and len(rows) == math.ceil(8 * math.pi / 2) + 1


def nearest_place(line, p):
    best, done = None, 0.0
    for (x, y), (x2, y2) in itertools.pairwise(line):
        size = math.dist((x, y), (x2, y2))
        t = min(max(((p[0] - x) * (x2 - x) + (p[1] - y) * (y2 - y)) / size**2, 0), 1)
        found = math.dist(p, (x + t * (x2 - x), y + t * (y2 - y))), done + t * size
        best = found if best is None or found[0] < best[0] - 1e-12 else best
        done += size
    return best


def metres(line):
    return sum(math.dist(a, b) for a, b in itertools.pairwise(line))


def joint(p, n):
    """(price, kind, gap, cut of p, cut of n) of two lines as they run."""
    gap = math.dist(p[-1], n[0])
    out = gap, "end", gap, None, None
    away, s = nearest_place(p, n[0])
    if 1 < s < metres(p) - 0.5 and away + 1 < gap:
        out = away + 1, "leaves", away, s, None
    away, s = nearest_place(n, p[-1])
    if 0.5 < s < metres(n) - 1 and away + 1 < out[2]:
        out = away + 1, "joins", away, None, s
    return out


def test_routes_are_put_together_the_cheapest_way(spark):
    rng, lines, pieces = random.Random(9), {}, []
    for route in range(30):
        at = 0.0
        for k in range(rng.randrange(1, 6)):
            size, side = rng.uniform(20, 60), rng.uniform(-6, 6)
            line = [(at + size * f + rng.uniform(-3, 3), side + rng.uniform(-2, 2)) for f in (0, 0.3, 0.55, 0.8, 1)]
            lines[route * 10 + k] = line[::-1] if rng.random() < 0.4 else line
            pieces.append((route, k, route * 10 + k, rng.choice([None, None, None, True, False])))
            at += size + rng.uniform(-15, 8)
    pieces.append((99, 0, 12345, None))
    legs = [(i, leg, k, x, y) for i, line in lines.items() for leg, part in enumerate((line[:3], line[2:])) for k, (x, y) in enumerate(part)]
    joins, report, vertices = A.assemble_route(spark.createDataFrame(pieces, "route_id int, place int, piece_id int, forced boolean"), spark.createDataFrame(legs, "piece_id int, leg int, seq int, x double, y double"))
    got, told, drawn = {}, {}, {}
    for r in joins.orderBy("route_id", "place").collect():
        got.setdefault(r.route_id, []).append(r)
    for r in report.orderBy("route_id", "place").collect():
        told.setdefault(r.route_id, []).append(r)
    for r in vertices.orderBy("route_id", "n", "seq").collect():
        drawn.setdefault(r.route_id, {}).setdefault((r.n, r.piece_id, r.leg), []).append((r.x, r.y))
    assert [r.error for r in told.pop(99)] == ["no legs"] and 99 not in drawn
    kinds = set()
    for route, found in told.items():
        own = [p for p in pieces if p[0] == route]
        run = lambda way: [lines[p[2]][::-1] if t else lines[p[2]] for p, t in zip(own, way)]
        price = lambda way: (round(sum(joint(a, b)[0] for a, b in itertools.pairwise(run(way))), 9), sum(way))
        allowed = [w for w in itertools.product((False, True), repeat=len(own)) if all(p[3] is None or p[3] == t for p, t in zip(own, w))]
        way = tuple(r.turned for r in found)
        assert way in allowed and price(way) == min(map(price, allowed))
        kept = [[0.0, metres(x)] for x in run(way)]
        for k, (j, r) in enumerate(zip([joint(a, b) for a, b in itertools.pairwise(run(way))], got.get(route, []))):
            kinds.add(r.kind)
            assert (r.kind, r.bridge) == (j[1], j[2] > 3) and abs(r.gap - j[2]) < 1e-9
            kept[k][1], kept[k + 1][0] = j[3] or kept[k][1], j[4] or 0.0
        assert all(abs(a - r.kept0) < 1e-9 and abs(b - r.kept1) < 1e-9 for (a, b), r in zip(kept, found))
        if any(b - a < 1 for a, b in kept):
            assert "cut away" in {r.error for r in found} and route not in drawn
            continue
        legs_of = [drawn[route][k] for k in sorted(drawn[route], key=lambda k: k[0])]
        assert all(a[-1] == b[0] for a, b in itertools.pairwise(legs_of))
        assert sum(k[1] is None for k in drawn[route]) == sum(r.bridge for r in got.get(route, []))
        snapped = sum(r.snapped for r in got.get(route, []))
        assert abs(sum(map(metres, legs_of)) - sum(b - a for a, b in kept) - sum(r.gap for r in got.get(route, []) if r.bridge)) <= snapped + 0.5 * len(own) + 1e-6
    assert kinds == {"end", "leaves", "joins"}


def test_grade_over_ten_metres_needs_no_join(spark):
    """Against interpolation by hand, heights missing and the first sample past 0 too; a line's windows are all it takes."""
    r = np.random.default_rng(3)
    rows, want = [], {}
    for line in range(3):
        d = np.cumsum(r.integers(1, 4, 40)) * 1.25 - (line < 2) * 1.25
        z = r.normal(size=40) * 3
        known = r.random(40) > 0.2
        rows += [(line, i, float(d[i]), float(z[i]) if known[i] else None) for i in range(40)]
        at, moved = d[known], np.concatenate([[0], np.cumsum(np.abs(np.diff(z[known])))])
        low, high = np.maximum(at - 5, 0), np.minimum(at + 5, at[-1])
        want |= {(line, int(i)): g for i, g in zip(np.arange(40)[known], 100 * (np.interp(high, at, moved) - np.interp(low, at, moved)) / np.maximum(high - low, 1e-6), strict=True)}
    got = R.grade_10m(spark.createDataFrame(rows, "line_id int, i int, d double, zd double"))
    assert {(x.line_id, x.i): x.grade for x in got.collect()} == pytest.approx(want)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_ways_pass_no_join_side_through_the_driver(spark, monkeypatch):
    """Sides of the joins grow with the input; a way far longer than the straight run is found although it waits for nearer ones."""
    line = lambda k, *at: [(k, q, float(x), float(y)) for q, (x, y) in enumerate(at)]
    v = spark.createDataFrame([*line(1, (0, 0), (0, 900)), *line(2, (-10, 850), (60, 850)), *line(3, (50, 0), (50, 900)), *line(4, (-10, 20), (20, 20)), *line(5, (10, 40), (70, 40))], "line_id int, seq int, x double, y double")
    pairs = spark.createDataFrame([(1, 1.0, 5.0, 49.0, 5.0), (2, 1.0, 100.0, 1.0, 300.0), (3, 1.0, 5.0, 18.0, 20.0)], "pair_id int, x double, y double, x2 double, y2 double")
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return settled(df)

    monkeypatch.setattr(routing, "settled", seen)
    made = routing.follow_network(v, N.trail_network_edges(v), pairs, reach=2.5)
    got = {r.pair_id: (round(r.length, 6), [leg.line_id for leg in r.legs]) for r in made.collect()}
    assert got == {1: (1740.0, [1, 1, 2, 3, 3]), 2: (200.0, [1]), 3: (33.0, [1, 4])}
    plans.append(made._jdf.queryExecution().sparkPlan().toString())
    assert not [p for p in plans if "Broadcast" in p]
