"""Packed tiles against plain arithmetic over cells: borders, holes, hot tiles, probes, ranked sources."""

import math
import random

import pytest
from pyspark.sql import functions as F

from waymark.operators import packed, terrain


def plain(cells, x, y):
    c, r = math.floor(x), math.floor(y)
    z = [cells.get((r + i, c + j)) for i in (0, 1) for j in (0, 1)]
    if None in z:
        return None
    fu, fv = x - c, y - r
    return (1 - fv) * ((1 - fu) * z[0] + fu * z[1]) + fv * ((1 - fu) * z[2] + fu * z[3])


@pytest.fixture(scope="module")
def ground():
    rng = random.Random(8)
    return {(r, c): rng.uniform(0, 900) for r in range(-20, 21) for c in range(-20, 21) if rng.random() > 0.03}


def test_tiles_of_any_size_read_alike(spark, ground, monkeypatch):
    monkeypatch.setattr(packed, "PORTION", 40)
    rng = random.Random(3)
    cells = spark.createDataFrame([(r, c, z) for (r, c), z in ground.items()] + [(0, 500, None)], "r int, c int, z double")
    points = [(k, rng.uniform(-22, 22), rng.uniform(-22, 22)) for k in range(300)] + [(400 + k, 1.25, 2.5) for k in range(150)] + [(900, 7.0, 7.0), (901, None, 1.0), (902, float("nan"), 1.0), (903, float("inf"), 0.0), (904, 1e7, 1e7)]
    frame = spark.createDataFrame(points, "point_id int, u double, v double").withColumns(packed.probes([(0, 0), (0.5, -0.75), (-1, 1)]))
    for side in (8, 64):
        got = {r.point_id: r.z for r in packed.read_tiles(frame, packed.pack_tiles(cells, [], side, 2), [], side, 2).collect()}
        assert len(got) == len(points)
        for k, x, y in points:
            real = x is not None and math.isfinite(x)
            want = [plain(ground, x + dx, y + dy) if real else None for dx, dy in ((0, 0), (0.5, -0.75), (-1, 1))]
            assert got[k] == pytest.approx(want) if None not in want else [z is None for z in got[k]] == [z is None for z in want]
    with pytest.raises(Exception, match="another shape"):
        packed.read_tiles(frame, packed.pack_tiles(cells, [], 8, 2), [], 64, 2).collect()


def test_a_later_source_sees_open_points_only(spark, ground):
    """Three sources of growing extent; every point's answer comes from the first that covers it and all its probes."""
    parts = {"fine": 6, "middle": 13, "coarse": 25}
    cells = spark.createDataFrame([(s, r, c, z + k) for k, (s, n) in enumerate(parts.items()) for (r, c), z in ground.items() if abs(r) <= n and abs(c) <= n], "source string, r int, c int, z double")
    rng = random.Random(5)
    lists = [["fine", "middle", "coarse"], ["coarse", "fine"], ["fine"], [], None, ["none", "middle"]]
    points = [(k, rng.uniform(-19, 19), rng.uniform(-19, 19), lists[k % 6]) for k in range(240)]
    frame = spark.createDataFrame(points, "point_id int, x double, y double, sources array<string>")
    held = {s: {(r, c): z + k for (r, c), z in ground.items() if abs(r) <= n and abs(c) <= n} for k, (s, n) in enumerate(parts.items())}
    first = {r.point_id: (r.z, r.source) for r in terrain.sample_first(frame, cells, 8).collect()}
    stack = {r.point_id: (r.z, r.gx, r.gy, r.source) for r in terrain.sample_stack(frame, cells, 1.0, 8).collect()}
    for k, x, y, sources in points:
        want = next(((plain(held.get(s, {}), x, y), s) for s in sources or [] if plain(held.get(s, {}), x, y) is not None), (None, None))
        assert first[k] == (pytest.approx(want[0]) if want[0] is not None else None, want[1])
        ways = [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)]
        whole = next(((s, z) for s in sources or [] if None not in (z := [plain(held.get(s, {}), x + i, y + j) for i, j in ways])), None)
        assert stack[k] == ((None,) * 4 if whole is None else (pytest.approx(whole[1][0]), pytest.approx((whole[1][1] - whole[1][2]) / 2), pytest.approx((whole[1][3] - whole[1][4]) / 2), whole[0]))


def test_views_meet_cells_in_blocks(spark):
    cells = spark.range(40 * 40).select((F.col("id") / 40).cast("int").alias("r"), (F.col("id") % 40).cast("int").alias("c"), F.col("id").alias("z"))
    views = spark.createDataFrame([(1, 0, 0, 39, 39), (2, 5, 7, 5, 7), (3, 9, 9, 3, 12), (4, 38, 38, 60, 60), (5, -9, -9, 0, 1)], "view_id int, c0 int, r0 int, c1 int, r1 int")
    for block in (4, 64):
        assert {r.view_id: r.n for r in terrain.in_views(cells, views, block).groupBy("view_id").agg(F.count("*").alias("n")).collect()} == {1: 1600, 2: 1, 4: 4, 5: 2}
