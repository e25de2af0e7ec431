import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.operators import scoring, terrain
from waymark.plans import QUERIES
from waymark.plans.catalogue_queries import _grid


def _line(spark, points, key=1):
    return spark.createDataFrame([(key, i, float(x), float(y)) for i, (x, y) in enumerate(points)], "line_id int, seq int, x double, y double")


def test_turning_reads_a_kink_and_a_straight(spark):
    rows = scoring.turning(_line(spark, [(0, 0), (10, 0), (10, 10), (10, 20)])).orderBy("seg").collect()
    assert [round(r.turn, 6) for r in rows] == [0.0, round(math.pi / 2, 6), 0.0]
    # the kink is spread over half of each segment: 0.1 of it within a metre
    assert rows[1].radius == pytest.approx(1 / (0.1 * math.pi / 2))
    assert rows[0].radius == 1e4


def _thinned(points, tolerance):
    """Recursive definition."""
    if len(points) < 3:
        return list(range(len(points)))
    (ax, ay), (bx, by) = points[0], points[-1]
    length = math.hypot(bx - ax, by - ay)
    off = [abs((bx - ax) * (y - ay) - (by - ay) * (x - ax)) / length if length > 1e-12 else math.hypot(x - ax, y - ay) for x, y in points[1:-1]]
    at = int(np.argmax(off)) + 1
    if off[at - 1] <= tolerance:
        return [0, len(points) - 1]
    return _thinned(points[: at + 1], tolerance) + [at + k for k in _thinned(points[at:], tolerance)[1:]]


def test_simplify_matches_the_recursive_definition(spark):
    r = np.random.default_rng(5)
    for n in (1, 2, 3, 60, 200):
        points = np.cumsum(r.normal(size=(n, 2)), axis=0).round(3)
        if n == 200:
            points[-1] = points[0]  # closed
        got = [x.seq for x in scoring.simplify(_line(spark, points), 0.8).orderBy("seq").collect()]
        assert got == _thinned([tuple(p) for p in points], 0.8)


def test_nearest_sample_takes_the_later_on_a_tie_and_holds_the_ends(spark):
    s = spark.createDataFrame([(1, 0, 0.0), (1, 1, 10.0), (1, 2, 30.0)], "line_id int, i int, d double")
    at = spark.createDataFrame([(1, -3.0), (1, 5.0), (1, 10.0), (1, 19.0), (1, 99.0)], "line_id int, q double")
    assert {r.q: r.i for r in scoring.nearest_sample(s, at).collect()} == {-3.0: 0, 5.0: 1, 10.0: 1, 19.0: 1, 99.0: 2}


def test_choose_dem_sources_orders_and_keeps_the_first_of_a_slug(spark):
    schema = "slug string, kind string, enabled boolean, gated boolean, cog_url string, tiles_url string, native_res double, year int, w double, s double, e double, n double"
    box = (0.0, 0.0, 5.0, 5.0)
    rows = [
        ("coarse", "lidar", True, False, "u", None, 2.0, 2020, *box), ("old", "lidar", True, False, "u", None, 1.0, 2001, *box), ("undated", "lidar", True, False, "u", None, 1.0, None, *box),
        ("unknown", "lidar", True, False, "u", None, None, 2020, *box), ("far", "lidar", True, False, "u", None, 1.0, 2020, 50.0, 50.0, 51.0, 51.0), ("off", "lidar", False, False, "u", None, 1.0, 2020, *box),
        ("ctx", "mapbox", True, False, None, "u", 10.0, None, *box),
    ]
    lines = spark.createDataFrame([(1, "coarse", 1.0, 1.0, 2.0, 2.0), (2, None, 90.0, 90.0, 91.0, 91.0)], "line_id int, own string, w double, s double, e double, n double")
    got = {r.line_id: r.sources for r in terrain.choose_dem_sources(lines, spark.createDataFrame(rows, schema), 5.0).collect()}
    assert got == {1: ["coarse", "undated", "old", "unknown", "ctx", "terrarium"], 2: ["ctx", "terrarium"]}
    none = terrain.choose_dem_sources(lines, spark.createDataFrame([("terrarium", "terrarium", False, *[None] * 9)], schema), 5.0)
    assert {r.line_id: r.sources for r in none.collect()} == {1: ["coarse"], 2: []}


def test_legs_signature_changes_with_a_leg_only(spark):
    schema = "line_id int, leg int, seq int, kind string, lon double, lat double"
    rows = [(1, 0, 0, "new", 1.0, 2.0), (1, 0, 1, "new", 1.5, 2.0)]
    sign = lambda r: scoring.legs_signature(spark.createDataFrame(r, schema)).first().signature
    assert sign(rows) == sign(rows[::-1]) == sign([rows[0], (1, 0, 1, "new", 1.5 + 1e-9, 2.0)])
    assert sign(rows) != sign([rows[0], (1, 0, 1, "new", 1.5 + 1e-6, 2.0)]) and sign(rows) != sign([rows[0], (1, 0, 1, "reroute", 1.5, 2.0)])


def test_many_views_over_a_grid(spark):
    cells = spark.createDataFrame([(r, c, None if (r, c) == (2, 2) else math.nan if (r, c) == (3, 3) else 10.0 * r + c) for r in range(8) for c in range(6)], "r int, c int, z double")
    views = spark.createDataFrame([(1, 0, 0, 2, 2), (2, 1, 2, 4, 6), (3, 90, 90, 95, 95), (4, 3, 5, 2, 1), (5, 0, 0, 5000, 5000)], "view_id int, c0 int, r0 int, c1 int, r1 int")
    got = {r.view_id: (r.p50, r.p90, r.p99) for r in terrain.view_percentiles(cells, "z", views).collect()}
    assert got[3] == got[4] == (None, None, None)
    for k, box in ((1, (0, 0, 2, 2)), (2, (1, 2, 4, 6)), (5, (0, 0, 5000, 5000))):
        assert got[k] == tuple(terrain.cropped_percentiles(cells, "z", box).first())
    paint, p, refused = terrain.wet_overlays(cells, "z", views, 1.0)
    assert [r.view_id for r in refused.collect()] == [5] and {r.view_id for r in p.collect()} == {1, 2, 3, 4}
    for k, box in ((1, (0, 0, 2, 2)), (2, (1, 2, 4, 6))):
        assert sorted(map(tuple, paint.filter(f"view_id = {k}").drop("view_id").collect())) == sorted(map(tuple, terrain.wet_overlay(cells, "z", box, 1.0)[0].collect()))


def test_views_and_cells_are_dealt_and_small_views_keep_to_a_frame(spark):
    """No side is broadcast, which would leave the work to a few tasks, and a small view's values are not sent on to the view. Row 0 has its cells twice."""
    cells = spark.range(30 * 20).select((F.col("id") / 20 - 10).cast("int").alias("r"), (F.col("id") % 20 - 5).cast("int").alias("c"), F.when(F.col("id") % 7 > 0, F.col("id") * 37 % 101).cast("double").alias("z"))
    boxes = {1: (-5, -10, -1, -6), 2: (-1, -1, 0, 0), 3: (2, 3, 5, 6), 4: (3, 3, 6, 6), 5: (-9, -9, 14, 9), 6: (5, 0, 8, 2), 7: (14, 19, 99, 99), 8: (4, 4, 3, 9), 9: (500, 0, 503, 3), 10: (None, 0, 1, 1), 11: (0, 0, 0, 0)}
    views = spark.createDataFrame([(k, *b) for k, b in boxes.items()], "view_id int, c0 int, r0 int, c1 int, r1 int")
    want = {k: tuple(terrain.cropped_percentiles(cells, "z", b).first()) if None not in b else (None,) * 3 for k, b in boxes.items()}
    for side in (4, 64):
        assert {r.view_id: (r.p50, r.p90, r.p99) for r in terrain.view_percentiles(cells, "z", views, side).collect()} == want
    plan = terrain.in_views(cells, views)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "BroadcastHashJoin" not in plan
    assert "FlatMapCoGroupsInArrow" in terrain.view_percentiles(cells, "z", views)._jdf.queryExecution().executedPlan().toString()


def test_whole_queries_reach_every_trail_view_and_row(spark):
    folder = "/root/testdata/sf0.001"
    trails = spark.read.parquet(f"{folder}/lineitem.parquet").select("l_partkey").distinct().count()
    assert QUERIES["j12_study_projects"](spark, folder).select("trail").distinct().count() == trails
    last = _grid(spark, folder).agg(F.max("r")).first()[0]
    painted = QUERIES["g08_wet_overlay"](spark, folder)
    assert painted.agg(F.max("r")).first()[0] == last and painted.select("view_id").distinct().count() > 100
    assert QUERIES["a22_twi_percentiles"](spark, folder).count() == spark.read.parquet(f"{folder}/customer.parquet").count()


def test_context_sources_are_put_in_order_once(spark):
    """A slug that is a line's own, a footprint's or the world's is told once, and the context isn't sorted line by line."""
    schema = "slug string, kind string, enabled boolean, gated boolean, cog_url string, tiles_url string, native_res double, year int, w double, s double, e double, n double"
    rows = [("m2", "mapbox", True, False, None, "u", None, None, *[None] * 4), ("m1", "mapbox", True, False, None, "u", None, None, *[None] * 4), ("m1", "lidar", True, False, "u", None, 1.0, 2020, 0.0, 0.0, 1.0, 1.0)]
    lines = spark.createDataFrame([(1, None, 0.5, 0.5, 0.6, 0.6), (2, "m2", 9.0, 9.0, 9.5, 9.5), (3, "terrarium", 9.0, 9.0, 9.5, 9.5)], "line_id int, own string, w double, s double, e double, n double")
    made = terrain.choose_dem_sources(lines, spark.createDataFrame(rows, schema), 5.0)
    got = {r.line_id: r.sources for r in made.collect()}
    assert got == {1: ["m1", "m2", "terrarium"], 2: ["m2", "m1", "terrarium"], 3: ["terrarium", "m1", "m2"]}
    assert "array_sort(concat" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_context_joins_lines_that_move_no_more(spark):
    """Every line lists the whole context, so no row that has it may be shuffled or sorted, whatever the size at which joins are broadcast."""
    schema = "slug string, kind string, enabled boolean, gated boolean, cog_url string, tiles_url string, native_res double, year int, w double, s double, e double, n double"
    rows = [("m1", "mapbox", True, False, None, "u", None, None, *[None] * 4), ("a", "lidar", True, False, "u", None, 1.0, 2020, 0.0, 0.0, 12.0, 12.0), ("b", "lidar", True, False, "u", None, 0.5, 2020, 4.0, 4.0, 5.0, 5.0), ("b", "lidar", True, False, "u", None, 0.5, 2020, 4.0, 4.0, 5.0, 5.0)]
    lines = spark.createDataFrame([(1, None, 3.0, 3.0, 11.0, 11.0), (2, "a", 3.0, 3.0, 11.0, 11.0), (3, "m1", None, None, None, None), (4, None, 5.0, 5.0, 5.0, 5.0)], "line_id int, own string, w double, s double, e double, n double")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = terrain.choose_dem_sources(lines, spark.createDataFrame(rows, schema), 5.0)
        assert {r.line_id: r.sources for r in made.collect()} == {1: ["b", "a", "m1", "terrarium"], 2: ["a", "b", "m1", "terrarium"], 3: ["m1", "terrarium"], 4: ["b", "a", "m1", "terrarium"]}
        plan = made._jdf.queryExecution().sparkPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "NestedLoop" in next(line for line in plan if "Join" in line)
