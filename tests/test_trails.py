import math

import numpy as np
from pyspark.sql import functions as F

from waymark.functions import scalars as S
from waymark.operators import catalogue as C
from waymark.operators import evaluate as V
from waymark.operators import lines as L
from waymark.operators import network
from waymark.plans import QUERIES
from waymark.plans.adapters import SAMPLES, adapted, table
from waymark.sources import gpx


def plane(spark, dx, dy, n=101):
    """A straight line over z = 0.3 y, a sample a metre."""
    h = math.atan2(dy, dx)
    rows = [(1, 0, i, float(min(i, 1)), float(i), 0.3 * dy * i, 0.0, 0.3, h) for i in range(n)]
    return spark.createDataFrame(rows, "line_id int, leg int, i int, w double, d double, z double, gx double, gy double, heading double")


def test_plane_grades_and_angles(spark):
    for dx, dy, grade, angle in ((0, 1, 30, 0), (1, 0, 0, 90), (math.sin(math.pi / 3), 0.5, 15, 60)):
        r = V.measured(plane(spark, dx, dy)).agg(F.expr("percentile(grade_s, 0.5)").alias("g"), F.expr("percentile(tsa_s, 0.5)").alias("t")).first()
        assert abs(r.g - grade) < 1e-6 and abs(r.t - angle) < 1e-4


def test_bridged_gap_and_symmetric_mean(spark):
    s = spark.createDataFrame([(1, i, float(i), z) for i, z in enumerate([0.0, None, None, 3.0])], "line_id int, i int, d double, z double")
    assert s.select("i", V.grade_bridged().alias("g")).orderBy("i").collect()[3].g == 100
    m = spark.createDataFrame([(1, i, v) for i, v in enumerate([10.0, None, 20.0, None, None])], "line_id int, i int, v double")
    assert [r.m for r in m.select("i", V.running_mean_sym("v", 3).alias("m")).orderBy("i").collect()][:3] == [10.0, 15.0, 20.0]


def test_smoothing_keeps_no_lists(spark):
    """Neighbours are read as columns: the same means as one at a time, and no list for every sample."""
    s = spark.range(40).selectExpr("1 as line_id", "cast(id as int) as i", "1e0 * id as d", "1e0 as w", "case when id % 5 = 3 then null else pow(id % 7, 2) end as z", "0.1e0 * (id % 3) as gx", "0.2e0 as gy", "0.3e0 * id as heading", "1 as src")
    m = V.measured(s)
    assert "collect_list" not in m._jdf.queryExecution().executedPlan().toString()
    z = [None if i % 5 == 3 else float(i % 7) ** 2 for i in range(40)]
    for r in m.select("i", "zs").collect():
        half = min(r.i, 39 - r.i, 4)
        near = [v for v in z[r.i - half : r.i + half + 1] if v is not None]
        assert r.zs == (sum(near) / len(near) if near else None)


def test_angle_at_the_bound_to_its_last_digit(spark):
    """Angles of the tables' own headings and slopes are those of the C library, which decides means that are 45 but for the last digit."""
    rows = [(math.radians(k % 360), (k % 11 / 100 - 0.05) * 8, (k % 9 / 100 - 0.04) * 8) for k in range(3000)]
    got = spark.createDataFrame(rows, "heading double, gx double, gy double").select("heading", "gx", "gy", S.tsa_near(F.col("heading"), F.col("gx"), F.col("gy")).alias("t")).collect()
    want = lambda h, x, y: math.degrees(math.acos(min(abs(math.cos(h - math.atan2(y, x))), 1.0))) if math.hypot(x, y) * 100 >= 3 else None
    assert len(got) == 3000 and all(r.t == want(r.heading, r.gx, r.gy) for r in got)
    odd = spark.createDataFrame([(None, 1.0, 1.0), (float("inf"), 1.0, 1.0)], "heading double, gx double, gy double").select(S.tsa_near(F.col("heading"), F.col("gx"), F.col("gy")).alias("t"), S.tsa_deg(F.col("heading"), F.col("gx"), F.col("gy")).alias("u")).collect()
    assert all(r.t == r.u for r in odd)


def test_runs_and_bands(spark):
    s = spark.createDataFrame([(1, i, float(min(i, 1)), float(v)) for i, v in enumerate([1, 20, 1, 20, 20])], "line_id int, i int, w double, v double")
    assert V.longest_run(s, ["line_id"], F.col("v") >= 18).first().longest == 2
    bands = {r.band: r for r in V.band_table(s, ["line_id"], "v", [5.0, 18.0]).collect()}
    assert bands[2].longest == 2 and bands[1].length == 0 and bands[0].pct == 25


def test_utm_round_trip_and_zone(spark):
    p = spark.createDataFrame([(-151.19, 59.62), (10.0, -33.5), (0.5, 0.0)], "lon double, lat double").withColumn("srid", S.utm_srid(F.col("lon"), F.col("lat")))
    x, y = S.to_utm(F.col("lon"), F.col("lat"), F.col("srid"))
    p = p.withColumns({"x": x, "y": y})
    lon, lat = S.from_utm(F.col("x"), F.col("y"), F.col("srid"))
    rows = p.select("srid", S.equirect_m(lon, lat, F.col("lon"), F.col("lat")).alias("off")).collect()
    assert [r.srid for r in rows] == [32605, 32732, 32631] and all(r.off < 0.01 for r in rows)


def test_units_and_curve(spark):
    r = spark.range(1).select(*[S.length_m(F.lit(t)).alias(f"u{i}") for i, t in enumerate(["5 ft", "2", "1 mi", "3 parsecs"])], *[S.curve_value(F.lit(float(v)), [(0, 0.1), (10, 10)]).alias(f"c{i}") for i, v in enumerate((-5, 5, 20))]).first()
    assert abs(r.u0 - 1.524) < 1e-9 and r.u1 == 2 and r.u2 == 1609.344 and r.u3 is None
    assert abs(r.c0 - 0.1) < 1e-12 and abs(r.c1 - 1) < 1e-12 and abs(r.c2 - 10) < 1e-12


def test_window_fit_query_gives_curvature(spark):
    folder = "/root/testdata/sf0.001"
    rows = QUERIES["a12_window_fit"](spark, folder).collect()
    samples = adapted(spark, folder, "samples").filter("z is not null and d between 1000 and 3000").collect()
    for r in rows:
        at = [(x.d, x.z) for x in samples if x.line_id == r.track_id]
        mean = sum(d for d, _ in at) / len(at)
        quad = np.polyfit([d - mean for d, _ in at], [z for _, z in at], 2)[0]
        assert abs(r.curvature - 2000 * quad) < 1e-3
    assert rows


def test_headline_has_all_fields_and_falls_back(spark):
    s = plane(spark, 0, 1).withColumn("src", F.when(F.col("i") <= 25, 1).otherwise(0))
    legs = spark.createDataFrame([(1, 0, "new", 1.0)], "line_id int, leg int, kind string, effort_factor double")
    r = V.headline_fields(s, legs).first()
    assert len(r) == 23 and (r.z_min, r.z_max, r.steep_threshold, r.very_steep_threshold, r.fall_line_threshold, r.heavy_slope_threshold) == (0, 30, 18, 35, 45, 73)
    assert abs(r.grade_p95 - 30) < 1e-6 and abs(r.steep_longest_m - 100) < 1e-6 and r.very_steep_pct == 0 and r.lidar_pct == 25 and r.coverage_pct == 100
    r = V.headline_fields(s, legs, [31.0], [], [10.0]).first()
    assert (r.steep_threshold, r.steep_pct, r.steep_longest_m) == (31, 0, 0) and r.very_steep_pct is r.fall_line_threshold is r.fall_line_pct is r.heavy_slope_pct is None
    assert V.headline_fields(s, legs, [], [], []).first().steep_longest_m is None


def test_resample_two_legs(spark):
    v = spark.createDataFrame([(1, 0, 0, 0.0, 0.0), (1, 0, 1, 10.5, 0.0), (1, 1, 0, 10.5, 0.0), (1, 1, 1, 10.5, 7.0)], "line_id int, leg int, seq int, x double, y double")
    rows = L.resample_legs(v, 2.0).orderBy("leg", "k").collect()
    first = [r for r in rows if r.leg == 0]
    assert len(first) == 7 and abs(first[-1].x - 10.5) < 1e-9 and len(rows) == 7 + 4


def test_hold_side_and_crossings(spark):
    s = spark.createDataFrame([(1, i, v) for i, v in enumerate([0.0, 0.3, 0.01, -0.01, 0.2, -0.3])], "line_id int, i int, v double")
    assert [r.s for r in s.select("i", L.hold_side("v", 0.1).alias("s")).orderBy("i").collect()] == [1, 1, 1, 1, 1, -1]
    loop = [(1, 0, 0.0, 0.0), (1, 1, 10.0, 10.0), (1, 2, 10.0, 0.0), (1, 3, 0.0, 10.0), (2, 0, 0.0, 0.0), (2, 1, 5.0, 1.0), (2, 2, 10.0, 0.0)]
    assert [(r.line_id, r.a, r.b) for r in L.self_crossings(spark.createDataFrame(loop, "line_id int, seq int, x double, y double")).collect()] == [(1, 0, 2)]


def test_nearest_place_at_any_distance(spark):
    lines = [(k, i, 40.0 * k + 9 * math.cos(i * k), 7.0 * i + 5 * math.sin(i)) for k in range(1, 8) for i in range(30)] + [(9, 0, -900.0, 0.0), (9, 1, 900.0, -400.0)]
    points = [(i, (i * 37 % 101 - 50) * 10.0 ** (i % 5), (i * 53 % 97 - 48) * 10.0 ** (i % 4)) for i in range(120)] + [(998, None, 0.0), (999, math.nan, 0.0)]
    legs = [(a, p) for a, p in zip(lines, lines[1:]) if a[0] == p[0]]

    def away(px, py, line=None):
        found = []
        for (k, i, ax, ay), (_, _, bx, by) in legs:
            dx, dy = bx - ax, by - ay
            t = min(max(((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy), 0), 1)
            if line in (None, k):
                found.append((math.hypot(px - ax - t * dx, py - ay - t * dy), k, i))
        return min(found)

    v = spark.createDataFrame(lines, "line_id int, seq int, x double, y double")
    p = spark.createDataFrame(points, "point_id int, x double, y double")
    for same in (False, True):
        got = {r.point_id: r for r in L.nearest_on_lines(p.withColumn("line_id", F.lit(9)) if same else p, v, same_line=same).collect()}
        assert len(got) == 122 and got[998].distance is None and got[999].distance is None
        for i, x, y in points[:120]:
            assert abs(got[i].distance - away(x, y, 9 if same else None)[0]) < 1e-6 * (1 + got[i].distance)
    assert L.nearest_on_lines(p, v.limit(0)).filter("distance is null").count() == 122
    tie = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 1.0, 0.0), (2, 0, 0.0, 0.0), (2, 1, 0.0, 1.0)], "line_id int, seq int, x double, y double")
    assert L.nearest_on_lines(spark.createDataFrame([(1, -500.0, -500.0)], p.schema), tie).first().line_id == 1


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", True), (2, "b", False)], "k int, v string, enabled boolean")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    once = C.upsert(old, new, "k", ["v"], ["enabled"], delete=F.lit(True))
    assert {(r.k, r.v, r.action) for r in once.collect()} == {(1, "a", "deleted"), (2, "c", "updated"), (3, "d", "created")}
    again = C.upsert(once.filter("action <> 'deleted'"), new, "k", ["v"], ["enabled"], delete=F.lit(True))
    assert {(r.k, r.v, r.action) for r in again.collect()} == {(2, "c", "updated"), (3, "d", "updated")}


def test_slugs_and_sections(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "k int, slug string")
    taken = spark.createDataFrame([("a",), ("a-3",)], "slug string")
    assert [r.slug for r in C.unique_slugs(rows, "slug", ["k"], taken).orderBy("k").collect()] == ["a-2", "a-4", "b"]
    s = spark.createDataFrame([(1, "x", 0), (1, "y", 1), (1, "z", 2)], "p int, n string, section_order int")
    moved = C.move_section(s, ["p"], F.col("n") == "y", 1)
    assert [r.n for r in moved.orderBy("section_order").collect()] == ["x", "z", "y"]
    assert [r.n for r in C.move_section(s, ["p"], F.col("n") == "z", 1).orderBy("section_order").collect()] == ["x", "y", "z"]


GOOD = """<?xml version="1.0"?><gpx xmlns="http://www.topografix.com/GPX/1/1" creator="hand-made sample"><trk><name>T</name><trkseg>
<trkpt lat="47.10" lon="8.20"><ele>61</ele><time>2023-03-05T08:15:00Z</time></trkpt><trkpt lat="47.11" lon="8.21"><ele>83.2</ele></trkpt>
<trkpt lat="bad" lon="1"/></trkseg></trk></gpx>"""
ROUTE = '<gpx><rte><name>R</name><rtept lat="1" lon="2"/><rtept lat="1.1" lon="2"/></rte></gpx>'


def test_gpx_in_and_out(spark):
    files = spark.createDataFrame([("good", GOOD), ("route", ROUTE), ("bad", "no xml"), ("one", '<gpx><rte><rtept lat="1" lon="2"/></rte></gpx>')], "file string, value string")
    points, rejected = gpx.split_gpx(gpx.parse_gpx(files))
    rows = points.orderBy("track_id", "seq").collect()
    assert [(r.track_id, r.seq) for r in rows] == [("good", 1), ("good", 2), ("route", 1), ("route", 2)]
    assert rows[1].ele == 83.2 and rows[0].device == "hand-made sample" and rows[0].ts is not None
    assert {(r.file, r.reason) for r in rejected.collect()} == {("bad", "not GPX"), ("one", "too few points")}
    text = {r.track_id: r.value for r in gpx.gpx_text(points).collect()}
    again = gpx.split_gpx(gpx.parse_gpx(gpx.gpx_text(points).toDF("file", "value")))[0]
    assert "<name>T</name>" in text["good"] and again.count() == 4


def test_nearest_place_within_a_limit(spark):
    """Against brute force; a point moves once, in the cell it lies in."""
    r = np.random.default_rng(7)
    at = np.cumsum(r.uniform(-9, 9, (3, 40, 2)), axis=1)
    lines = spark.createDataFrame([(k, s, float(at[k, s, 0]), float(at[k, s, 1])) for k in range(3) for s in range(40)], "line_id int, seq int, x double, y double")
    spots = [(i, int(i % 3), *map(float, r.uniform(-40, 40, 2))) for i in range(200)] + [(900, 1, None, 0.0)]
    points = spark.createDataFrame(spots, "point_id int, line_id int, x double, y double")
    for own in (False, True):
        found = L.nearest_on_lines(points, lines, 4.0, same_line=own)
        got = {p.point_id: p for p in found.collect()}
        assert len(got) == 201 and got[900].distance is None
        for i, k, x, y in spots[:-1]:
            best = math.inf
            for j in (k,) if own else range(3):
                a, d = at[j, :-1], np.diff(at[j], axis=0)
                t = np.clip(((np.array([x, y]) - a) * d).sum(1) / (d * d).sum(1), 0, 1)
                best = min(best, np.hypot(*(np.array([x, y]) - a - t[:, None] * d).T).min())
            assert (got[i].distance is None and best > 4) or math.isclose(got[i].distance, best, abs_tol=1e-9)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1  # only the lines are dealt to several cells


def test_a_long_segment_carries_no_list_of_its_cells(spark):
    """A trail of 2,000 km touches 40,000 cells; crossings in many cells are told once."""
    lines = spark.createDataFrame([(1, 0, -1e6, 0.0), (1, 1, 1e6, 1.0), (2, 0, 5.0, -9.0), (2, 1, 6.0, 9.0), (3, 0, -2000.0, -1.5), (3, 1, 2000.0, 2.5)], "line_id int, seq int, x double, y double")
    assert sorted(r.line_id for r in network.crossings(lines).collect()) == [1, 1, 2, 2, 3, 3]
    one = spark.createDataFrame([(1, 0, -900.0, 0.0), (1, 1, 900.0, 1.0), (1, 2, 900.0, 30.0), (1, 3, -900.0, -20.0)], "line_id int, seq int, x double, y double")
    assert [tuple(r) for r in L.self_crossings(one).collect()] == [(1, 0, 2)]


def test_many_equal_lines_are_met_by_blocks_of_points(spark):
    """Fifty copies of a line, points among and far from them: a point comes out once for a block, not once for every segment near it."""
    line = [(k, i, 3.0 * i, 4.0 * (i % 2)) for k in range(50) for i in range(40)]
    v = spark.createDataFrame(line, "line_id int, seq int, x double, y double")
    p = spark.createDataFrame([(i, 7.0 * (i % 20), 900.0 * (i // 20)) for i in range(400)], "point_id int, x double, y double")
    assert L._near_at_any_distance(p, v, []).count() == 400
    got = {r.point_id: r for r in L.nearest_on_lines(p, v).collect()}
    assert all(r.line_id == 0 for r in got.values()) and len(got) == 400
    assert got[0].distance == 0 and abs(got[201].distance - 8996) < 0.1


def test_faults_of_legs_are_told_without_a_map_of_alignments(spark):
    a, b, far = (-151.0, 59.0), (-151.1, 59.1), (-151.1, 59.2)
    rows = [(1, 0, "new", 1.0, [a, b]), (1, 1, "reroute", 2.0, [b, a]), (2, 1, "odd", 101.0, [far, a]), (2, 0, "new", 1.0, [a, b]), (3, 0, "new", None, [(200.0, 1.0)]), (3, 1, None, 1.0, [a, b]), (4, 0, "new", 1.0, None)]
    rows += [(5, k, "new", 1.0, [a, a]) for k in range(501)] + [(6, 0, "new", 1.0, [a] * 50_001)]
    legs = spark.createDataFrame(rows, "alignment_id int, leg int, kind string, effort_factor double, coords array<struct<lon:double,lat:double>>")
    made = C.validate_legs(legs)
    assert {r.alignment_id: r.errors for r in made.collect()} == {1: [], 2: ["bad effort factor", "legs do not meet", "unknown kind"], 3: ["legs do not meet", "out of range", "too few points"], 4: [], 5: ["too many legs"], 6: ["too many points"]}
    assert "Aggregate" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_samples_are_the_sql_rows_dealt_once(spark):
    folder = "/root/testdata/sf0.001"
    made, told = adapted(spark, folder, "samples"), spark.sql(SAMPLES.replace("from lineitem", "from {l}"), l=table(spark, folder, "lineitem"))
    assert made.dtypes == told.dtypes and made.exceptAll(told).isEmpty() and told.exceptAll(made).isEmpty()
    assert made._jdf.queryExecution().sparkPlan().toString().count("Scan") == 1 and _exchanges(made) == 1


def _exchanges(frame):
    spark, key = frame.sparkSession, "spark.sql.adaptive.enabled"
    was = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        return frame.select("*")._jdf.queryExecution().executedPlan().toString().count(" Exchange hashpartitioning")
    finally:
        spark.conf.set(key, was)


def test_headline_measures_samples_once(spark):
    """The table is read for the samples and for the legs, and moves twice as samples; the longest run is that of all samples in order."""
    made = QUERIES["p09_headline"](spark, "/root/testdata/sf0.001")
    assert made._jdf.queryExecution().sparkPlan().toString().count("FileScan") == 2 and _exchanges(made) <= 6
    s = adapted(spark, "/root/testdata/sf0.001", "samples")
    longest = {r.line_id: r.longest for r in V.longest_run(V.measured(s), ["line_id"], F.col("grade_s") >= 18).collect()}
    assert {r.line_id: r.steep_longest_m for r in made.collect()} == longest
