import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.functions import settings
from waymark.operators import profiles, terrain


def _line(spark, points, key=1):
    return spark.createDataFrame([(key, i, float(x), float(y)) for i, (x, y) in enumerate(points)], "line_id int, seq int, x double, y double")


def test_taut_string_is_the_shortest_line_in_its_bounds():
    r = np.random.default_rng(2)
    for n in (1, 2, 3, 5, 40, 200):
        d = np.cumsum(r.uniform(0.5, 2, n))
        mid = np.cumsum(r.normal(size=n))
        low, high = mid - r.uniform(0.1, 2, n), mid + r.uniform(0.1, 2, n)
        z = profiles.taut_string(d, low, high)
        assert z[0] == pytest.approx((low[0] + high[0]) / 2) and z[-1] == pytest.approx((low[-1] + high[-1]) / 2)
        inner = slice(1, n - 1)
        assert (z[inner] >= low[inner] - 1e-9).all() and (z[inner] <= high[inner] + 1e-9).all()
        # it bends up only on a lower bound and down only on an upper one, which no other line in the bounds does
        if n > 2:
            bend = np.diff(np.diff(z) / np.diff(d))
            assert np.allclose(z[1:-1][bend > 1e-7], high[1:-1][bend > 1e-7])
            assert np.allclose(z[1:-1][bend < -1e-7], low[1:-1][bend < -1e-7])


def test_height_lost_reads_through_the_band(spark):
    z = [0, 5, 4.8, 9, 6, 6, 6.2, 3, 12, 11.5, 12]
    rows = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(z)] + [(2, i, -float(v)) for i, v in enumerate(z)] + [(3, 0, 1.0), (4, 0, None)], "line_id int, i int, z double")
    got = sorted(map(tuple, profiles.height_lost(rows, 0.6).collect()))
    assert got == [(1, 3, 7, 6.0), (2, 3, 7, 6.0)]
    assert len(profiles.height_lost(rows.filter("line_id = 1"), 0.1).collect()) == 4


def test_height_lost_counts_an_open_fall(spark):
    rows = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([0, 9, 4])], "line_id int, i int, z double")
    assert [tuple(r) for r in profiles.height_lost(rows, 1.0).collect()] == [(1, 1, 2, 5.0)]


def test_split_at_joints_goes_forward(spark):
    line = _line(spark, [(x, 0) for x in range(10)])
    joints = spark.createDataFrame([(1, 0, 6.1, 0.0), (1, 1, 2.0, 0.0), (1, 2, 50.0, 0.0), (1, 3, 9.0, 0.0)], "line_id int, joint int, x double, y double")
    got = profiles.split_at_joints(line, joints).groupBy("leg").agg(F.min("seq"), F.max("seq")).orderBy("leg").collect()
    # the second joint lies behind the first cut, so it takes the next vertex; then the last inner one; then none is left
    assert [tuple(r) for r in got] == [(0, 0, 6), (1, 6, 7), (2, 7, 8), (3, 8, 9)]
    whole = profiles.split_at_joints(line, joints.filter("false"))
    assert whole.select("leg").distinct().collect()[0][0] == 0 and whole.count() == 10


def test_adaptive_resample_is_dense_in_bends_only(spark):
    arc = [(20 + 4 * math.sin(a), 4 - 4 * math.cos(a)) for a in np.linspace(0, math.pi / 2, 40)]
    line = _line(spark, [(0, 0), *arc, (24, 40)])
    p = np.array([(r.x, r.y) for r in profiles.adaptive_resample(line, 3.0).orderBy("k").collect()])
    gap = np.hypot(*np.diff(p, axis=0).T)
    assert p[0] == pytest.approx([0, 0]) and p[-1] == pytest.approx([24, 40])
    assert gap.max() <= 3.001 and 0.3 < gap.min() < 1.0
    turn = np.abs(np.diff(np.unwrap(np.arctan2(*np.diff(p, axis=0).T[::-1]))))
    assert np.degrees(turn.max()) < 13


def test_lines_apart_and_same_samples(spark):
    a, b = _line(spark, [(0, 0), (10, 0), (20, 0)]), _line(spark, [(0, 0), (10, 4), (20, 0)])
    assert [tuple(r) for r in profiles.lines_apart(a, b).collect()] == [(1, pytest.approx(4.0), False)]
    assert [tuple(r) for r in profiles.lines_apart(a, b, 3.0).collect()] == [(1, None, True)]
    s, t = a.withColumnRenamed("seq", "i"), b.withColumnRenamed("seq", "i")
    assert profiles.same_samples(s, s).first().same and not profiles.same_samples(s, t).first().same and not profiles.same_samples(s, s.filter("i < 2")).first().same


def test_wet_overlay_refuses_large_views(spark):
    with pytest.raises(ValueError):
        terrain.wet_overlay(spark.range(1), "twi", (0, 0, 1000, 1000), 5.0)


def test_factor_csv_has_a_row_per_sample(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, 1.5), (1, 1, 2.5)], "line_id int, i int, x double")
    profiles.write_factor_csv(rows, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_settings_checks(spark):
    node = "array(named_struct('x', {}D, 'y', {}D), named_struct('x', {}D, 'y', {}D))"
    error = lambda *v: spark.range(1).select(settings.curve_error(F.expr(node.format(*v))).alias("e")).first().e
    assert error(0, 0, 1, 5) is None and error(1, 1, 0, 1) == "order" and error(0, 1e-5, 1, 1) == "value" and error(0, 2e4, 1, 1) == "value"
    assert spark.range(1).select(settings.curve_error(F.expr("array(named_struct('x', 1D, 'y', 1D))")).alias("e")).first().e == "nodes"
    got = spark.range(1).select(settings.mirrored_curve(F.expr(node.format(0, 1, 2, 5))).alias("c"), settings.upgraded_weight(F.lit(4.0), F.lit(None).cast("double"), F.lit(False)).alias("k"), settings.clean_parameter(F.lit(2.5), 0, 9, True).alias("p")).first()
    assert [tuple(p) for p in got.c] == [(-2, 5), (0, 1), (2, 5)] and got.k == pytest.approx(49.3827) and got.p == 2


def test_adaptive_resample_makes_no_fine_points_on_a_straight_run(spark):
    """A million metres without a turn: fine points stay near the vertices, and nothing is shuffled but the lines."""
    line = _line(spark, [(0, 0), (1e6, 0), (1e6, 10)])
    got = profiles.adaptive_resample(line, 1000.0)
    rows = got.orderBy("k").collect()
    assert (rows[0].x, rows[-1].x, rows[-1].y) == (0, 1e6, 10) and 1000 < len(rows) < 1100
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_reversal_sites_need_no_join(spark):
    """A dip in the design line and a hollow in the ground are found; heights around a sample are read in its line's windows."""
    zd = [9, 6, 3, 0, 3, 6, 9, 9, 9, 9, 9, 9]
    z = [5, 5, 5, 5, 5, 5, 5, 5, 5, 0, 5, 5]
    rows = spark.createDataFrame([(k, i, 2.0 * i, float(z[i]), float(zd[i])) for k in range(2) for i in range(12)], "line_id int, i int, d double, z double, zd double")
    got = profiles.reversal_sites(rows, 4.0, 4.0, 5.0)
    assert sorted(map(tuple, got.collect())) == [(k, d) for k in range(2) for d in (6.0, 18.0)]
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
