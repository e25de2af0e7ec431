"""Measures and choices over scored lines."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lines import interp_at, segments


def nearest_sample(samples: DataFrame, at: DataFrame) -> DataFrame:
    """(line_id, q, i, d): the sample nearest each asked distance, the later one on a tie."""
    here = samples.select("line_id", F.col("d").alias("pos"), F.struct("d", "i").alias("s"), F.lit(None).cast("double").alias("q"))
    asked = at.select("line_id", F.col("q").alias("pos"), F.lit(None).cast(here.schema["s"].dataType).alias("s"), "q")
    line, gap = Window.partitionBy("line_id"), F.col("s").isNull()
    a, b = (F.last("s", True).over(line.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) for order in (["pos", gap], [F.desc("pos"), gap.desc()]))
    both = here.union(asked).withColumns({"a": a, "b": b}).filter("q is not null")
    before = F.col("b").isNull() | (F.col("q") - F.col("a.d") < F.col("b.d") - F.col("q"))
    return both.withColumn("s", F.when(before, F.col("a")).otherwise(F.col("b"))).select("line_id", "q", "s.i", "s.d")


def trail_shares(pieces: DataFrame) -> DataFrame:
    """(path, trail, metres, place): metres of each path on each trail, longest first."""
    total = pieces.groupBy("path", "trail").agg(F.sum("metres").alias("metres"))
    return total.withColumn("place", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("metres"), "trail")))


def offer_rule(costs: DataFrame, grades: DataFrame, given: int, unit: float = 1.0, everything: bool = False) -> DataFrame:
    """(search, candidate, offered, worst): which candidates to offer beside the input, candidate ``given``.

    ``costs`` has search, candidate, factor and extra effort; ``grades`` the steepest
    grade. A candidate has to be cheaper than the input; and, unless ``everything``, at most
    one point steeper, with no factor worse by over a tenth of the larger of its
    input's effort and ``unit``. ``worst`` names the factor that is worse by most.
    """
    own = costs.filter(F.col("candidate") == given).select("search", "factor", F.col("cost").alias("was"))
    c = costs.filter(F.col("candidate") != given).join(own, ["search", "factor"], "left").withColumn("was", F.coalesce("was", F.lit(0.0)))
    over = F.col("cost") - F.col("was") - 0.1 * F.greatest("was", F.lit(unit))
    c = c.withColumn("over", over).groupBy("search", "candidate").agg(F.sum("cost").alias("total"), F.max(F.struct("over", "factor")).alias("w"))
    whole = own.groupBy("search").agg(F.sum("was").alias("was"))
    g0 = grades.filter(F.col("candidate") == given).select("search", F.col("grade").alias("grade0"))
    j = c.join(whole, "search").join(grades, ["search", "candidate"]).join(g0, "search")
    fair = F.lit(everything) | ((F.col("grade") <= F.col("grade0") + 1) & (F.col("w.over") <= 0))
    return j.select("search", "candidate", ((F.col("total") < F.col("was")) & fair).alias("offered"), F.when(F.col("w.over") > 0, F.col("w.factor")).alias("worst"))


def line_stats(samples: DataFrame, limit: float) -> DataFrame:
    """Per line: grades, depth of cut, offsets, and metres along the edge (offset from ``limit`` - 1), on the fall line and in the wet.

    ``samples`` has line_id, i, w, z, grade, cut, offset, tsa and twi.
    """
    metres = lambda test: F.coalesce(F.sum(F.when(test, F.col("w"))), F.lit(0.0))
    change = F.col("z") - F.last("z", True).over(Window.partitionBy("line_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    s = samples.withColumns({"g": F.abs("grade"), "o": F.abs("offset"), "change": change})
    net = F.max_by("z", F.when(F.col("z").isNotNull(), F.col("i"))) - F.min_by("z", F.when(F.col("z").isNotNull(), F.col("i")))
    down, up = (F.coalesce(F.sum(F.when(t, F.abs("change"))), F.lit(0.0)) for t in (F.col("change") < 0, F.col("change") > 0))
    out = s.groupBy("line_id").agg(
        F.max("g").alias("grade_max"), F.percentile("g", 0.95).alias("grade_p95"), F.max("cut").alias("cut_max"), F.avg("cut").alias("cut_mean"),
        F.max("o").alias("offset_max"), F.avg("o").alias("offset_mean"), metres(F.col("o") >= limit - 1).alias("edge_m"),
        metres(F.col("tsa") < 45).alias("fall_line_m"), metres(F.col("twi") >= 10).alias("wet_m"), net.alias("net_climb"), F.least(down, up).alias("lost"),
    )
    return out


def _turned(a: Column, b: Column) -> Column:
    return F.pmod(b - a + math.pi, F.lit(2 * math.pi)) - math.pi


def turning(vertices: DataFrame, window: float = 1.0) -> DataFrame:
    """(line_id, seg, s, turn, radius) at the vertices that start a segment: the unsigned turn there, and the bend radius over ``window`` metres, at most 10,000."""
    w = Window.partitionBy("line_id").orderBy("seg")
    seg = segments(vertices, ["line_id"]).withColumn("heading", F.atan2(F.col("y2") - F.col("y"), F.col("x2") - F.col("x")))
    seg = seg.withColumn("turn", F.coalesce(F.abs(_turned(F.lag("heading").over(w), F.col("heading"))), F.lit(0.0)))
    seg = seg.withColumn("done", F.sum("turn").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = seg.groupBy("line_id").agg(F.max(F.col("c0") + F.col("length")).alias("end"), F.max("done").alias("done"))
    profile = seg.select("line_id", (F.col("c0") + F.col("length") / 2).alias("d"), "done").union(ends.select("line_id", "end", "done")).union(ends.select("line_id", F.lit(0.0), F.lit(0.0)))
    for n, q in (("hi", F.col("c0") + window / 2), ("lo", F.col("c0") - window / 2)):
        got = interp_at(profile, seg.select("line_id", q.alias("q")), "done").select("line_id", F.col("q").alias(n), F.col("done").alias(f"{n}_turn"))
        seg = seg.withColumn(n, q).join(got, ["line_id", n])
    seg = seg.join(ends.select("line_id", "end"), "line_id")
    span, turned = F.least("hi", "end") - F.greatest("lo", F.lit(0.0)), F.col("hi_turn") - F.col("lo_turn")
    return seg.select("line_id", "seg", F.col("c0").alias("s"), "turn", F.when(turned > 1e-9, F.least(span / turned, F.lit(1e4))).otherwise(1e4).alias("radius"))


def side_runs(samples: DataFrame, least: float = 4.0) -> DataFrame:
    """(line_id, first_i, last_i, side, metres): unbroken runs of one side that stand for ``least`` metres or more; side 0 or null breaks a run."""
    w = Window.partitionBy("line_id").orderBy("i")
    new = (~F.col("side").eqNullSafe(F.lag("side").over(w))).cast("int")
    runs = samples.withColumn("new", new).withColumn("run", F.sum("new").over(w)).filter("side <> 0")
    return runs.groupBy("line_id", "run", "side").agg(F.min("i").alias("first_i"), F.max("i").alias("last_i"), F.sum("w").alias("metres")).filter(F.col("metres") >= least).drop("run")


def factor_costs(samples: DataFrame, values: dict[str, Column], weights: dict[str, float]) -> DataFrame:
    """(line_id, factor, cost, contribution): each factor's curve values times slope length ``sl``, summed; weights are per 100 of cost."""
    wide = samples.groupBy("line_id").agg(*[F.sum(F.coalesce(v, F.lit(0.0)) * F.col("sl")).alias(n) for n, v in values.items()])
    long = wide.unpivot("line_id", list(values), "factor", "cost")
    k = F.create_map(*[F.lit(x) for n in values for x in (n, float(weights.get(n, 0.0)))])
    return long.withColumn("contribution", k[F.col("factor")] * F.col("cost"))


def line_refusals(samples: DataFrame, limit: float, longest: float = 20_000.0) -> DataFrame:
    """(line_id, off_terrain, outside, short_steps, too_long): why a line can't be scored."""
    any_ = lambda t: F.coalesce(F.max(t), F.lit(False))
    return samples.groupBy("line_id").agg(any_(F.col("z").isNull()).alias("off_terrain"), any_(F.abs("offset") > limit).alias("outside"), any_((F.col("i") > 0) & (F.col("w") < 0.001)).alias("short_steps"), (F.max("d") > longest).alias("too_long"))


def legs_signature(vertices: DataFrame) -> DataFrame:
    """(line_id, signature): a digest of kinds and coordinates (seven places) in order, which changes if and only if a leg does."""
    place = lambda c: F.round(F.col(c) * 1e7).cast("long").cast("string")
    text = F.concat_ws(",", "kind", F.col("leg").cast("string"), place("lon"), place("lat"))
    ordered = F.array_sort(F.collect_list(F.struct("leg", "seq", text.alias("t"))))
    return vertices.groupBy("line_id").agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x["t"]), ";"), 256).alias("signature"))


def simplify(vertices: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """(line_id, seq, x, y): vertices that a line needs to stay within ``tolerance`` of its old self, both ends kept.

    A line is one group; ``gpx_quarantine`` bounds its points.
    """

    def thin(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", ignore_index=True)
        return pdf[_needed(pdf["x"].to_numpy(), pdf["y"].to_numpy(), tolerance)]

    return vertices.select("line_id", "seq", "x", "y").groupBy("line_id").applyInPandas(thin, vertices.select("line_id", "seq", "x", "y").schema)


def _needed(x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """Rounds of Douglas-Peucker over all open chords at once: each round keeps the farthest vertex of each chord that strays too far."""
    at = np.arange(len(x))
    needed = (at == 0) | (at == len(x) - 1)
    while True:
        chord = np.cumsum(needed) - 1
        ends = np.flatnonzero(needed)
        a, b = ends[chord], ends[np.minimum(chord + 1, len(ends) - 1)]
        ux, uy, vx, vy = x[b] - x[a], y[b] - y[a], x - x[a], y - y[a]
        length = np.hypot(ux, uy)
        away = np.where(length < 1e-12, np.hypot(vx, vy), np.abs(ux * vy - uy * vx) / np.maximum(length, 1e-12))
        away[needed] = 0
        order = np.lexsort((at, -away, chord))
        far = order[np.r_[True, np.diff(chord[order]) > 0]] if len(order) else order
        far = far[away[far] > tolerance]
        if not len(far):
            return needed
        needed[far] = True


def sort_within(df: DataFrame, section: str, metric: str, ties: str, descending: bool = True) -> DataFrame:
    """Adds place, by metric inside each section; missing values last either way."""
    key = F.col(metric).desc_nulls_last() if descending else F.col(metric).asc_nulls_last()
    return df.withColumn("place", F.row_number().over(Window.partitionBy(section).orderBy(key, ties)))


def preferred_points(track: DataFrame, route: DataFrame, by: str) -> DataFrame:
    """All track points, and route points of the files that have none."""
    return track.unionByName(route.join(track.select(by).distinct(), by, "left_anti"))
