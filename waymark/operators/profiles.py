"""Candidate lines against the line they came from: shape, lost height, effort by sample, and taking a candidate over."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evaluate import running_mean_clip
from .lines import densify, nearest_on_lines, read_around, segments
from .rounds import settled
from .scoring import _turned, legs_signature

def _by_i():
    return Window.partitionBy("line_id").orderBy("i")


def curvature(samples: DataFrame, width: int = 5) -> DataFrame:
    """Adds kappa, radians a metre: the slope of the unwrapped heading over d, averaged over ``width`` samples."""
    s = samples.withColumn("theta", F.sum(F.coalesce(_turned(F.lag("heading").over(_by_i()), F.col("heading")), F.lit(0.0))).over(_by_i().rowsBetween(Window.unboundedPreceding, 0)))
    back, ahead = F.col("d") - F.lag("d").over(_by_i()), F.lead("d").over(_by_i()) - F.col("d")
    before, after = (F.col("theta") - F.lag("theta").over(_by_i())) / back, (F.lead("theta").over(_by_i()) - F.col("theta")) / ahead
    s = s.withColumn("raw", F.coalesce((before * ahead + after * back) / (back + ahead), before, after, F.lit(0.0)))
    return s.withColumn("kappa", running_mean_clip("raw", width)).drop("theta", "raw")


def adaptive_resample(vertices: DataFrame, h: float, turn_deg: float = 10.0, least: float = 0.3) -> DataFrame:
    """(line_id, k, x, y): points that turn by ``turn_deg`` at most, from ``least`` to ``h`` metres apart; both ends kept.

    The steps wished for add up along a fine copy of the line; where the sum passes a whole
    share of itself a point is made, so the line is measured once and cut as it is read. The
    bend radius at a point is that of the metre around it, with each turn spread over half the
    fine steps beside it; so fine points are made near vertices only, and a straight run
    between them is one step of the sum.
    """
    fine, reach = min(least, h) / 2, 0.5
    w = Window.partitionBy("line_id").orderBy("seg")
    seg = segments(vertices, ["line_id"]).withColumns({"n": F.greatest(F.ceil(F.col("length") / fine - 1e-9), F.lit(1)).cast("int"), "heading": F.atan2(F.col("y2") - F.col("y"), F.col("x2") - F.col("x"))})
    seg = seg.withColumns({"gap": F.col("length") / F.col("n"), "turn": F.abs(_turned(F.lag("heading").over(w), F.col("heading"))), "end": F.max(F.col("c0") + F.col("length")).over(Window.partitionBy("line_id"))})
    bend = F.when(F.col("turn") > 0, F.struct("turn", (F.col("c0") - F.lag("gap").over(w) / 2).alias("a"), (F.col("c0") + F.col("gap") / 2).alias("b")))
    seg = seg.withColumns({"bend": bend, "ends": F.lead("seg").over(w).isNull()})
    seg = seg.withColumn("near", F.collect_list("bend").over(Window.partitionBy("line_id").orderBy(F.col("c0") / (2 * reach + 5 * fine)).rangeBetween(-1, 1)))
    k = (F.ceil(reach / F.col("gap")) + 2).cast("int")
    seg = seg.withColumns({"ahead": F.coalesce(F.lead("near").over(w), F.col("near")), "k": k, "from": F.when(F.col("c0") == 0, 0).otherwise(1)})
    kept = F.when(F.col("n") <= 2 * F.col("k") + 1, F.sequence("from", "n")).otherwise(F.concat(F.sequence("from", "k"), F.sequence(F.col("n") - F.col("k"), F.col("n"))))
    at = seg.withColumn("j", F.explode(kept))
    own = F.col("j") - (F.col("ends") & (F.col("j") == F.col("n"))).cast("int")  # the last point takes the step before it
    at = at.withColumns({"q": F.col("c0") + own / F.col("n") * F.col("length"), "near": F.when(2 * own <= F.col("n"), F.col("near")).otherwise(F.col("ahead"))})
    done = lambda v, q: F.least(F.greatest((q - v["a"]) / (v["b"] - v["a"]), F.lit(0.0)), F.lit(1.0))
    turned = F.aggregate("near", F.lit(0.0), lambda s, v: s + v["turn"] * (done(v, F.col("q") + reach) - done(v, F.col("q") - reach)))
    at = at.withColumns({"turned": turned, "span": F.least(F.col("q") + reach, F.col("end")) - F.greatest(F.col("q") - reach, F.lit(0.0))})
    radius = F.when(F.col("turned") > 1e-9, F.least(F.col("span") / F.col("turned"), F.lit(1e4))).otherwise(1e4)
    t = F.col("j") / F.col("n")
    step = F.least(F.greatest(radius * math.radians(turn_deg), F.lit(least)), F.lit(float(h)))
    at = at.select("line_id", "seg", "j", (F.col("c0") + t * F.col("length")).alias("d"), *[(F.col(c) + t * (F.col(f"{c}2") - F.col(c))).alias(c) for c in "xy"], step.alias("step"))
    w = Window.partitionBy("line_id").orderBy("seg", "j")
    share = F.coalesce(2 * (F.col("d") - F.lag("d").over(w)) / (F.col("step") + F.lag("step").over(w)), F.lit(0.0))
    at = at.withColumn("n", F.sum(share).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = at.withColumns({"total": F.max("n").over(Window.partitionBy("line_id")), "n0": F.lag("n").over(w), "x0": F.lag("x").over(w), "y0": F.lag("y").over(w), "last": F.lead("n").over(w).isNull()})
    at = at.withColumn("m", F.greatest(F.ceil("total"), F.lit(1)).cast("int"))
    passed = lambda n: F.floor(F.col(n) * F.col("m") / F.col("total") + 1e-9).cast("int")
    at = at.withColumns({"low": F.when(F.col("n0").isNull(), 0).otherwise(passed("n0") + 1), "high": F.when(F.col("n0").isNull(), 0).when(F.col("last"), F.col("m")).otherwise(passed("n"))})
    cut = at.filter("low <= high").withColumn("k", F.explode(F.sequence("low", "high")))
    t = F.coalesce(F.least(F.greatest(F.try_divide(F.col("total") * F.col("k") / F.col("m") - F.col("n0"), F.col("n") - F.col("n0")), F.lit(0.0)), F.lit(1.0)), F.lit(1.0))
    between = lambda c: (F.coalesce(f"{c}0", c) + t * (F.col(c) - F.coalesce(f"{c}0", c))).alias(c)
    return cut.select("line_id", "k", between("x"), between("y"))


def split_at_joints(vertices: DataFrame, joints: DataFrame) -> DataFrame:
    """(line_id, leg, seq, x, y): a line cut at the inner vertex nearest each joint (line_id, joint, x, y), always past the cut before; a cut ends one leg and starts the next.

    Joints beyond the last inner vertex cut nothing. Lines without joints stay whole.
    """
    points = vertices.groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("v"))
    ordered = joints.groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("joint", F.col("x").alias("jx"), F.col("y").alias("jy")))).alias("j"))
    both = points.join(ordered, "line_id", "left")
    last = F.size("v") - 1

    def nearest(done: Column, j: Column) -> Column:
        low = F.element_at(done, -1) + 1
        open_ = F.filter(F.transform("v", lambda p, k: F.struct(F.hypot(p["x"] - j["jx"], p["y"] - j["jy"]).alias("away"), k.alias("k"))), lambda q: (q["k"] >= low) & (q["k"] < last))
        return F.when(F.size(open_) > 0, F.concat(done, F.array(F.array_min(open_)["k"]))).otherwise(done)

    cuts = F.concat(F.aggregate(F.coalesce("j", F.array_except("j", "j")), F.array(F.lit(0)), nearest), F.array(last))
    cut = F.when(F.col("j").isNull(), F.array(F.lit(0), last)).otherwise(cuts)
    legs = both.withColumn("cuts", cut).select("line_id", "v", "cuts", F.explode(F.sequence(F.lit(0), F.size("cuts") - 2)).alias("leg"))
    a, b = F.get("cuts", F.col("leg")), F.get("cuts", F.col("leg") + 1)
    return legs.select("line_id", "leg", F.explode(F.slice("v", a + 1, b - a + 1)).alias("p")).select("line_id", "leg", "p.*")


def leaves_trail(legs: DataFrame, trails: DataFrame, limit: float = 3.0) -> DataFrame:
    """(line_id, leaves): whether any metre of a line is over ``limit`` from the trail of the same line_id."""
    at = densify(legs, ["line_id"], 1.0).select(F.struct("line_id", "seg", "j").alias("point_id"), "line_id", "x", "y")
    near = nearest_on_lines(at, trails, limit, same_line=True)
    return near.groupBy(F.col("point_id.line_id").alias("line_id")).agg(F.max(F.col("distance").isNull()).alias("leaves"))


def lines_apart(a: DataFrame, b: DataFrame, jump: float = 10.0) -> DataFrame:
    """(line_id, apart, jump): how far two lines of one line_id stray from each other, either way; null and a jump where that is over ``jump`` metres."""
    point = lambda v: v.select(F.struct("line_id", "seq").alias("point_id"), "line_id", "x", "y")
    both = nearest_on_lines(point(a), b, jump, same_line=True).union(nearest_on_lines(point(b), a, jump, same_line=True))
    far = F.max(F.col("distance").isNull())
    return both.groupBy(F.col("point_id.line_id").alias("line_id")).agg(F.when(~far, F.max("distance")).alias("apart"), far.alias("jump"))


def same_samples(a: DataFrame, b: DataFrame, within: float = 0.5) -> DataFrame:
    """(line_id, same): candidates with as many samples, each within ``within`` of its partner."""
    j = a.select("line_id", "i", "x", "y").join(b.select("line_id", "i", F.col("x").alias("bx"), F.col("y").alias("by")), ["line_id", "i"], "full")
    near = F.hypot(F.col("x") - F.col("bx"), F.col("y") - F.col("by")) <= within
    return j.groupBy("line_id").agg(F.min(F.coalesce(near, F.lit(False))).alias("same"))


def apply_candidate(vertices: DataFrame, candidate: DataFrame, picked: DataFrame, leaving: DataFrame) -> DataFrame:
    """(line_id, leg, seq, kind, x, y) of the new variant.

    Legs from ``picked`` (line_id, first, last) take the candidate's vertices (line_id,
    leg, seq, x, y), but for the stretch's two ends, which stay exactly; existing legs
    in ``leaving`` (line_id, leg, leaves) become reroutes. Compare signatures first.
    """
    v = vertices.join(picked, "line_id", "left")
    inside = F.coalesce(F.col("leg").between(F.col("first"), F.col("last")), F.lit(False))
    kept = v.filter(~inside).select("line_id", "leg", "seq", "kind", "x", "y")
    leg = Window.partitionBy("line_id", "leg")
    old = v.filter(inside).groupBy("line_id", "leg").agg(F.min("kind").alias("kind"), F.min_by(F.struct("x", "y"), "seq").alias("start"), F.max_by(F.struct("x", "y"), "seq").alias("end"), F.min("first").alias("first"), F.min("last").alias("last"))
    new = candidate.withColumns({"low": F.min("seq").over(leg), "high": F.max("seq").over(leg)}).join(old, ["line_id", "leg"]).join(leaving, ["line_id", "leg"], "left")
    at = F.when((F.col("leg") == F.col("first")) & (F.col("seq") == F.col("low")), F.col("start")).when((F.col("leg") == F.col("last")) & (F.col("seq") == F.col("high")), F.col("end")).otherwise(F.struct("x", "y"))
    kind = F.when((F.col("kind") == "existing") & F.col("leaves"), "reroute").otherwise(F.col("kind"))
    return kept.union(new.select("line_id", "leg", "seq", kind.alias("kind"), at["x"].alias("x"), at["y"].alias("y")))


def apply_if_unchanged(vertices: DataFrame, candidate: DataFrame, picked: DataFrame, leaving: DataFrame, signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What ``apply_candidate`` makes of the lines whose legs still have the signature that the candidate was made for, and (line_id, reason) of the others.

    ``signed``: line_id, signature (as of ``legs_signature``); ``vertices`` has lon and lat
    too. A line without a signature, or without legs, is refused.
    """
    now = legs_signature(vertices).withColumnRenamed("signature", "now")
    told = picked.select("line_id").distinct().join(signed, "line_id", "left").join(now, "line_id", "left")
    reason = F.when(F.col("now").isNull(), "no legs").when(F.col("signature").isNull(), "not signed").when(F.col("now") != F.col("signature"), "the legs have changed")
    told = settled(told.select("line_id", reason.alias("reason")))
    good = told.filter("reason is null").select("line_id")
    held = lambda rows: rows.join(good, "line_id", "left_semi")
    return apply_candidate(held(vertices), held(candidate), held(picked), held(leaving)), told.filter("reason is not null")


# --- effort by sample ---------------------------------------------------------------


def bend_charge(fine: DataFrame, samples: DataFrame, value: Column, h: float) -> DataFrame:
    """(line_id, i, bends, bend_r): right angles turned near each sample, weighted by ``value`` (a column of fine's radius), and the tightest radius.

    ``fine`` has line_id, s, turn, radius and free (false inside a corner, which is
    charged by itself); a fine vertex belongs to the first sample less than half of ``h``
    behind it, or ahead, the last one beyond the end. Samples without one get 0 and 10,000.
    """
    here = samples.select("line_id", F.col("d").alias("pos"), "i", F.lit(None).cast("double").alias("bend"), F.lit(None).cast("double").alias("radius"))
    bend = F.when(F.col("free"), value * F.col("turn") / (math.pi / 2)).otherwise(0.0)
    asked = fine.select("line_id", (F.col("s") - h / 2).alias("pos"), F.lit(None).cast(here.schema["i"].dataType).alias("i"), bend.alias("bend"), F.col("radius").cast("double").alias("radius"))
    w = Window.partitionBy("line_id").orderBy(F.desc("pos"), F.col("i").isNotNull().cast("int").desc())
    own = F.coalesce(F.last("i", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.max("i").over(Window.partitionBy("line_id")))
    out = here.union(asked).withColumn("i", own).groupBy("line_id", "i")
    return out.agg(F.coalesce(F.sum("bend"), F.lit(0.0)).alias("bends"), F.least(F.coalesce(F.min("radius"), F.lit(1e4)), F.lit(1e4)).alias("bend_r"))


def effort_density(samples: DataFrame, values: dict[str, Column], weights: dict[str, float], corners: DataFrame) -> DataFrame:
    """(line_id, i, density): metres of effort that each sample stands for.

    Its slope length ``sl``, the weighted factor values along it, weighted ``bends`` and
    ``climb``, and an even share of each corner (line_id, a, b, value) over it.
    """
    share = corners.select("line_id", (F.lit(float(weights.get("corner", 0))) * F.col("value") / (F.col("b") - F.col("a") + 1)).alias("share"), F.explode(F.sequence("a", "b")).alias("i"))
    share = share.groupBy("line_id", "i").agg(F.sum("share").alias("share"))
    own = F.col("sl")
    for n, v in values.items():
        own = own + float(weights.get(n, 0)) * F.coalesce(v, F.lit(0.0)) * F.col("sl")
    for n in ("bend", "climb"):
        own = own + float(weights.get(n, 0)) * F.coalesce(f"{n}s", F.lit(0.0))
    return samples.join(share, ["line_id", "i"], "left").select("line_id", "i", (own + F.coalesce("share", F.lit(0.0))).alias("density"))


def factor_tracks(samples: DataFrame, values: dict[str, Column], weights: dict[str, float]) -> DataFrame:
    """(line_id, i, x, y, bend, cost_...): what each factor charges a metre at each sample; needs w, bends, climbs, bend_r."""
    k = lambda n: float(weights.get(n, 0))
    cost = {n: k(n) * F.coalesce(v, F.lit(0.0)) for n, v in values.items()} | {n: k(n) * F.col(f"{n}s") / F.greatest("w", F.lit(1e-6)) for n in ("bend", "climb")}
    place = [F.round(c, 2).alias(c) for c in ("x", "y")]
    return samples.select("line_id", "i", *place, F.round(F.least("bend_r", F.lit(1000.0)), 2).alias("bend"), *[F.round(c, 4).alias(f"cost_{n}") for n, c in cost.items()])


def write_factor_csv(tracks: DataFrame, path: str) -> None:
    """A row per sample with a header line, a file per task, lines in order inside a file."""
    tracks.repartition("line_id").sortWithinPartitions("line_id", "i").write.option("header", True).csv(path)


def best_tube(lines: DataFrame, totals: Callable[[DataFrame], DataFrame], low: float = 0.02, high: float = 0.75, steps: int = 8) -> DataFrame:
    """(line_id, tube, total): the cheapest of evenly spaced tube widths, the narrowest of equals. ``totals`` makes (line_id, tube, total) of the lines with each width; a null total is no result."""
    tried = lines.withColumn("tube", F.explode(F.array(*[F.lit(low + (high - low) * k / (steps - 1)) for k in range(steps)])))
    return totals(tried).filter("total is not null").groupBy("line_id").agg(F.min(F.struct("total", "tube")).alias("b")).select("line_id", "b.tube", "b.total")


# --- height along a line ------------------------------------------------------------


def reversal_sites(samples: DataFrame, dip: float, reach: float = 10.0, merge: float = 15.0) -> DataFrame:
    """(line_id, d): places that drain, ``merge`` metres apart at least.

    Low points of the design line ``zd`` with ``dip`` to climb on both sides within
    ``reach``, and ground ``z`` deeper by ``dip`` than the mean of it ``reach`` before and behind.
    """
    # the range frame of a double needs SQL
    before = F.expr(f"max(zd) over (partition by line_id order by d range between {reach}D preceding and current row)")
    behind = F.expr(f"max(zd) over (partition by line_id order by d range between current row and {reach}D following)")
    s = read_around(samples.select("line_id", "i", "d", "z", "zd").withColumns({"left": before, "right": behind}), "z", reach)
    s = s.withColumn("e", F.col("z") - (F.col("before") + F.col("after")) / 2)
    step = lambda f, c: f(c).over(_by_i())
    low = (F.col("zd") - step(F.lag, "zd") < -1e-6) & (step(F.lead, "zd") - F.col("zd") >= -1e-6) & (F.least("left", "right") - F.col("zd") >= dip)
    hollow = (F.col("e") < -dip) & (F.col("e") <= step(F.lag, "e")) & (F.col("e") <= step(F.lead, "e"))
    sites = s.withColumn("site", F.coalesce(low, F.lit(False)) | F.coalesce(hollow, F.lit(False))).filter("site")
    kept = F.aggregate(F.array_sort(F.collect_list("d")), F.array().cast("array<double>"), lambda done, d: F.when((F.size(done) == 0) | (d - F.element_at(done, -1) >= merge), F.concat(done, F.array(d))).otherwise(done))
    return sites.groupBy("line_id").agg(kept.alias("d")).select("line_id", F.explode("d").alias("d"))


def height_lost(samples: DataFrame, band: float, z: str = "z") -> DataFrame:
    """(line_id, first_i, last_i, depth): heights that a line loses and wins back against its net direction.

    Moves of less than ``band`` are not seen. Samples without a height are passed over.
    """

    def drops(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["z"]).sort_values("i", ignore_index=True)
        return pd.DataFrame([(pdf["line_id"][0], pdf["i"][a], pdf["i"][b], h) for a, b, h in _drops(pdf["z"].to_numpy(float), band)], columns=["line_id", "first_i", "last_i", "depth"])

    kinds = dict(samples.dtypes)
    return samples.select("line_id", "i", F.col(z).alias("z")).groupBy("line_id").applyInPandas(drops, f"line_id {kinds['line_id']}, first_i {kinds['i']}, last_i {kinds['i']}, depth double")


def _drops(z: np.ndarray, band: float) -> list[tuple[int, int, float]]:
    """(top, bottom, depth) of every fall of at least ``band`` that is won back by ``band`` or ends the line, on a line turned to climb."""
    if len(z) < 2:
        return []
    z, band = (z if z[-1] >= z[0] else -z), max(band, 1e-9)
    moves = np.flatnonzero(np.diff(z))
    if not len(moves):
        return []
    out, top, bottom = [], 0, None
    # one sample of each flat, its last, as there the line turns
    for i in [*moves[1:].tolist(), len(z) - 1]:
        if bottom is None:
            if z[i] > z[top] or (not out and z[i] == z[top]):
                top = i
            elif z[top] - z[i] >= band:
                bottom = i
        elif z[i] < z[bottom]:
            bottom = i
        elif z[i] - z[bottom] >= band:
            out.append((top, bottom, float(z[top] - z[bottom])))
            top, bottom = i, None
    return out + ([(top, bottom, float(z[top] - z[bottom]))] if bottom is not None else [])


def design_profile(samples: DataFrame, low: str = "low", high: str = "high") -> DataFrame:
    """(line_id, i, zd): the taut string between the bounds of each sample, its ends pinned halfway between theirs. A line is one group; rows with a null bound are left out."""

    def string(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna().sort_values("i", ignore_index=True)
        return pdf[["line_id", "i"]].assign(zd=taut_string(*(pdf[c].to_numpy(float) for c in ("d", "low", "high"))))

    kinds = dict(samples.dtypes)
    rows = samples.select("line_id", "i", "d", F.col(low).alias("low"), F.col(high).alias("high"))
    return rows.groupBy("line_id").applyInPandas(string, f"line_id {kinds['line_id']}, i {kinds['i']}, zd double")


def taut_string(d: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Shortest line between the bounds. From each knot the slopes that still fit are a running wedge; where it closes, its last edge is the next knot."""
    n = len(d)
    if n < 2:
        return (low + high) / 2
    low, high = low.copy(), high.copy()
    low[[0, -1]] = high[[0, -1]] = (low[[0, -1]] + high[[0, -1]]) / 2
    at, z = [0], [low[0]]
    while at[-1] < n - 1:
        a, reach = at[-1], 32
        while True:
            b = min(n, a + 1 + reach)
            run = np.maximum(d[a + 1 : b] - d[a], 1e-9)
            up, down = (high[a + 1 : b] - z[-1]) / run, (low[a + 1 : b] - z[-1]) / run
            top, floor = np.minimum.accumulate(up), np.maximum.accumulate(down)
            shut = np.flatnonzero(floor > top)
            if len(shut) or b == n:
                break
            reach *= 2
        if not len(shut):
            at.append(n - 1)
            z.append(low[-1])
            continue
        j = int(shut[0])  # the bound met at j is beyond the other edge of the wedge
        rising = down[j] > (top[j - 1] if j else np.inf)
        edge = up if rising else down
        k = int(np.flatnonzero(edge[:j] == (top[j - 1] if rising else floor[j - 1]))[-1])
        at.append(a + 1 + k)
        z.append((high if rising else low)[a + 1 + k])
    return np.interp(d, d[at], z)
