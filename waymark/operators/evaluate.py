"""Evaluation of sampled lines: grades, smoothing, bands, runs, percentiles, effort, summaries.

A line's windows share one partitioning and one order, so a table of lines is
shuffled once. Groupings are by (line_id) or (line_id, leg): ``by`` says which.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import slope_pct, tsa_deg, tsa_near

# Thresholds, smoothing widths and the effort rubric (min, max, build m/day, maintain m/day).
MILE = 1609.344
GRADE_STEPS, SLOPE_STEPS, TSA_STEPS = [5.0, 18.0, 35.0], [10.0, 20.0, 73.0, 100.0], [45.0, 60.0, 68.0]
GRADE_WIDTH, TSA_WIDTH, SLOPE_WIDTH, CLIMB_WIDTH = 9, 9, 5, 9
SLOPE_RUBRIC = [(0, 10, 10.0, MILE), (10, 20, 30.0, MILE), (20, 50, 100.0, MILE), (50, 90, 50.0, MILE / 2), (90, 10000, 10.0, MILE / 2)]
GRADE_RUBRIC = [(0, 15, MILE, 3 * MILE), (15, 25, MILE, 2 * MILE), (25, 45, 20.0, 2 * MILE), (45, 77, 5.0, MILE / 2), (77, 10000, 0.5, MILE / 10)]


def _line():
    return Window.partitionBy("line_id").orderBy("i")


def grade_bridged() -> Column:
    """Grade in % against the last sample that has an elevation."""
    last = F.last(F.when(F.col("z").isNotNull(), F.struct("d", "z")), True).over(_line().rowsBetween(Window.unboundedPreceding, -1))
    run = F.col("d") - last["d"]
    return F.when(F.col("z").isNotNull() & (run > 0), (F.col("z") - last["z"]) / run * 100)


def running_mean_sym(value: str, width: int) -> Column:
    """Centred mean over an odd width, null-skipping; near the ends the window shrinks on both sides. Values are added in order."""
    half = width // 2
    if half < 1:
        return F.col(value)
    return _mean_of(_radius(half), [_beside(value, k) for k in range(-half, half + 1)])


def _radius(half: int) -> Column:
    """Samples on either side, as many as the shorter side has, ``half`` at most."""
    return F.least(*[F.count(F.lit(1)).over(_line().rowsBetween(*rows)) for rows in ((-half, -1), (1, half))])


def _beside(value: str, k: int) -> Column:
    """The value ``k`` samples on."""
    v = F.col(value).cast("double")
    return F.lag(v, -k).over(_line()) if k < 0 else F.lead(v, k).over(_line()) if k else v


def _mean_of(radius: Column, values: list[Column]) -> Column:
    half = len(values) // 2
    taken = [v if k == half else F.when(radius >= abs(k - half), v) for k, v in enumerate(values)]
    total, known = F.lit(0.0), F.lit(0)
    for v in taken:
        total, known = total + F.coalesce(v, F.lit(0.0)), known + v.isNotNull().cast("int")
    return F.when(known > 0, total / known)


def smoothed(samples: DataFrame, means: dict[str, tuple[str, int]]) -> DataFrame:
    """``samples`` with symmetric running means, name: (value, width). Every neighbour is read once, into a column of its own."""
    halves = {n: width // 2 for n, (_, width) in means.items()}
    beside = {f"_{n}{k}": _beside(v, k) for n, (v, _) in means.items() for k in range(-halves[n], halves[n] + 1)}
    near = samples.withColumns({"_radius": _radius(max(halves.values())), **beside})
    out = {n: _mean_of(F.col("_radius"), [F.col(f"_{n}{k}") for k in range(-h, h + 1)]) for n, h in halves.items()}
    return near.withColumns(out).drop("_radius", *beside)


def running_mean_clip(value: str, width: int) -> Column:
    """Centred mean whose window is cut at the ends."""
    return F.avg(value).over(_line().rowsBetween(-(width // 2), width // 2))


def heading_of(x: str = "x", y: str = "y") -> Column:
    """Direction of the central difference, one-sided at the ends."""
    dx = F.coalesce(F.lead(x).over(_line()), F.col(x)) - F.coalesce(F.lag(x).over(_line()), F.col(x))
    dy = F.coalesce(F.lead(y).over(_line()), F.col(y)) - F.coalesce(F.lag(y).over(_line()), F.col(y))
    return F.atan2(dy, dx)


def interval_weight(kind: str = "evaluator") -> Column:
    """Metres a sample stands for: "evaluator" the step before it; "scoring" half of both steps, ends a full one; "panel" the same with half at the ends."""
    before, after = F.col("d") - F.lag("d").over(_line()), F.lead("d").over(_line()) - F.col("d")
    if kind == "evaluator":
        return F.coalesce(before, F.lit(0.0))
    ends = 1.0 if kind == "scoring" else 0.5
    return F.coalesce((before + after) / 2, before * ends, after * ends, F.lit(0.0))


def measured(samples: DataFrame, near: bool = False) -> DataFrame:
    """``samples`` with grade, slope, tsa and their smoothed forms, and zs, the elevation smoothed for climbing. ``near`` takes tsa to its last digit, for tests against a bound; it costs a pass through Arrow."""
    tsa = (tsa_near if near else tsa_deg)(F.col("heading"), F.col("gx"), F.col("gy"))
    raw = samples.withColumns({"grade": grade_bridged(), "slope": slope_pct(F.col("gx"), F.col("gy")), "tsa": tsa})
    means = {"grade_s": ("grade", GRADE_WIDTH), "slope_s": ("slope", SLOPE_WIDTH), "tsa_s": ("tsa", TSA_WIDTH), "zs": ("z", CLIMB_WIDTH)}
    return smoothed(raw, means).withColumn("grade_s", F.abs("grade_s"))


def climb_descent(points: DataFrame, by: list[str], z: str = "z", order: str = "i") -> DataFrame:
    """Sums of the steps up and down between samples that have an elevation."""
    step = F.col(z) - F.lag(z).over(Window.partitionBy(*by).orderBy(order))
    steps = points.filter(F.col(z).isNotNull()).select(*by, step.alias("s"))
    return steps.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("s") > 0, F.col("s"))), F.lit(0.0)).alias("climb"), F.coalesce(-F.sum(F.when(F.col("s") < 0, F.col("s"))), F.lit(0.0)).alias("descent"))


def percentile_stats(points: DataFrame, by: list[str], value: str) -> DataFrame:
    """Interpolated percentiles of the values, each sample alike; exact."""
    marks = [2, 5, 25, 50, 75, 95, 98]
    p = F.percentile(value, F.array(*[F.lit(m / 100) for m in marks]))
    out = points.groupBy(*by).agg(p.alias("p"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"))
    return out.select(*by, *[F.get("p", F.lit(k)).alias(f"p{m}") for k, m in enumerate(marks)], "min", "max", "mean")


def runs(points: DataFrame, by: list[str], flag: Column) -> DataFrame:
    """Lengths of the runs of samples that hold: (by, run, length); nulls break a run."""
    window = Window.partitionBy(*by).orderBy("i")
    held = points.select(*by, "i", "w", F.coalesce(flag, F.lit(False)).alias("held"))
    starts = held.withColumn("run", F.sum((F.col("held") & ~F.coalesce(F.lag("held").over(window), F.lit(False))).cast("int")).over(window.rowsBetween(Window.unboundedPreceding, 0)))
    return starts.filter("held").groupBy(*by, "run").agg(F.sum("w").alias("length"))


def _runs_so_far(points: DataFrame, flag: Column) -> DataFrame:
    """``points`` with _run, at a sample that holds the length of its line's run up to it."""
    upto = _line().rowsBetween(Window.unboundedPreceding, 0)
    held = points.withColumns({"_held": F.coalesce(flag, F.lit(False)), "_total": F.sum("w").over(upto)})
    before = F.coalesce(F.last(F.when(~F.col("_held"), F.col("_total")), True).over(upto), F.lit(0.0))
    return held.withColumn("_run", F.when(F.col("_held"), F.col("_total") - before)).drop("_held", "_total")


def longest_run(points: DataFrame, by: list[str], flag: Column) -> DataFrame:
    longest = runs(points, by, flag).groupBy(*by).agg(F.max("length").alias("longest"))
    return points.select(*by).distinct().join(longest, by, "left").select(*by, F.coalesce("longest", F.lit(0.0)).alias("longest"))


def band_of(value: Column, steps: list[float]) -> Column:
    return F.when(value.isNotNull(), F.size(F.filter(F.array(*map(F.lit, steps)), lambda x: value >= x)))


def band_table(points: DataFrame, by: list[str], value: str, steps: list[float]) -> DataFrame:
    """(by, band, length, longest, pct) for every band 0..n, empty ones too; the share is of the length that has a value."""
    banded = points.select(*by, "i", "w", band_of(F.col(value), steps).alias("band"))
    window = Window.partitionBy(*by).orderBy("i")
    change = ~F.col("band").eqNullSafe(F.lag("band").over(window))
    islands = banded.withColumn("run", F.sum(change.cast("int")).over(window.rowsBetween(Window.unboundedPreceding, 0)))
    per_run = islands.filter("band is not null").groupBy(*by, "band", "run").agg(F.sum("w").alias("length"))
    per_band = per_run.groupBy(*by, "band").agg(F.sum("length").alias("length"), F.max("length").alias("longest"))
    grid = points.select(*by).distinct().withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(len(steps)))))
    total = F.sum("length").over(Window.partitionBy(*by))
    full = grid.join(per_band, [*by, "band"], "left").fillna(0.0, ["length", "longest"])
    return full.withColumn("pct", F.when(total > 0, 100 * F.col("length") / total))


def exceedance(points: DataFrame, by: list[str], value: str, at: float, below: bool = False) -> DataFrame:
    """(by, length, pct, longest) of the samples at or above a threshold, or below it."""
    v = F.col(value)
    flag = (v < at) if below else (v >= at)
    known = F.sum(F.when(v.isNotNull(), F.col("w")))
    share = points.groupBy(*by).agg(F.coalesce(F.sum(F.when(flag, F.col("w"))), F.lit(0.0)).alias("length"), known.alias("known"))
    return share.join(longest_run(points, by, flag), by).select(*by, "length", F.when(F.col("known") > 0, 100 * F.col("length") / F.col("known")).alias("pct"), "longest")


def _per_metre(value: str, rubric, k: int) -> Column:
    """Days a metre by the band of the value; null outside all bands."""
    out = F.when(F.lit(False), 0.0)
    for band in rubric:
        out = out.when((F.col(value) >= float(band[0])) & (F.col(value) < float(band[1])), 1 / float(band[k]))
    return out


def _effort(slope: str, grade: str, slope_rubric, grade_rubric) -> list[Column]:
    both = ((slope, slope_rubric or SLOPE_RUBRIC), (grade, grade_rubric or GRADE_RUBRIC))
    days = lambda k: sum(F.coalesce(F.sum(F.col("w") * _per_metre(v, r, k)), F.lit(0.0)) for v, r in both)
    unknown = [F.coalesce(F.sum(F.when(_per_metre(v, r, 2).isNull(), F.col("w"))), F.lit(0.0)) for v, r in both]
    return [days(2).alias("construct_days"), days(3).alias("maintain_days"), F.greatest(*unknown).alias("unassessed_m")]


def effort(points: DataFrame, by: list[str], slope: str = "slope_s", grade: str = "grade_s", slope_rubric=None, grade_rubric=None) -> DataFrame:
    """(by, construct_days, maintain_days, unassessed_m): length over rate in each band of side slope and of grade, summed in one pass."""
    return points.groupBy(*by).agg(*_effort(slope, grade, slope_rubric, grade_rubric))


def coverage_by_source(points: DataFrame, by: list[str]) -> DataFrame:
    """Share of a line's length that each elevation source gave."""
    per = points.groupBy(*by, "src").agg(F.sum("w").alias("length"))
    total = F.sum("length").over(Window.partitionBy(*by))
    return per.select(*by, "src", "length", F.when(total > 0, 100 * F.col("length") / total).alias("pct"))


def _stats(m: DataFrame, by: list[str], more: list[Column] = (), ranked: Column | None = None) -> DataFrame:
    """All statistics of ``measured`` samples by group, in one pass after one window, and what ``more`` asks for. ``ranked`` says which rows' groups need percentiles."""
    before = Window.partitionBy(*by).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    m = m.withColumns({"_up": F.col("z") - F.last("z", True).over(before), "_ups": F.col("zs") - F.last("zs", True).over(before)})
    known = F.col("z").isNotNull()
    first, last = F.min_by("z", F.when(known, F.col("i"))), F.max_by("z", F.when(known, F.col("i")))
    middle = lambda c: F.percentile(F.col(c) if ranked is None else F.when(ranked, F.col(c)), F.lit(0.5)).alias(f"{c[:-2]}_p50")
    moves = [F.coalesce(F.sum(F.when(F.col(c) * way > 0, F.col(c) * way)), F.lit(0.0)).alias(n) for c, way, n in (("_up", 1, "climb"), ("_up", -1, "descent"), ("_ups", 1, "climb_s"), ("_ups", -1, "descent_s"))]
    return m.groupBy(*by).agg(
        F.sum("w").alias("length_m"), F.count("*").alias("samples"), (100 * F.sum(F.when(known, F.col("w"))) / F.sum("w")).alias("coverage_pct"),
        F.min("z").alias("z_min"), F.max("z").alias("z_max"), first.alias("z_start"), last.alias("z_end"),
        (F.min("d") - F.min_by("w", "i")).alias("d_start"), F.max("d").alias("d_end"), middle("grade_s"), middle("slope_s"), middle("tsa_s"),
        *moves, *_effort("slope_s", "grade_s", None, None), *more,
    )


def _factor() -> Column:
    return F.when(F.col("kind") == "existing", 0.0).otherwise(F.coalesce("effort_factor", F.lit(0.0)))


def leg_stats(samples: DataFrame, legs: DataFrame) -> DataFrame:
    """A row per leg of ``legs`` (line_id, leg, kind, effort_factor): all statistics; existing legs are not built, an absent or zero factor counts as 0.

    Smoothing runs over the whole line; a leg's climb ignores the step into its first sample, its length includes it.
    """
    by = ["line_id", "leg"]
    stats = legs.join(_stats(measured(samples), by), by, "left")
    zero = ["length_m", "climb", "descent", "climb_s", "descent_s", "construct_days", "maintain_days", "unassessed_m"]
    return stats.fillna(0.0, zero).fillna(0, ["samples"]).withColumn("construct_days", F.col("construct_days") * _factor())


def alignment_summary(samples: DataFrame, legs: DataFrame) -> DataFrame:
    """A row per line that has legs: its statistics, metres built and existing, the legs' days, and whether it runs uphill.

    Each measured sample counts for its leg and for its line (part -1), so samples are measured once.
    """
    return _summary(measured(samples), legs)


def _summary(m: DataFrame, legs: DataFrame, more: list[Column] = ()) -> DataFrame:
    parts = m.withColumn("leg", F.explode(F.array(F.col("leg"), F.lit(-1))))
    stats = _stats(parts, ["line_id", "leg"], more, F.col("leg") == -1).join(legs, ["line_id", "leg"], "full")
    own = [c for c in stats.columns if c not in ("line_id", "leg", "kind", "effort_factor", "construct_days", "maintain_days")]
    metres = lambda flag: F.coalesce(F.sum(F.when(flag, F.col("length_m"))), F.lit(0.0))
    built = F.col("kind") != "existing"
    out = stats.groupBy("line_id").agg(
        *[F.max(F.when(F.col("leg") == -1, F.col(c))).alias(c) for c in own], F.max(F.when(F.col("leg") == -1, F.lit(True))).alias("whole"), F.count("kind").alias("n"),
        metres(built).alias("build_m"), metres(~built).alias("existing_m"),
        F.coalesce(F.sum(F.when(F.col("kind").isNotNull(), F.col("construct_days") * _factor())), F.lit(0.0)).alias("construct_days"),
        F.coalesce(F.sum(F.when(F.col("kind").isNotNull(), F.col("maintain_days"))), F.lit(0.0)).alias("maintain_days"),
    )
    out = out.filter("n > 0 and whole is not null").select("line_id", *own, "build_m", "existing_m", "construct_days", "maintain_days")
    return out.withColumn("runs_uphill", F.col("z_end") > F.col("z_start"))


def headline(summary: DataFrame, bands: DataFrame) -> DataFrame:
    """The few numbers of a listing: shares at the second and third grade thresholds, below the first TSA one, at the third slope one; null where there is none."""
    first = lambda name: F.max(F.when(F.col("measure") == name, F.col("pct")))
    wide = bands.groupBy("line_id").agg(first("grade_steep").alias("steep_pct"), first("grade_very").alias("very_steep_pct"), first("tsa_fall").alias("fall_line_pct"), first("slope_heavy").alias("heavy_pct"))
    return summary.select("line_id", "length_m", "climb_s", "descent_s", "build_m", "existing_m", "construct_days", "maintain_days").join(wide, "line_id", "left")


def headline_fields(samples: DataFrame, legs: DataFrame, grade_steps=GRADE_STEPS, tsa_steps=TSA_STEPS, slope_steps=SLOPE_STEPS, lidar=(1,)) -> DataFrame:
    """All numbers of a listing, with their thresholds: steep is the second grade threshold or an only one, very steep the third, fall line the first TSA one, heavy the third slope one; null where there is none. ``lidar`` has the sources that count as such."""
    at = lambda steps, k: float(steps[k]) if len(steps) > k else None
    steep = at(grade_steps, 1) or at(grade_steps, 0)
    parts = [("steep", "grade_s", steep), ("very_steep", "grade_s", at(grade_steps, 2)), ("fall_line", "tsa_s", at(tsa_steps, 0)), ("heavy_slope", "slope_s", at(slope_steps, 2))]
    share = lambda flag, of: F.try_divide(100 * F.sum(F.when(flag, F.col("w")).otherwise(0.0)), F.sum(F.when(of, F.col("w"))))
    # samples are measured once and every number is taken with the summary's: a line moves once more after its angles
    m = measured(samples, near=True)
    more = [F.percentile(F.when(F.col("leg") == -1, F.col("grade_s")), F.lit(0.95)).alias("grade_p95"), share(F.col("src").isin(*lidar), F.lit(True)).alias("lidar_pct")]
    for name, value, t in parts:
        v = F.col(value)
        more.append(F.lit(None).cast("double").alias(f"{name}_pct") if t is None else share(v < t if name == "fall_line" else v >= t, v.isNotNull()).alias(f"{name}_pct"))
    if steep is None:
        more.append(F.max(F.lit(None).cast("double")).alias("steep_longest_m"))
    else:
        m = _runs_so_far(m, F.col("grade_s") >= steep)
        more.append(F.coalesce(F.max("_run"), F.lit(0.0)).alias("steep_longest_m"))
    out = _summary(m, legs, more).withColumns({f"{name}_threshold": F.lit(t).cast("double") for name, _, t in parts})
    first = ["length_m", "build_m", "existing_m", F.col("climb_s").alias("climb_m"), F.col("descent_s").alias("descent_m"), "z_min", "z_max", "grade_p50", "grade_p95", "steep_threshold", "steep_pct", "steep_longest_m"]
    rest = [f"{name}_{k}" for name, _, _ in parts[1:] for k in ("threshold", "pct")]
    return out.select("line_id", *first, *rest, "construct_days", "maintain_days", "lidar_pct", "coverage_pct")


def threshold_shares(m: DataFrame) -> DataFrame:
    """(line_id, measure, pct) of the headline's thresholds."""
    parts = [("grade_steep", "grade_s", GRADE_STEPS[1], False), ("grade_very", "grade_s", GRADE_STEPS[2], False), ("tsa_fall", "tsa_s", TSA_STEPS[0], True), ("slope_heavy", "slope_s", SLOPE_STEPS[2], False)]
    aggs = []
    for name, value, at, below in parts:
        v = F.col(value)
        aggs.append((100 * F.sum(F.when((v < at) if below else (v >= at), F.col("w")).otherwise(0.0)) / F.sum(F.when(v.isNotNull(), F.col("w")))).alias(name))
    wide = m.groupBy("line_id").agg(*aggs)
    return wide.unpivot(["line_id"], [p[0] for p in parts], "measure", "pct")


def downsample_profile(points: DataFrame, most: int = 1500) -> DataFrame:
    """Every k-th sample and the last, k the least that keeps ``most``."""
    n = F.count("*").over(Window.partitionBy("line_id"))
    step = F.ceil(n / most)
    return points.withColumn("_n", n).withColumn("_step", step).filter((F.col("i") % F.col("_step") == 0) | (F.col("i") == F.col("_n") - 1)).drop("_n", "_step")
