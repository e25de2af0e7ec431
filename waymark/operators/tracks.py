"""GPS tracks: filled elevations, times, lengths, climbs and quick-look statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import equirect_m, to_utm, utm_srid
from .evaluate import climb_descent


def _track():
    return Window.partitionBy("track_id").orderBy("seq")


def _so_far():
    return _track().rowsBetween(Window.unboundedPreceding, 0)


def fill_elevation() -> Column:
    """The last elevation so far; leading gaps are 0."""
    return F.coalesce(F.last("ele", True).over(_so_far()), F.lit(0.0))


def relative_times() -> Column:
    """Whole seconds since the track's first time, half to even."""
    first = F.first("ts", True).over(_track().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return F.bround((F.unix_micros(F.to_timestamp("ts")) - F.unix_micros(F.to_timestamp(first))) / 1e6).cast("int")


def with_utm(points: DataFrame, key: str = "track_id") -> DataFrame:
    """Adds srid, x, y: planar metres in the zone of each line's mean position."""
    whole = Window.partitionBy(key)
    zone = utm_srid(F.avg("lon").over(whole), F.avg("lat").over(whole))
    out = points.withColumn("srid", zone)
    x, y = to_utm(F.col("lon"), F.col("lat"), F.col("srid"))
    return out.withColumn("x", x).withColumn("y", y)


def steps(kind: str = "utm") -> Column:
    """Metres from the point before."""
    if kind == "utm":
        return F.coalesce(F.hypot(F.col("x") - F.lag("x").over(_track()), F.col("y") - F.lag("y").over(_track())), F.lit(0.0))
    return F.coalesce(equirect_m(F.lag("lon").over(_track()), F.lag("lat").over(_track()), F.col("lon"), F.col("lat")), F.lit(0.0))


def cumulative_distance(points: DataFrame, kind: str = "equirect") -> DataFrame:
    """Points that move (and the first), with d, the distance along."""
    stepped = points.withColumn("step", steps(kind))
    first = F.row_number().over(_track()) == 1
    moving = stepped.withColumn("_first", first).filter("_first or step > 0").drop("_first")
    return moving.withColumn("d", F.sum("step").over(_so_far())).drop("step")


def line_length(points: DataFrame) -> DataFrame:
    return with_utm(points).withColumn("step", steps()).groupBy("track_id").agg(F.sum("step").alias("length_m"))


def track_summary(points: DataFrame) -> DataFrame:
    """(track_id, point_count, length_m, climb_m, descent_m, taken_at, has_elevation); no climb where nothing has an elevation."""
    filled = with_utm(points).withColumns({"z": fill_elevation(), "step": steps()})
    change = F.col("z") - F.lag("z").over(_track())
    out = filled.withColumn("change", change).groupBy("track_id").agg(
        F.count("*").cast("int").alias("point_count"), F.sum("step").alias("length_m"),
        F.coalesce(F.sum(F.when(F.col("change") > 0, F.col("change"))), F.lit(0.0)).alias("up"), F.coalesce(-F.sum(F.when(F.col("change") < 0, F.col("change"))), F.lit(0.0)).alias("down"),
        F.min_by("ts", F.when(F.col("ts").isNotNull(), F.col("seq"))).alias("taken_at"), (F.count("ele") > 0).alias("has_elevation"),
    )
    zero = F.lit(0.0)
    return out.select("track_id", "point_count", "length_m", F.when(F.col("has_elevation"), F.col("up")).otherwise(zero).alias("climb_m"), F.when(F.col("has_elevation"), F.col("down")).otherwise(zero).alias("descent_m"), "taken_at", "has_elevation")


def grade_in_range(reach: float = 15.0) -> Column:
    """Grade in % over ``reach`` metres either way, at least to both neighbours; needs d and z."""
    here = F.struct("d", "z")
    around = f"over (partition by track_id order by d range between {reach}D preceding and {reach}D following)"
    low, high = F.expr(f"first(struct(d, z)) {around}"), F.expr(f"last(struct(d, z)) {around}")
    by_d = Window.partitionBy("track_id").orderBy("d")
    low = F.least(low, F.coalesce(F.lag(here).over(by_d), here))
    high = F.greatest(high, F.coalesce(F.lead(here).over(by_d), here))
    return F.when(high["d"] > low["d"], (high["z"] - low["z"]) / (high["d"] - low["d"]) * 100)


def quick_stats(points: DataFrame) -> DataFrame:
    """(track_id, length_m, climb, descent, z_min, z_max, max_grade): the grade of the largest magnitude keeps its sign."""
    along = cumulative_distance(points.withColumn("z", fill_elevation()))
    graded = along.withColumn("grade", grade_in_range())
    base = graded.groupBy("track_id").agg(F.max("d").alias("length_m"), F.min("z").alias("z_min"), F.max("z").alias("z_max"), F.max(F.struct(F.abs("grade").alias("a"), "grade"))["grade"].alias("max_grade"))
    return base.join(climb_descent(along, ["track_id"], "z", "seq"), "track_id")


def window_fit(points: DataFrame, d0: float, d1: float) -> DataFrame:
    """(track_id, n, mean_z, slope_pct, curvature) of the samples with d in [d0, d1]: least-squares line, and 2000 times the quadratic term (three samples or more)."""
    inside = points.filter(F.col("d").between(d0, d1))
    whole = Window.partitionBy("track_id")
    u = F.col("d") - F.avg("d").over(whole)
    centred = inside.withColumn("u", u)
    s = [F.sum(F.pow("u", F.lit(float(k)))).alias(f"s{k}") for k in range(1, 5)]
    t = [F.sum(F.pow("u", F.lit(float(k))) * F.col("z")).alias(f"t{k}") for k in range(3)]
    m = centred.groupBy("track_id").agg(F.count("*").alias("n"), F.avg("z").alias("mean_z"), F.regr_slope("z", "d").alias("slope"), *s, *t)
    c = F.col
    det = c("n") * (c("s2") * c("s4") - c("s3") * c("s3")) - c("s1") * (c("s1") * c("s4") - c("s2") * c("s3")) + c("s2") * (c("s1") * c("s3") - c("s2") * c("s2"))
    quad = c("n") * (c("s2") * c("t2") - c("t1") * c("s3")) - c("s1") * (c("s1") * c("t2") - c("t1") * c("s2")) + c("t0") * (c("s1") * c("s3") - c("s2") * c("s2"))
    return m.select("track_id", "n", "mean_z", (c("slope") * 100).alias("slope_pct"), F.when((c("n") >= 3) & (F.abs(det) > 1e-9), 2000 * quad / det).alias("curvature"))
