"""Evaluator and track operators over the adapted tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import evaluate as V
from ..operators import tracks as K
from .adapters import adapted
from .registry import query, rounded


def _mean_sql(value: str, width: int) -> str:
    half = width // 2
    cases = "".join(f" when least(i, n - 1 - i, {half}) = {r} then avg({value}) over (partition by line_id order by i rows between {r} preceding and {r} following)" for r in range(half + 1))
    return f"case{cases} end"


#: The measures of samples, said once more in SQL.
_MEASURED = f"""g0 as (select *, count(*) over (partition by line_id) as n,
    last_value(case when z is not null then d end ignore nulls) over (partition by line_id order by i rows between unbounded preceding and 1 preceding) as pd,
    last_value(z ignore nulls) over (partition by line_id order by i rows between unbounded preceding and 1 preceding) as pz from samples),
g as (select line_id, leg, i, w, d, z, src, n, case when z is not null and d > pd then (z - pz) / (d - pd) * 100 end as grade,
    sqrt(gx * gx + gy * gy) * 100 as slope,
    case when sqrt(gx * gx + gy * gy) * 100 >= 3 then degrees(acos(least(abs(cos(heading - atan2(gy, gx))), 1))) end as tsa from g0),
m as (select line_id, leg, i, w, d, z, src, n, grade, slope, tsa, abs({_mean_sql('grade', 9)}) as grade_s, {_mean_sql('slope', 5)} as slope_s, {_mean_sql('tsa', 9)} as tsa_s, {_mean_sql('z', 9)} as zs from g)"""


def _m(spark, d):
    return V.measured(adapted(spark, d, "samples"))


@query(f"with {_MEASURED} select line_id, i, round(grade, 6) as grade, round(slope, 6) as slope, round(tsa, 5) as tsa from m")
def w02_grade_bridged(spark, d):
    m = _m(spark, d).select("line_id", "i", "grade", "slope", F.round("tsa", 5).alias("tsa"))
    return rounded(m)


@query(f"with {_MEASURED} select line_id, i, round(grade_s, 4) as grade_s, round(slope_s, 6) as slope_s, round(tsa_s, 5) as tsa_s, round(zs, 6) as zs from m")
def w03_running_mean_sym(spark, d):
    return _m(spark, d).select("line_id", "i", F.round("grade_s", 4).alias("grade_s"), F.round("slope_s", 6).alias("slope_s"), F.round("tsa_s", 5).alias("tsa_s"), F.round("zs", 6).alias("zs"))


@query("select line_id, i, round(avg(z) over (partition by line_id order by i rows between 3 preceding and 3 following), 6) as z_mean from samples")
def w04_running_mean_clip(spark, d):
    return rounded(adapted(spark, d, "samples").select("line_id", "i", V.running_mean_clip("z", 7).alias("z_mean")))


@query(
    """select line_id, i, round(atan2(coalesce(lead(gy) over w, gy) - coalesce(lag(gy) over w, gy), coalesce(lead(gx) over w, gx) - coalesce(lag(gx) over w, gx)), 6) + 0e0 as heading
    from samples window w as (partition by line_id order by i)"""
)
def w05_heading(spark, d):
    return rounded(adapted(spark, d, "samples").select("line_id", "i", V.heading_of("gx", "gy").alias("heading")))


@query(
    """select line_id, i, round(coalesce(d - lag(d) over w, 0), 6) as w_evaluator,
    round(case when lag(d) over w is null then lead(d) over w - d when lead(d) over w is null then d - lag(d) over w else (lead(d) over w - lag(d) over w) / 2 end, 6) as w_scoring,
    round(case when lag(d) over w is null then (lead(d) over w - d) / 2 when lead(d) over w is null then (d - lag(d) over w) / 2 else (lead(d) over w - lag(d) over w) / 2 end, 6) as w_panel
    from samples window w as (partition by line_id order by i)"""
)
def w09_interval_weight(spark, d):
    s = adapted(spark, d, "samples")
    return rounded(s.select("line_id", "i", *[V.interval_weight(k).alias(f"w_{k}") for k in ("evaluator", "scoring", "panel")]))


@query("with c as (select line_id, z - lag(z) over (partition by line_id order by i) as s from samples where z is not null) select line_id, round(coalesce(sum(s) filter (s > 0), 0), 4) as climb, round(coalesce(-sum(s) filter (s < 0), 0), 4) as descent from c group by line_id")
def a02_climb_descent(spark, d):
    return rounded(V.climb_descent(adapted(spark, d, "samples"), ["line_id"]), 4)


@query("select line_id, leg, " + ", ".join(f"round(quantile_cont(z, {p / 100}), 6) as p{p}" for p in (2, 5, 25, 50, 75, 95, 98)) + ", round(min(z), 6) as min, round(max(z), 6) as max, round(avg(z), 6) as mean from samples group by line_id, leg")
def a04_percentile_stats(spark, d):
    return rounded(V.percentile_stats(adapted(spark, d, "samples"), ["line_id", "leg"], "z"))


@query(
    f"""with {_MEASURED}, b as (select line_id, i, w, case when slope_s is null then null else (slope_s >= 10)::int + (slope_s >= 20)::int + (slope_s >= 73)::int + (slope_s >= 100)::int end as band from m),
    f as (select *, case when band is distinct from lag(band) over (partition by line_id order by i) then 1 else 0 end as c from b),
    r as (select *, sum(c) over (partition by line_id order by i) as run from f),
    q as (select line_id, band, run, sum(w) as length from r where band is not null group by all),
    t as (select line_id, band, sum(length) as length, max(length) as longest from q group by all),
    grid as (select line_id, unnest(range(5)) as band from (select distinct line_id from samples))
    select g.line_id, g.band::int as band, round(coalesce(length, 0), 6) as length, round(coalesce(longest, 0), 6) as longest, round(100 * coalesce(length, 0) / sum(length) over (partition by g.line_id), 6) as pct from grid g left join t on t.line_id = g.line_id and t.band = g.band"""
)
def a05_band_table(spark, d):
    return rounded(V.band_table(_m(spark, d), ["line_id"], "slope_s", V.SLOPE_STEPS))


@query(
    f"""with {_MEASURED}, f as (select line_id, leg, i, w, coalesce(tsa_s < 45, false) as h, tsa_s from m),
    r as (select *, sum(case when h and not coalesce(lag_h, false) then 1 else 0 end) over (partition by line_id, leg order by i) as run from (select *, lag(h) over (partition by line_id, leg order by i) as lag_h from f)),
    q as (select line_id, leg, run, sum(w) as length from r where h group by all)
    select line_id, leg, round(coalesce(sum(w) filter (h), 0), 6) as length, round(100 * coalesce(sum(w) filter (h), 0) / sum(w) filter (tsa_s is not null), 6) as pct,
    round(coalesce((select max(length) from q where q.line_id = f.line_id and q.leg = f.leg), 0), 6) as longest from f group by line_id, leg"""
)
def a06_exceedance(spark, d):
    return rounded(V.exceedance(V.measured(adapted(spark, d, "samples"), near=True), ["line_id", "leg"], "tsa_s", 45.0, below=True))


@query(
    """with r as (select line_id, i, w, coalesce(z >= 300, false) as h, i - row_number() over (partition by line_id, coalesce(z >= 300, false) order by i) as island from samples),
    q as (select line_id, sum(w) as length from r where h group by line_id, island)
    select s.line_id, round(coalesce(max(length), 0), 6) as longest from (select distinct line_id from samples) s left join q using (line_id) group by s.line_id"""
)
def a07_longest_run(spark, d):
    return rounded(V.longest_run(adapted(spark, d, "samples"), ["line_id"], F.col("z") >= 300))


def _rate_sql(value: str, rubric, k: int) -> str:
    return "case" + "".join(f" when {value} >= {r[0]}e0 and {value} < {r[1]}e0 then {r[k]}e0" for r in rubric) + " end"


@query(
    f"""with {_MEASURED}, e as (select line_id, w, {_rate_sql('slope_s', V.SLOPE_RUBRIC, 2)} as sb, {_rate_sql('slope_s', V.SLOPE_RUBRIC, 3)} as sm, {_rate_sql('grade_s', V.GRADE_RUBRIC, 2)} as gb, {_rate_sql('grade_s', V.GRADE_RUBRIC, 3)} as gm from m)
    select line_id, round(coalesce(sum(w / sb), 0) + coalesce(sum(w / gb), 0), 4) as construct_days, round(coalesce(sum(w / sm), 0) + coalesce(sum(w / gm), 0), 4) as maintain_days,
    round(greatest(coalesce(sum(w) filter (sb is null), 0), coalesce(sum(w) filter (gb is null), 0)), 4) as unassessed_m from e group by line_id"""
)
def a08_effort(spark, d):
    return rounded(V.effort(_m(spark, d), ["line_id"]), 4)


def _legs(samples):
    kinds = F.array(*map(F.lit, ("existing", "new", "reroute", "restore")))
    return samples.select("line_id", "leg").distinct().withColumn("kind", F.get(kinds, F.col("leg") % 4)).withColumn("effort_factor", 1 + F.col("leg") / 10)


_LEG_SQL = f"""with {_MEASURED}, c as (select line_id, leg, z - lag(z) over (partition by line_id, leg order by i) as s from m where z is not null),
    cl as (select line_id, leg, coalesce(sum(s) filter (s > 0), 0) as climb from c group by all),
    b as (select line_id, leg, sum(w) as length_m, count(*) as samples, min(z) as z_min, max(z) as z_max, max(d) as d_end, quantile_cont(grade_s, 0.5) as grade_p50,
      coalesce(sum(w / ({_rate_sql('slope_s', V.SLOPE_RUBRIC, 2)})), 0) + coalesce(sum(w / ({_rate_sql('grade_s', V.GRADE_RUBRIC, 2)})), 0) as days,
      coalesce(sum(w / ({_rate_sql('slope_s', V.SLOPE_RUBRIC, 3)})), 0) + coalesce(sum(w / ({_rate_sql('grade_s', V.GRADE_RUBRIC, 3)})), 0) as keep,
      100 * sum(w) filter (z is not null) / sum(w) as coverage_pct from m group by all),
    l as (select b.*, coalesce(climb, 0) as climb, days * case when leg % 4 = 0 then 0 else 1 + leg / 10 end as construct_days from b left join cl using (line_id, leg))"""


@query(_LEG_SQL + " select line_id, leg, round(length_m, 6) as length_m, samples, round(climb, 4) as climb, z_min, z_max, round(d_end, 6) as d_end, round(grade_p50, 4) as grade_p50, round(construct_days, 4) as construct_days, round(keep, 4) as maintain_days, round(coverage_pct, 6) as coverage_pct from l")
def a09_leg_stats(spark, d):
    s = adapted(spark, d, "samples")
    out = V.leg_stats(s, _legs(s))
    four = ["climb", "grade_p50", "construct_days", "maintain_days"]
    return out.select("line_id", "leg", *[F.round(c, 6).alias(c) for c in ("length_m", "d_end", "coverage_pct")], "samples", "z_min", "z_max", *[F.round(c, 4).alias(c) for c in four])


@query(
    _LEG_SQL
    + """, e as (select line_id, arg_min(z, i) filter (z is not null) as a, arg_max(z, i) filter (z is not null) as b from samples group by line_id)
    select line_id, round(sum(length_m) filter (leg % 4 <> 0), 6) as build_m, round(sum(length_m) filter (leg % 4 = 0), 6) as existing_m, round(sum(construct_days), 3) as construct_days, round(sum(keep), 3) as maintain_days, any_value(b > a) as runs_uphill from l join e using (line_id) group by line_id"""
)
def a10_alignment_summary(spark, d):
    s = adapted(spark, d, "samples")
    out = V.alignment_summary(s, _legs(s))
    return out.select("line_id", *[F.round(c, 6).alias(c) for c in ("build_m", "existing_m")], *[F.round(c, 3).alias(c) for c in ("construct_days", "maintain_days")], "runs_uphill")


@query(
    _LEG_SQL
    + """, cs as (select line_id, zs - lag(zs) over (partition by line_id order by i) as s from m where zs is not null), ct as (select line_id, coalesce(sum(s) filter (s > 0), 0) as climb_m, coalesce(-sum(s) filter (s < 0), 0) as descent_m from cs group by 1),
    r as (select line_id, w, coalesce(grade_s >= 18, false) as h, i - row_number() over (partition by line_id, coalesce(grade_s >= 18, false) order by i) as island from m), q as (select line_id, sum(w) as x from r where h group by line_id, island), lr as (select line_id, max(x) as x from q group by 1),
    a as (select line_id, sum(length_m) filter (leg % 4 <> 0) as build_m, sum(length_m) filter (leg % 4 = 0) as existing_m, sum(construct_days) as construct_days, sum(keep) as maintain_days from l group by 1),
    t as (select line_id, sum(w) as length_m, min(z) as z_min, max(z) as z_max, quantile_cont(grade_s, 0.5) as grade_p50, quantile_cont(grade_s, 0.95) as grade_p95, 100 * coalesce(sum(w) filter (grade_s >= 18), 0) / sum(w) filter (grade_s is not null) as steep_pct, 100 * coalesce(sum(w) filter (grade_s >= 35), 0) / sum(w) filter (grade_s is not null) as very_steep_pct,
      100 * coalesce(sum(w) filter (tsa_s < 45), 0) / sum(w) filter (tsa_s is not null) as fall_line_pct, 100 * coalesce(sum(w) filter (slope_s >= 73), 0) / sum(w) filter (slope_s is not null) as heavy_slope_pct, 100 * coalesce(sum(w) filter (src = 1), 0) / sum(w) as lidar_pct, 100 * coalesce(sum(w) filter (z is not null), 0) / sum(w) as coverage_pct from m group by 1)
    select line_id, round(length_m, 4) as length_m, round(coalesce(build_m, 0), 4) as build_m, round(coalesce(existing_m, 0), 4) as existing_m, round(coalesce(climb_m, 0), 4) as climb_m, round(coalesce(descent_m, 0), 4) as descent_m, round(z_min, 4) as z_min, round(z_max, 4) as z_max, round(grade_p50, 4) as grade_p50, round(grade_p95, 4) as grade_p95,
    18e0 as steep_threshold, round(steep_pct, 4) as steep_pct, round(coalesce(x, 0), 4) as steep_longest_m, 35e0 as very_steep_threshold, round(very_steep_pct, 4) as very_steep_pct, 45e0 as fall_line_threshold, round(fall_line_pct, 4) as fall_line_pct, 73e0 as heavy_slope_threshold, round(heavy_slope_pct, 4) as heavy_slope_pct,
    round(construct_days, 4) as construct_days, round(maintain_days, 4) as maintain_days, round(lidar_pct, 4) as lidar_pct, round(coverage_pct, 4) as coverage_pct from t join a using (line_id) left join ct using (line_id) left join lr using (line_id)"""
)
def p09_headline(spark, d):
    s = adapted(spark, d, "samples")
    return rounded(V.headline_fields(s, _legs(s)), 4)


@query("select line_id, src, round(sum(w), 6) as length, round(100 * sum(w) / sum(sum(w)) over (partition by line_id), 6) as pct from samples group by line_id, src")
def a11_coverage_by_source(spark, d):
    return rounded(V.coverage_by_source(adapted(spark, d, "samples"), ["line_id"]))


@query("with n as (select *, count(*) over (partition by line_id) as n from samples) select line_id, i, round(d, 6) as d, round(z, 6) as z from n where i % ceil(n / 100) = 0 or i = n - 1")
def o05_downsample_profile(spark, d):
    return rounded(V.downsample_profile(adapted(spark, d, "samples"), 100).select("line_id", "i", "d", "z"))


@query(
    """with s as (select l_quantity as q, l_linenumber % 6 as k, l_orderkey % 4 as f, l_orderkey, l_partkey, l_suppkey, l_extendedprice from lineitem)
    select l_orderkey, l_partkey, l_suppkey, l_extendedprice, round(case when f = 3 then case when k = 4 then q * 0.9144 end else case k when 0 then q when 1 then q * 0.3048 when 2 then q * 1000 when 3 then q * 1609.344 when 4 then q * 0.9144 end end, 6) as metres,
    round(case when f = 1 and k = 1 then q * 0.3048 when f = 1 and k = 2 then q * 1000 when f = 1 and k = 3 then q * 1609.344 when f = 1 and k = 4 then q * 0.9144 end, 6) as rate, case f when 0 then q when 2 then -q end as share from s"""
)
def f07_length_m(spark, d):
    """Accepted spellings, and ones that are refused: other words for units, numbers with an exponent or without a digit in front."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    pick = lambda words, k: F.get(F.array(*map(F.lit, words)), k)
    q, k, f = F.col("l_quantity").cast("string"), F.col("l_linenumber") % 6, F.col("l_orderkey") % 4
    good, bad = pick(("", " ft", "km", " Miles", " yd", " parsecs"), k), pick(("e0", " yards", " kilometers", " miles.", "yd", "ft 2"), k)
    length = F.when(f == 3, F.concat(q, bad)).otherwise(F.concat(q, good))
    rate = F.when(f == 1, F.concat(length, F.lit(" / day"))).when(f == 2, F.concat(length, F.lit(" per day"))).otherwise(length)
    share = F.concat(pick(("", ".", "-", "1e"), f), q, pick((" %", "%", "", " % "), f))
    return rounded(li.select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", S.length_m(length).alias("metres"), S.rate_m_per_day(rate).alias("rate"), S.percent(share).alias("share")))


# --- tracks ---------------------------------------------------------------------

_STEP = "6371008.8 * sqrt(power(radians(lon - lag(lon) over w) * cos(radians((lat + lag(lat) over w) / 2)), 2) + power(radians(lat - lag(lat) over w), 2))"


@query(
    f"""with s as (select track_id, seq, coalesce({_STEP}, 0) as step from track_points window w as (partition by track_id order by seq))
    select track_id, seq, round(sum(step) over (partition by track_id order by seq), 4) as d from s where seq = 1 or step > 0"""
)
def w01_cumulative_distance(spark, d):
    return rounded(K.cumulative_distance(adapted(spark, d, "track_points")).select("track_id", "seq", "d"), 4)


@query(
    """select track_id, seq, coalesce(last_value(ele ignore nulls) over (partition by track_id order by seq), 0) as z from track_points"""
)
def w07_fill_elevation(spark, d):
    return adapted(spark, d, "track_points").select("track_id", "seq", K.fill_elevation().alias("z"))


@query(
    """select track_id, seq, cast(round_even(epoch_us(ts - first_value(ts) over (partition by track_id order by seq)) / 1e6, 0) as int) as seconds from track_points"""
    .replace("epoch_us(ts - first_value(ts) over (partition by track_id order by seq))", "(epoch_us(ts) - epoch_us(first_value(ts) over (partition by track_id order by seq)))")
)
def w08_relative_times(spark, d):
    return adapted(spark, d, "track_points").select("track_id", "seq", K.relative_times().alias("seconds"))


#: SQL: UTM of zone 5, by Krueger's series for WGS84; its numbers are written out, apart from the library's.
_SERIES = (8.37731820630352930e-04, 7.60852771424899765e-07, 1.19763800156052316e-09, 2.44337619452206371e-12)
_UTM = "e as (select *, sinh(atanh(sin(radians(lat))) - 8.18191908426214864e-02 * atanh(8.18191908426214864e-02 * sin(radians(lat)))) as tt, radians(lon + 153) as ll from track_points), g as (select *, atan2(tt, cos(ll)) as xi, asinh(sin(ll) / sqrt(tt * tt + cos(ll) * cos(ll))) as eta from e), "
_UTM += "utm as (select *, 500000 + 0.9996e0 * 6.36744914582341537e+06 * (eta" + "".join(f" + {a:.17e} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(_SERIES, 1)) + ") as x, "
_UTM += "0.9996e0 * 6.36744914582341537e+06 * (xi" + "".join(f" + {a:.17e} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(_SERIES, 1)) + ") as y from g)"


@query(f"with {_UTM} select track_id, round(sum(coalesce(l, 0)), 3) as length_m from (select track_id, sqrt(power(x - lag(x) over w, 2) + power(y - lag(y) over w, 2)) as l from utm window w as (partition by track_id order by seq)) group by track_id")
def a01_line_length(spark, d):
    return rounded(K.line_length(adapted(spark, d, "track_points")), 3)


@query(
    f"""with {_UTM}, f as (select track_id, seq, ts, ele, x, y, coalesce(last_value(ele ignore nulls) over (partition by track_id order by seq), 0) as z from utm),
    s as (select *, z - lag(z) over w as c, sqrt(power(x - lag(x) over w, 2) + power(y - lag(y) over w, 2)) as l from f window w as (partition by track_id order by seq))
    select track_id, count(*)::int as point_count, round(sum(coalesce(l, 0)), 4) as length_m, round(coalesce(sum(c) filter (c > 0), 0), 4) as climb_m, round(coalesce(-sum(c) filter (c < 0), 0), 4) as descent_m, min(ts) as taken_at, count(ele) > 0 as has_elevation from s group by track_id"""
)
def a03_track_summary(spark, d):
    return rounded(K.track_summary(adapted(spark, d, "track_points")), 4)


_ALONG = f"""p as (select track_id, seq, lon, lat, coalesce(last_value(ele ignore nulls) over (partition by track_id order by seq), 0) as z from track_points),
    s as (select *, coalesce({_STEP}, 0) as step from p window w as (partition by track_id order by seq)),
    a as (select *, sum(step) over (partition by track_id order by seq) as d from s where seq = 1 or step > 0),
    k as (select *, first_value(d) over r as fd, first_value(z) over r as fz, last_value(d) over r as td, last_value(z) over r as tz, lag(d) over o as pd, lag(z) over o as pz, lead(d) over o as nd, lead(z) over o as nz from a window r as (partition by track_id order by d range between 15 preceding and 15 following), o as (partition by track_id order by d)),
    h as (select *, case when pd < fd then pd else fd end as ld, case when pd < fd then pz else fz end as lz, case when nd > td then nd else td end as hd, case when nd > td then nz else tz end as hz from k),
    q as (select *, case when hd > ld then (hz - lz) / (hd - ld) * 100 end as grade from h)"""


@query(
    f"""with {_ALONG}, c as (select track_id, z - lag(z) over (partition by track_id order by seq) as m from a), u as (select track_id, coalesce(sum(m) filter (m > 0), 0) as climb, coalesce(-sum(m) filter (m < 0), 0) as descent from c group by 1)
    select track_id, round(max(d), 4) as length_m, min(z) as z_min, max(z) as z_max, round(max(struct_pack(a := abs(grade), g := grade)).g, 3) as max_grade, round(any_value(climb), 4) as climb, round(any_value(descent), 4) as descent from q join u using (track_id) group by track_id"""
)
def a13_quick_stats(spark, d):
    q = K.quick_stats(adapted(spark, d, "track_points"))
    return q.select("track_id", F.round("max_grade", 3).alias("max_grade"), *[F.round(c, 4).alias(c) for c in ("length_m", "climb", "descent", "z_min", "z_max")])


@query(f"with {_ALONG} select track_id, seq, round(grade, 3) + 0 as grade from q")
def w06_grade_in_range(spark, d):
    along = K.cumulative_distance(adapted(spark, d, "track_points").withColumn("z", K.fill_elevation()))
    return rounded(along.select("track_id", "seq", K.grade_in_range().alias("grade")), 3)


@query(
    """with u as (select line_id, d, z, d - avg(d) over (partition by line_id) as u from samples where z is not null and d between 1000 and 3000),
    f as (select line_id as track_id, count(*) as n, avg(z) as mean_z, regr_slope(z, d) as slope, sum(u) as s1, sum(u * u) as s2, sum(u * u * u) as s3, sum(u * u * u * u) as s4, sum(z) as t0, sum(u * z) as t1, sum(u * u * z) as t2 from u group by line_id),
    e as (select *, n * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2) as det, n * (s2 * t2 - t1 * s3) - s1 * (s1 * t2 - t1 * s2) + t0 * (s1 * s3 - s2 * s2) as quad from f)
    select track_id, n, round(mean_z, 4) as mean_z, round(100 * slope, 4) as slope_pct, round(case when n >= 3 and abs(det) > 1e-9 then 2000 * quad / det end, 4) as curvature from e"""
)
def a12_window_fit(spark, d):
    s = adapted(spark, d, "samples").filter("z is not null").withColumnRenamed("line_id", "track_id")
    return rounded(K.window_fit(s, 1000.0, 3000.0), 4)


@query(f"with {_UTM} select track_id, seq, (32600 + cast(floor((lon + 180) / 6) as int) % 60 + 1)::int as srid, round(x, 3) as x, round(y, 3) as y, true as returns from utm")
def f01_utm_round_trip(spark, d):
    """Every point to UTM and back, to a centimetre."""
    p = adapted(spark, d, "track_points").withColumn("srid", S.utm_srid(F.col("lon"), F.col("lat")))
    x, y = S.to_utm(F.col("lon"), F.col("lat"), F.col("srid"))
    p = p.withColumns({"x": x, "y": y})
    lon, lat = S.from_utm(F.col("x"), F.col("y"), F.col("srid"))
    return p.select("track_id", "seq", "srid", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), (S.equirect_m(lon, lat, F.col("lon"), F.col("lat")) < 0.01).alias("returns"))


@query(
    """select track_id, seq, floor((lon + 180) / 360 * 16384 * 256)::bigint as px,
    floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 16384 * 256)::bigint as py from track_points"""
)
def f03_lonlat_to_tile_px(spark, d):
    x, y = S.lonlat_to_tile_px(F.col("lon"), F.col("lat"), 14)
    return adapted(spark, d, "track_points").select("track_id", "seq", F.floor(x).alias("px"), F.floor(y).alias("py"))


@query(
    """with m as (select line_id, i, round(degrees(acos(least(abs(cos(heading - atan2(gy, gx))), 1))), 6) as t, sqrt(gx * gx + gy * gy) as g from samples)
    select line_id, i, (case when g * 100 < 3 then null else (t >= 45)::int + (t >= 60)::int + (t >= 68)::int end)::int as tsa_class from m"""
)
def p11_tsa_class(spark, d):
    s = adapted(spark, d, "samples")
    return s.select("line_id", "i", S.classify(F.round(S.tsa_deg(F.col("heading"), F.col("gx"), F.col("gy")), 6), S.TSA_BREAKS).alias("tsa_class"))
