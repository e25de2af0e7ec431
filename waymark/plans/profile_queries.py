"""Candidate lines, effort by sample, grids and settings over the adapted tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import settings as S
from ..functions.scalars import colour_ramp, curve_value
from ..operators import profiles as P
from ..operators import scoring as R
from ..operators import terrain as T
from .adapters import adapted, table
from .catalogue_queries import _GRID, _VERTICES, _VIEWS, _grid, _vertices, _views
from .registry import query, rounded
from .scoring_queries import _STACK, _stack

_MOVED = f"{_VERTICES}, m as (select line_id, seq, x + 0.1501 * (seq % 25) as x, y from v)"
_SEGMENTS = "select *, sqrt(power(x2 - x, 2) + power(y2 - y, 2)) as l from (select line_id, seq, x, y, lead(x) over (partition by line_id order by seq) as x2, lead(y) over (partition by line_id order by seq) as y2 from {t}) o where x2 is not null and (x <> x2 or y <> y2)"
_AWAY = "sqrt(power(p.x - s.x - t * (s.x2 - s.x), 2) + power(p.y - s.y - t * (s.y2 - s.y), 2))"
_PLACE = "greatest(0, least(1, ((p.x - s.x) * (s.x2 - s.x) + (p.y - s.y) * (s.y2 - s.y)) / (s.l * s.l)))"


def _near(points, lines):
    """SQL: least distance of each point (id, line_id, x, y) to the segments of its line."""
    return f"select id, line_id, min({_AWAY}) as away from (select p.id, p.line_id, p.x as px, p.y as py, s.x, s.y, s.x2, s.y2, {_PLACE} as t from {points} p join {lines} s on s.line_id = p.line_id) o group by id, line_id".replace(
        "sqrt(power(p.x - s.x - t * (s.x2 - s.x), 2) + power(p.y - s.y - t * (s.y2 - s.y), 2))", "sqrt(power(px - x - t * (x2 - x), 2) + power(py - y - t * (y2 - y), 2))"
    )


def _moved(spark, d):
    return _vertices(spark, d).drop("leg").withColumn("x", F.col("x") + 0.1501 * (F.col("seq") % 25))


@query(
    f"""with {_MOVED}, s as ({_SEGMENTS.format(t="v")}), k as ({_SEGMENTS.format(t="m")}), n as (select *, cast(greatest(1, ceil(l - 1e-9)) as bigint) as n from k), j as (select *, unnest(range(n + 1)) as j from n),
    p as (select row_number() over () as id, line_id, x + (x2 - x) * j / n as x, y + (y2 - y) * j / n as y from j), a as ({_near("p", "s")}) select line_id, max(away) > 3 as leaves from a group by line_id"""
)
def j07_leaves_trail(spark, d):
    return P.leaves_trail(_moved(spark, d), _vertices(spark, d).drop("leg"))


@query(
    f"""with {_MOVED}, s as ({_SEGMENTS.format(t="v")}), k as ({_SEGMENTS.format(t="m")}), p as (select seq as id, line_id, x, y from m), q as (select seq as id, line_id, x, y from v), a as ({_near("p", "s")}), b as ({_near("q", "k")}), u as (select * from a union all select * from b)
    select line_id, case when max(away) <= 3.5 then round(max(away), 6) end as apart, max(away) > 3.5 as jump from u group by line_id"""
)
def j20_lines_apart(spark, d):
    return rounded(P.lines_apart(_vertices(spark, d).drop("leg"), _moved(spark, d), 3.5))


_KAPPA = """with s as (select line_id, i, d, heading * 0.97e0 as a, d - lag(d) over w as back, lead(d) over w - d as ahead from samples window w as (partition by line_id order by i)), t as (select *, a - lag(a) over (partition by line_id order by i) as t from s),
    u as (select *, coalesce(case when t > pi() then t - 2 * pi() when t < -pi() then t + 2 * pi() else t end, 0) as t2 from t), v as (select *, t2 / back as before, lead(t2) over (partition by line_id order by i) / ahead as after from u),
    r as (select *, coalesce((before * ahead + after * back) / (back + ahead), before, after, 0) as raw from v) select line_id, i, round(avg(raw) over (partition by line_id order by i rows between 2 preceding and 2 following), 6) + 0 as kappa from r"""


@query(_KAPPA)
def w14_curvature(spark, d):
    return rounded(P.curvature(adapted(spark, d, "samples").withColumn("heading", F.col("heading") * 0.97)).select("line_id", "i", "kappa"))


@query("""with t as (select line_id, 0.02e0 + 0.73e0 * k / 7 as tube, 900 * (0.02e0 + 0.73e0 * k / 7) + sum(w * greatest(abs(gx) - 0.02e0 - 0.73e0 * k / 7, 0)) as total from samples, range(8) o(k) group by line_id, k), b as (select *, row_number() over (partition by line_id order by total, tube) as place from t) select line_id, round(tube, 6) as tube, round(total, 6) as total from b where place = 1""")
def o04_best_tube(spark, d):
    total = lambda t: t.groupBy("line_id", "tube").agg((900 * F.col("tube") + F.sum(F.col("w") * F.greatest(F.abs("gx") - F.col("tube"), F.lit(0.0)))).alias("total"))
    return rounded(P.best_tube(adapted(spark, d, "samples"), total))


_BENCHES = f"""with {_GRID}, p as (select o_orderkey as point_id, (o_custkey % 390) / 10e0 as x, o_orderkey / 300e0 as y, radians(o_orderkey % 360) as h from orders),
    q as (select point_id, n, x + 1.5e0 * (a * cos(h) - b * sin(h)) as x, y + 1.5e0 * (a * sin(h) + b * cos(h)) as y from p, (values ('g', 0, 0), ('l', 0, 1), ('r', 0, -1), ('f', 1, 0), ('b', -1, 0)) o(n, a, b)),
    e as (select point_id, n, case when count(z) = 4 then sum(z * (case when i = 1 then y - floor(y) else 1 - y + floor(y) end) * (case when j = 1 then x - floor(x) else 1 - x + floor(x) end)) end as z from q, (values (0, 0), (0, 1), (1, 0), (1, 1)) o(i, j) left join g on r = floor(y) + i and c = floor(x) + j group by point_id, n),
    f as (select point_id, max(z) filter (n = 'g') as g, max(z) filter (n = 'l') as l, max(z) filter (n = 'r') as r, max(z) filter (n = 'f') as f, max(z) filter (n = 'b') as b from e group by point_id),
    k as (select point_id, g as z, (coalesce(l, g) - coalesce(r, g)) / 3 as x, (coalesce(f, g) - coalesce(b, g)) / 3 as a from f) select point_id, round(z, 4) + 0 as z, round(x, 4) + 0 as "cross", round(a, 4) + 0 as along, round(100 * sqrt(x * x + a * a), 4) + 0 as side from k"""


@query(_BENCHES)
def c01_bench_slopes(spark, d):
    p = table(spark, d, "orders").select(F.col("o_orderkey").alias("point_id"), (F.col("o_custkey") % 390 / 10).alias("x"), (F.col("o_orderkey") / 300).alias("y"), F.radians(F.col("o_orderkey") % 360).alias("heading"))
    return rounded(T.bench_slopes(p, _grid(spark, d), 3.0), 4)


@query(
    """with f as (select line_id, d as s, abs(gx) as turn, 1 + w * 3 as r, i % 7 <> 0 as free from samples), m as (select line_id, d, i from samples where i % 4 = 0), e as (select line_id, max(i) as e from m group by 1), n as (select f.line_id, f.s, min(m.i) as i from f left join m on m.line_id = f.line_id and m.d >= f.s - 10 group by f.line_id, f.s), o as (select f.*, coalesce(n.i, e) as i from f join n on n.line_id = f.line_id and n.s = f.s join e on e.line_id = f.line_id),
    b as (select line_id, i, sum(case when free then turn / (pi() / 2) * case when r <= 3 then 8 when r <= 40 then exp(ln(8) + (ln(0.5) - ln(8)) * (r - 3) / 37) when r <= 100 then exp(ln(0.5) + (ln(0.01) - ln(0.5)) * (r - 40) / 60) else 0.01 end else 0 end) as bends, min(r) as bend_r from o group by all)
    select m.line_id, m.i, round(coalesce(bends, 0), 6) as bends, round(coalesce(bend_r, 10000), 6) as bend_r from m left join b on b.line_id = m.line_id and b.i = m.i"""
)
def c07_bend_charge(spark, d):
    s = adapted(spark, d, "samples")
    fine = s.select("line_id", F.col("d").alias("s"), F.abs("gx").alias("turn"), (1 + F.col("w") * 3).alias("radius"), (F.col("i") % 7 != 0).alias("free"))
    return rounded(P.bend_charge(fine, s.filter("i % 4 = 0"), curve_value(F.col("radius"), [(3, 8), (40, 0.5), (100, 0.01)]), 20.0))


_FACTORS = "w * sqrt(1 + gx * gx) as sl, case when gx = 0 then 0.1 when abs(gx) * 100 <= 10 then exp(ln(0.1) + (ln(10) - ln(0.1)) * abs(gx) * 10) else 10 end as grade, gy * gy * 8 as bends, w * 0.01e0 as climbs"


def _charged(spark, d):
    s = adapted(spark, d, "samples")
    return s.withColumns({"sl": F.col("w") * F.sqrt(1 + F.col("gx") * F.col("gx")), "bends": F.col("gy") * F.col("gy") * 8, "climbs": F.col("w") * 0.01, "x": F.col("gx") * 100, "y": F.col("gy") * 100, "bend_r": F.col("w") * 30}), {"grade": curve_value(F.abs("gx") * 100, [(0, 0.1), (10, 10)])}


@query(
    f"""with s as (select *, {_FACTORS} from samples), k as (select line_id, i as a, i + 3 as b, w / 10 as v from samples where i % 3 = 0), h as (select s.line_id, s.i, sum(7 * v / (b - a + 1)) as share from s join k on k.line_id = s.line_id and s.i between a and b group by all)
    select s.line_id, s.i, round(sl + 2 * grade * sl + 3 * bends + 1.5e0 * climbs + coalesce(share, 0), 6) as density from s left join h on h.line_id = s.line_id and h.i = s.i"""
)
def c10_effort_density(spark, d):
    s, values = _charged(spark, d)
    corners = s.filter("i % 3 = 0").select("line_id", F.col("i").alias("a"), (F.col("i") + 3).alias("b"), (F.col("w") / 10).alias("value"))
    return rounded(P.effort_density(s, values, {"grade": 2, "bend": 3, "climb": 1.5, "corner": 7}, corners))


@query(f"with s as (select *, {_FACTORS} from samples) select line_id, i, round(gx * 100, 2) + 0 as x, round(gy * 100, 2) + 0 as y, round(least(w * 30, 1000), 2) as bend, round(2 * grade, 4) as cost_grade, round(3 * bends / greatest(w, 1e-6), 4) as cost_bend, round(1.5e0 * climbs / greatest(w, 1e-6), 4) as cost_climb from s")
def c12_factor_tracks(spark, d):
    s, values = _charged(spark, d)
    return rounded(P.factor_tracks(s, values, {"grade": 2, "bend": 3, "climb": 1.5}))


_SITES = """with recursive b as (select *, coalesce(z, 0) as g from samples), l as (select line_id, max(d) as e from b group by 1), q as (select b.line_id, i, d, g, w * 10 as zd, greatest(d - 60, 0) as qa, least(d + 60, e) as qb from b join l using (line_id)),
    y as (select line_id, d as d0, g as g0, lead(d) over w as d1, lead(g) over w as g1 from b window w as (partition by line_id order by d)), za as (select q.line_id, q.i, g0 + (g1 - g0) * (qa - d0) / (d1 - d0) as za, row_number() over (partition by q.line_id, q.i order by d0) as k from q join y on y.line_id = q.line_id and qa >= d0 and qa <= d1),
    zb as (select q.line_id, q.i, g0 + (g1 - g0) * (qb - d0) / (d1 - d0) as zb, row_number() over (partition by q.line_id, q.i order by d0) as k from q join y on y.line_id = q.line_id and qb >= d0 and qb <= d1),
    f as (select q.*, g - (za + zb) / 2 as e, max(zd) over (partition by q.line_id order by d range between 60 preceding and current row) as lo, max(zd) over (partition by q.line_id order by d range between current row and 60 following) as hi from q join za on za.line_id = q.line_id and za.i = q.i and za.k = 1 join zb on zb.line_id = q.line_id and zb.i = q.i and zb.k = 1),
    h as (select *, lag(zd) over w as zp, lead(zd) over w as zn, lag(e) over w as ep, lead(e) over w as en from f window w as (partition by line_id order by i)), s as (select line_id, d from h where (zd - zp < -1e-6 and zn - zd >= -1e-6 and least(lo, hi) - zd >= 300) or (e < -300 and e <= ep and e <= en)),
    n as (select a.line_id, a.d, min(c.d) as nd from s a left join s c on c.line_id = a.line_id and c.d >= a.d + 90 group by a.line_id, a.d), r(line_id, d) as (select line_id, min(d) from s group by line_id union all select n.line_id, n.nd from r join n on n.line_id = r.line_id and n.d = r.d where n.nd is not null) select line_id, d from r"""


@query(_SITES)
def c05_reversal_sites(spark, d):
    s = adapted(spark, d, "samples").withColumns({"z": F.coalesce("z", F.lit(0.0)), "zd": F.col("w") * 10})
    return P.reversal_sites(s, 300.0, 60.0, 90.0)


@query(None)
def c06_height_lost(spark, d):
    return P.height_lost(adapted(spark, d, "samples"), 50.0)


@query(None)
def c02_design_profile(spark, d):
    s = adapted(spark, d, "samples")
    return rounded(P.design_profile(s.withColumns({"low": F.col("z") - 1 - F.abs("gx") * 100, "high": F.col("z") + 1 + F.abs("gy") * 100})))


@query(None)
def l08_split_at_joints(spark, d):
    v = _vertices(spark, d).drop("leg")
    joints = _moved(spark, d).filter("seq % 9 = 5").select("line_id", F.col("seq").alias("joint"), "x", "y")
    return P.split_at_joints(v, joints)


@query(
    f"""with {_MOVED}, o as (select line_id, (seq // 10)::int as leg, seq, x, y, case when seq // 10 % 2 = 0 then 'existing' else 'new' end as kind from v), e as (select o.line_id, o.leg, o.seq, case when o.leg between 1 and 3 and kind = 'existing' and o.leg = 2 then 'reroute' else kind end as kind, case when o.leg between 1 and 3 and o.seq not in (10, f) then m.x else o.x end as x, o.y
    from o join m on m.line_id = o.line_id and m.seq = o.seq join (select line_id, max(seq) filter (leg = 3) as f from o group by line_id) k on k.line_id = o.line_id) select line_id, leg, seq, kind, round(x, 6) as x, round(y, 6) as y from e"""
)
def l12_apply_candidate(spark, d):
    leg = (F.col("seq") / 10).cast("int")
    v = _vertices(spark, d).withColumn("leg", leg).withColumn("kind", F.when(F.col("leg") % 2 == 0, "existing").otherwise("new"))
    picked = v.select("line_id", F.lit(1).alias("first"), F.lit(3).alias("last")).distinct()
    leaving = v.filter("leg = 2").select("line_id", "leg", F.lit(True).alias("leaves")).distinct()
    return rounded(P.apply_candidate(v, _moved(spark, d).withColumn("leg", leg), picked, leaving))


@query(
    f"""with {_MOVED}, o as (select line_id, (seq // 10)::int as leg, seq, x, y, case when seq // 10 % 2 = 0 then 'existing' else 'new' end as kind from v), e as (select o.line_id, o.leg, o.seq, case when o.leg between 1 and 3 and kind = 'existing' and o.leg = 2 then 'reroute' else kind end as kind, case when o.leg between 1 and 3 and o.seq not in (10, f) then m.x else o.x end as x, o.y
    from o join m on m.line_id = o.line_id and m.seq = o.seq join (select line_id, max(seq) filter (leg = 3) as f from o group by line_id) k on k.line_id = o.line_id)
    select line_id, leg, seq, kind, round(x, 6) as x, round(y, 6) as y from e where line_id % 4 <> 1 and line_id % 4 <> 2 union all select line_id, null, null, case line_id % 4 when 1 then 'the legs have changed' else 'not signed' end, null, null from (select distinct line_id from o) where line_id % 4 in (1, 2)"""
)
def l12_apply_if_unchanged(spark, d):
    """Candidates for lines of which some have changed since and some were never signed; refusals are rows with their reason."""
    v = _vertices(spark, d).withColumn("leg", (F.col("seq") / 10).cast("int")).withColumns({"kind": F.when((F.col("seq") / 10).cast("int") % 2 == 0, "existing").otherwise("new"), "lon": F.col("x") / 56000, "lat": F.col("y") / 111000})
    k = F.col("line_id") % 4
    signed = R.legs_signature(v.withColumn("lat", F.when((k == 1) & (F.col("seq") == 1), F.col("lat") + 0.001).otherwise(F.col("lat")))).filter(k != 2)
    picked = v.select("line_id", F.lit(1).alias("first"), F.lit(3).alias("last")).distinct()
    leaving = v.filter("leg = 2").select("line_id", "leg", F.lit(True).alias("leaves")).distinct()
    made, refused = P.apply_if_unchanged(v, _moved(spark, d).withColumn("leg", (F.col("seq") / 10).cast("int")), picked, leaving, signed)
    none = lambda n: F.lit(None).cast(dict(made.dtypes)[n]).alias(n)
    return rounded(made.unionByName(refused.select("line_id", none("leg"), none("seq"), F.col("reason").alias("kind"), none("x"), none("y"))))


@query(
    f"""{_STACK.split(", p as")[0]}, p as (select distinct r // 2 as wr, c // 2 as wc from g), q as (select wr, wc, a * 2 + b as k, source, wc * 2 + b - 0.5e0 as u, wr * 2 + a - 0.5e0 as v from p, (values ('a'), ('b')) s(source), (values (0, 0), (0, 1), (1, 0), (1, 1)) o(a, b)),
    e as (select wr, wc, k, q.source, sum(z * (case when i = 1 then v - floor(v) else 1 - v + floor(v) end) * (case when j = 1 then u - floor(u) else 1 - u + floor(u) end)) as z, count(z) as n from q, (values (0, 0), (0, 1), (1, 0), (1, 1)) o(i, j), cells where cells.source = q.source and r = floor(v) + i and c = floor(u) + j group by all),
    f as (select *, row_number() over (partition by wr, wc, k order by source) as place from e where n = 4) select wr as r, wc as c, round(avg(z), 6) as z, max(source) filter (k = 0) as source from p left join (select * from f where place = 1) f using (wr, wc) group by wr, wc"""
)
def g02_build_grid(spark, d):
    p, cells = _stack(spark, d)
    wanted = _grid(spark, d).select((F.col("r") / 2).cast("int").alias("r"), (F.col("c") / 2).cast("int").alias("c")).distinct().withColumn("sources", F.array(F.lit("a"), F.lit("b")))
    return rounded(T.build_grid(wanted, cells, 2.0, 2))


@query(
    f"""with {_VERTICES}, {_GRID}, s as ({_SEGMENTS.format(t="v")}), p as (select r, c, c * 5e0 as x, r * 5e0 as y from g where z is not null), n as (select p.r, p.c, p.x as px, p.y as py, s.x, s.y, s.x2, s.y2, {_PLACE} as t from p cross join s),
    m as (select r, c, min(sqrt(power(px - x - t * (x2 - x), 2) + power(py - y - t * (y2 - y), 2))) as a from n group by r, c) select p.r, p.c, round(a, 6) as distance from p left join m on m.r = p.r and m.c = p.c"""
)
def g07_distance_field(spark, d):
    return rounded(T.distance_field(_grid(spark, d), _vertices(spark, d).drop("leg"), res=5.0))


# The wetness colours, said here apart from the library's own.
_RED = "when t <= 6 then 198 when t <= 7 then 198 - 38 * (t - 6) when t <= 9 then 160 - 81 * (t - 7) / 2 when t <= 12 then 79 - 48 * (t - 9) / 3 when t <= 14 then 31 - 20 * (t - 12) / 2 else 11"
_GREEN = "when t <= 6 then 233 when t <= 7 then 233 - 18 * (t - 6) when t <= 9 then 215 - 52 * (t - 7) / 2 when t <= 12 then 163 - 68 * (t - 9) / 3 when t <= 14 then 95 - 53 * (t - 12) / 2 else 42"
_BLUE = "when t <= 6 then 245 when t <= 7 then 245 - 5 * (t - 6) when t <= 9 then 240 - 23 * (t - 7) / 2 when t <= 12 then 217 - 26 * (t - 9) / 3 when t <= 14 then 191 - 63 * (t - 12) / 2 else 128"
_ALPHA = "when t <= 6 then 0 when t <= 7 then 90 * (t - 6) when t <= 9 then 90 + 60 * (t - 7) / 2 when t <= 12 then 150 + 55 * (t - 9) / 3 when t <= 14 then 205 + 25 * (t - 12) / 2 else 230"


def _ramp(k):
    """SQL: one channel of the wetness colours at t."""
    return f"cast(round_even(case when t is null then 0 {(_RED, _GREEN, _BLUE, _ALPHA)[k - 1]} end, 0) as int)"


@query(f"select p_partkey, p_size, {_ramp(1)} as red, {_ramp(2)} as green, {_ramp(3)} as blue, {_ramp(4)} as alpha from (select p_partkey, p_size, case when p_size > 3 then p_size / 3e0 + p_partkey % 7 / 8e0 end as t from part) o")
def f13_colour_ramp(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size", colour_ramp(F.when(F.col("p_size") > 3, F.col("p_size") / 3 + F.col("p_partkey") % 7 / 8).when(F.col("p_size") == 3, F.lit(float("nan")))).alias("p"))
    return p.select("p_partkey", "p_size", *[F.col(f"p.{k}").alias(n) for k, n in zip("rgba", ("red", "green", "blue", "alpha"), strict=True)])


@query(f"with {_GRID}, {_VIEWS} select view_id, r, c, {_ramp(1)} as red, {_ramp(2)} as green, {_ramp(3)} as blue, {_ramp(4)} as alpha from (select view_id, r, c, z / 70e0 - 7 as t from g join w on c between c0 and c0 + 15 and r between r0 and r0 + 10) o")
def g08_wet_overlay(spark, d):
    return T.wet_overlays(_grid(spark, d).withColumn("twi", F.col("z") / 70 - 7), "twi", _views(spark, d), 5.0)[0]


_PX = "select track_id, seq, (lon + 180) / 360 * 1048576e0 - 0.5e0 as u, (0.5e0 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi())) * 1048576e0 - 0.5e0 as v from track_points"


@query(
    f"""with {_GRID}, px as (select 83895 + c as gx, 306682 + r as gy, z from g), q as ({_PX}), e as (select track_id, seq, case when count(z) = 4 then sum(z * (case when i = 1 then v - floor(v) else 1 - v + floor(v) end) * (case when j = 1 then u - floor(u) else 1 - u + floor(u) end)) end as z
    from q, (values (0, 0), (0, 1), (1, 0), (1, 1)) o(i, j) left join px on gx = floor(u) + j and gy = floor(v) + i group by track_id, seq) select track_id, seq, round(z, 3) as z from e"""
)
def j03_sample_xyz_tiles(spark, d):
    g = _grid(spark, d).select((F.lit(83895) + F.col("c")).alias("gx"), (F.lit(306682) + F.col("r")).alias("gy"), "z")
    pixels = g.select(F.floor(F.col("gx") / 256).alias("tx"), F.floor(F.col("gy") / 256).alias("ty"), (F.col("gx") % 256).alias("px"), (F.col("gy") % 256).alias("py"), "z")
    points = adapted(spark, d, "track_points").select(F.struct("track_id", "seq").alias("point_id"), "lon", "lat")
    return rounded(T.sample_xyz_tiles(points, pixels, 12).select("point_id.track_id", "point_id.seq", "z"), 3)


@query(
    """with n as (select l_orderkey as id, list({'x': l_quantity::double, 'y': case when l_tax = 0.08 then 0 when l_tax = 0.07 then 20000 else l_tax::double end} order by l_linenumber, l_partkey, l_suppkey) as c from lineitem where l_quantity > l_linenumber * 6 group by 1),
    e as (select id, ['grade', 'slope', 'length', 'mood'][1 + id % 4] as name, len(c) as n, case when id % 4 = 2 then null when id % 4 = 3 then 'unknown' when id % 11 = 0 then 'weight' when len(c) not between 2 and 9 then 'nodes' when len(list_filter(c, lambda p: p.y > 10000)) > 0 then 'value' when len(list_filter(range(2, len(c) + 1), lambda k: c[k].x < c[k - 1].x)) > 0 then 'order' end as error from n) select id, name, n, error from e"""
)
def p16_clean_factor_settings(spark, d):
    y = F.expr("case when l_tax = 0.08 then 0 when l_tax = 0.07 then 20000 else cast(l_tax as double) end").cast("double")
    nodes = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("double").alias("x"), y.alias("y"))))
    rows = table(spark, d, "lineitem").filter("l_quantity > l_linenumber * 6").groupBy(F.col("l_orderkey").alias("id")).agg(nodes.alias("c"))
    name = F.element_at(F.array(*[F.lit(n) for n in ("grade", "slope", "length", "mood")]), (1 + F.col("id") % 4).cast("int"))
    rows = rows.select("id", name.alias("name"), F.size("c").cast("long").alias("n"), F.transform("c", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("c"))
    return rows.select("id", "name", "n", S.factor_error(F.col("name"), F.when(F.col("id") % 11 == 0, 10001.0).otherwise(5.0), F.col("c"), ["grade", "slope"]).alias("error"))


@query("select l_orderkey as id, l_linenumber as n, case when l_quantity < 3 then 0 else round(pi() * l_extendedprice / (l_quantity - 2) * (case when l_linenumber % 2 = 0 then 1e0 else 100e0 end), 4) end as k from (select l_orderkey, l_linenumber, l_quantity::double as l_quantity, l_extendedprice::double as l_extendedprice from lineitem) o")
def p17_upgrade_settings(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), S.upgraded_weight(F.pi() * F.col("l_extendedprice").cast("double"), F.col("l_quantity").cast("double") - 2, F.col("l_linenumber") % 2 == 0).alias("k"))


@query(None)
def l03_adaptive_resample(spark, d):
    """Every line, closer where it turns."""
    return rounded(P.adaptive_resample(_vertices(spark, d).drop("leg"), 4.0), 4)
