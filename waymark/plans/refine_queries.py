"""Full scoring, corners, wetness, tiles, sources and the trail network over the adapted tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import assembly as A
from ..operators import lines as L
from ..operators import network as N
from ..operators import profiles as P
from ..operators import refine as R
from ..operators import routing as G
from ..operators import terrain
from ..operators import tiles as T
from ..operators import wetness as W
from ..operators.rounds import settled, shuffled
from ..sources import dem_catalog
from .adapters import adapted, table
from .catalogue_queries import _GRID, _VERTICES, _grid, _vertices
from .registry import query, rounded

_CURVES = {
    "grade": [(0, 0.1), (10, 1), (20, 10)], "slope": [(0, 1), (40, 3)], "cutfill": [(-2, 8), (0, 0), (3, 5)], "drainage": [(0, 0.1), (200, 4)],
    "wet": [(4, 0), (9, 2)], "tsa": [(0, 5), (60, 0.5)], "existing": [(0, 0.01), (10, 3)], "falltread": [(0, 4), (8, 0.2), (20, 6)], "climb": [(0, 1), (20, 3)], "corner": [(2, 20), (30, 1)],
}


def _curve_sql(x, curve):
    """SQL: the log-linear curve at x."""
    text = {True: "0.01e0"}
    at = lambda p: f"ln({text.get(p[1] <= 0, str(float(p[1])) + 'e0')})"
    out = f"case when {x} is null then null when {x} <= {curve[0][0]} then exp({at(curve[0])})"
    for p, q in zip(curve, curve[1:]):
        out += f" when {x} <= {q[0]} then exp({at(p)} + ({at(q)} - {at(p)}) * ({x} - ({p[0]})) / {q[0] - p[0]}e0)"
    return out + f" else exp({at(curve[-1])}) end"


_GRADE = """k as (select *, sum(coalesce(m, 0)) over (partition by line_id order by i) as c from (select line_id, i, d, z, abs(z - lag(z) over (partition by line_id order by i)) as m, max(d) over (partition by line_id) as e from samples where z is not null)),
    y as (select line_id, d as d0, c as c0, lead(d) over w as d1, lead(c) over w as c1 from k window w as (partition by line_id order by i)), q as (select line_id, i, greatest(d - 60, 0) as lo, least(d + 60, e) as hi from k),
    a as (select q.line_id, q.i, q.lo, case when y.d0 is null then f.c else case when d1 is null then c0 else c0 + (c1 - c0) * (lo - d0) / (d1 - d0) end end as ca from q left join (select line_id, min_by(c, d) as c from k group by 1) f using (line_id) asof left join y on y.line_id = q.line_id and q.lo >= y.d0),
    b as (select q.line_id, q.i, q.hi, case when d1 is null then c0 else c0 + (c1 - c0) * (hi - d0) / (d1 - d0) end as cb from q asof left join y on y.line_id = q.line_id and q.hi >= y.d0)"""


@query(f"with {_GRADE} select a.line_id, a.i, round(100 * (cb - ca) / greatest(hi - lo, 1e-6), 5) + 0 as grade from a join b using (line_id, i)")
def w11_grade_10m(spark, d):
    return rounded(R.grade_10m(adapted(spark, d, "samples"), "z", 60.0), 5)


@query(f"""with p as (select p_partkey, p_size / 20e0 as cut from part), x as (select x, max({_curve_sql('x', _CURVES['cutfill'])}) over (order by x) as m from (select 3 * k / 400e0 as x from range(401) o(k)))
    select p_partkey, cut, round(coalesce(max(x) filter (m <= c + 1e-12), 0), 6) as fill from (select *, {_curve_sql('(-cut)', _CURVES['cutfill'])} as c from p) cross join x group by p_partkey, cut""")
def f09_fill_for(spark, d):
    cut = F.col("p_size") / 20
    return rounded(table(spark, d, "part").select("p_partkey", cut.alias("cut"), R.fill_for(cut, _CURVES["cutfill"]).alias("fill")))


_FACTS = "select *, abs(gx) * 100 as grade, abs(gy) * 100 as side, gx * 5 as cutfill, w * 4 as run, case when i % 5 = 0 then null else w / 4 end as wet, degrees(atan2(abs(gy), abs(gx) + 0.01)) as tsa, w / 5 as off, coalesce(z, 0) as zd from samples"


def _facts(spark, d):
    s = adapted(spark, d, "samples")
    return s.withColumns({"grade": F.abs("gx") * 100, "side": F.abs("gy") * 100, "cutfill": F.col("gx") * 5, "run": F.col("w") * 4, "wet": F.when(F.col("i") % 5 != 0, F.col("w") / 4), "tsa": F.degrees(F.atan2(F.abs("gy"), F.abs("gx") + 0.01)), "off": F.col("w") / 5, "zd": F.coalesce("z", F.lit(0.0))})


_VALUES = ", ".join(f"{_curve_sql(c if n not in ('wet', 'existing') else f'coalesce({c}, 0)', _CURVES[n])} as v_{n}" for n, c in R.READS.items()) + f", case when tsa < 30 then {_curve_sql('grade', _CURVES['falltread'])} else 0 end as v_falltread"
_V_NAMES = [f"v_{n}" for n in (*R.READS, "falltread")]


@query(f"with f as ({_FACTS}), v as (select line_id, i, {_VALUES} from f) select line_id, i, {', '.join(f'round({n}, 5) as {n}' for n in _V_NAMES)} from v")
def c08_factor_values(spark, d):
    return rounded(R.factor_values(_facts(spark, d), _CURVES, 30.0).select("line_id", "i", *_V_NAMES), 5)


_K = {"grade": 2.0, "slope": 0.5, "cutfill": 1.0, "drainage": 0.3, "wet": 0.7, "tsa": 0.2, "existing": 0.4, "falltread": 1.1, "bend": 3.0, "climb": 1.5, "corner": 7.0, "length": 1.0}


@query(
    f"""with f as ({_FACTS}), v as (select line_id, i, d, zd, grade, gy * gy as bends, w / 90 as climbs, {_VALUES} from f), h as (select *, sum(coalesce(m, 0)) over (partition by line_id order by i) as s from (select *, sqrt(power(d - lag(d) over w, 2) + power(zd - lag(zd) over w, 2)) as m from v window w as (partition by line_id order by i))),
    u as (select *, coalesce((lead(s) over w - lag(s) over w) / 2, lead(s) over w - s, s - lag(s) over w, 0) as sl from h window w as (partition by line_id order by i)), k as (select line_id, sum({_curve_sql('r', _CURVES['corner'])}) as corner from (select line_id, w as r from samples where i % 40 = 3) group by 1),
    a as (select line_id, {', '.join(f'sum(coalesce({n}, 0) * sl) as {n[2:]}' for n in _V_NAMES)}, sum(bends) as bend, sum(climbs) as climb, max(s) as length, max(grade) as top from u group by 1),
    b as (select a.* replace (a.grade + 30 * {_curve_sql('top', _CURVES['grade'])} + case when top > 25 then (top - 25) / 10 * 100 else 0 end as grade), coalesce(corner, 0) as corner from a left join k using (line_id)), c as (select *, {' + '.join(f'{k} * {n}' for n, k in _K.items())} as total from b)
    select line_id, factor, round(cost, 2) as cost, round(cost * case factor {' '.join(f"when '{n}' then {k}" for n, k in _K.items())} else 1 end, 2) as contribution from (unpivot (select * exclude (top) from c) on columns(* exclude (line_id)) into name factor value cost)"""
)
def c09_line_costs(spark, d):
    s = R.factor_values(_facts(spark, d), _CURVES, 30.0).withColumns({"bends": F.col("gy") * F.col("gy"), "climbs": F.col("w") / 90})
    corners = s.filter("i % 40 = 3").select("line_id", F.col("w").alias("r"))
    return rounded(R.line_costs(s, corners, _CURVES, _K, 30.0, 25.0), 2)


@query(
    f"""with f as ({_FACTS}), w as (select line_id, unnest([{{'a': 0, 'b': 900}}, {{'a': 500, 'b': 4000}}, {{'a': 3000, 'b': 3001}}], recursive := true) from (select distinct line_id from samples)), s as (select f.*, a, b, zd - lag(zd) over (partition by f.line_id, a order by i) as m from f join w on w.line_id = f.line_id and d between a and b)
    select line_id, a::double as d0, b::double as d1, round(sum(w), 4) as metres, round(coalesce(sum(greatest(m, 0)), 0), 4) as climb, round(coalesce(sum(greatest(-m, 0)), 0), 4) as descent, round(max(grade), 4) as grade, round(sum(w * run), 4) as effort_run, round(sum(w * coalesce(wet, 0)), 4) as effort_wet, round(sum(w) + sum(w * run) + sum(w * coalesce(wet, 0)), 4) as total from s group by line_id, a, b"""
)
def a16_window_effort(spark, d):
    s = _facts(spark, d)
    windows = s.select("line_id").distinct().select("line_id", F.explode(F.array(*[F.struct(F.lit(float(a)).alias("d0"), F.lit(float(b)).alias("d1")) for a, b in ((0, 900), (500, 4000), (3000, 3001))])).alias("w")).select("line_id", "w.*")
    return rounded(R.window_effort(s, windows, ["run", "wet"]), 4)


def _curving(spark, d):
    """Track points as scored lines: sides from their own coordinates."""
    v = P.curvature(_headed(_vertices(spark, d)).withColumnRenamed("theta", "turned"), 3).withColumnRenamed("turned", "theta")
    x, y = F.col("x") / 40, F.col("y") / 40
    cross, along = F.sin(x + F.col("d") / 90), F.cos(y)
    return v.withColumns({"s_cross": cross, "s_along": along, "tsa": F.degrees(F.atan2(F.abs(cross), F.abs(along))), "side": 100 * F.hypot(cross, along), "bend_r": F.least(1 / F.greatest(F.abs("kappa"), F.lit(1e-3)), F.lit(1000.0))})


def _headed(v):
    """(line_id, i, d, x, y, heading, theta) of vertices."""
    w = Window.partitionBy("line_id").orderBy("seq")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    step = F.coalesce(F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), F.lit(0.0))
    s = v.withColumn("step", step).filter("step > 0 or seq = 1").withColumn("d", F.sum("step").over(upto)).withColumn("i", F.row_number().over(w) - 1)
    s = s.withColumn("heading", F.atan2(F.coalesce(F.lead("y").over(w), F.col("y")) - F.coalesce(F.lag("y").over(w), F.col("y")), F.coalesce(F.lead("x").over(w), F.col("x")) - F.coalesce(F.lag("x").over(w), F.col("x"))))
    turn = F.col("heading") - F.lag("heading").over(w)
    turn = F.when(turn > F.pi(), turn - 2 * F.pi()).when(turn < -F.pi(), turn + 2 * F.pi()).otherwise(turn)
    return s.withColumn("theta", F.sum(F.coalesce(turn, F.lit(0.0))).over(upto)).select("line_id", "i", "d", "x", "y", "heading", "theta")


@query(None)
def c04_corners(spark, d):
    return rounded(R.corners(_curving(spark, d), 0.1, 30.0))


@query(None)
def c03_dig_corners(spark, d):
    s = _curving(spark, d).withColumns({"z": F.col("x") / 3 + F.sin(F.col("d") / 30) * 4, "zd": F.col("x") / 3})
    return rounded(R.dig_corners(s, R.corners(s, 0.1, 30.0), _CURVES, _K, 3.0, 30.0))


_WAVES = f"{_GRID}, gr as (select r, c, z::double + sin(c / 3e0) * 60 as z from g where z is not null)"


@query(
    f"""with recursive {_WAVES}, nb as (select a.r, a.c, a.z, b.r as nr, b.c as nc from gr a join gr b on b.r between a.r - 1 and a.r + 1 and b.c between a.c - 1 and a.c + 1 and (a.r <> b.r or a.c <> b.c)),
    sh as (select r, c, z from gr except select r, c, z from nb group by r, c, z having count(*) = 8),
    fl(r, c, f) using key (r, c) as (select r, c, z from sh union select t.r, t.c, t.f from (select n.r, n.c, min(case when n.z > w.f then n.z else w.f + 1e-4::double end) as f from fl w join nb n on n.nr = w.r and n.nc = w.c group by all) t left join recurring.fl k on k.r = t.r and k.c = t.c where k.f is null or t.f < k.f)
    select gr.r, gr.c, round(gr.z, 6) as z, round(fl.f, 6) as filled from gr left join fl on fl.r = gr.r and fl.c = gr.c"""
)
def g05_fill_pits(spark, d):
    """Tiles of sixteen cells, so that pits lie across borders."""
    return rounded(W.fill_pits(_grid(spark, d).withColumn("z", F.col("z").cast("double") + F.sin(F.col("c") / 3) * 60), 16))


@query(None)
def g05_twi(spark, d):
    return rounded(W.twi(_grid(spark, d).withColumn("z", F.col("z").cast("double") + F.sin(F.col("c") / 3) * 60), 5.0, 32, 30), 5)


_MERCATOR = "(lon + 180) / 360 * n as u, (0.5e0 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi())) * n as v"


@query(
    f"""with k as (select track_id as line_id, seq, z, {_MERCATOR} from (select *, power(2, z) * 4096 as n from track_points, (values (5), (14), (17)) o(z))), s as (select * from (select *, lead(u) over w as u2, lead(v) over w as v2 from k window w as (partition by line_id, z order by seq)) where u2 is not null),
    t as (select *, u - tx * 4096 as x0, v - ty * 4096 as y0, u2 - u as dx, v2 - v as dy from (select *, unnest(range(floor((least(v, v2) - 64) / 4096)::bigint, floor((greatest(v, v2) + 64) / 4096)::bigint + 1)) as ty from (select *, unnest(range(floor((least(u, u2) - 64) / 4096)::bigint, floor((greatest(u, u2) + 64) / 4096)::bigint + 1)) as tx from s))),
    c as (select *, greatest(0, case when dx = 0 then case when x0 between -64 and 4160 then 0 else 2 end else least((-64 - x0) / nullif(dx, 0), (4160 - x0) / nullif(dx, 0)) end, case when dy = 0 then case when y0 between -64 and 4160 then 0 else 2 end else least((-64 - y0) / nullif(dy, 0), (4160 - y0) / nullif(dy, 0)) end) as lo,
    least(1, case when dx = 0 then 1 else greatest((-64 - x0) / nullif(dx, 0), (4160 - x0) / nullif(dx, 0)) end, case when dy = 0 then 1 else greatest((-64 - y0) / nullif(dy, 0), (4160 - y0) / nullif(dy, 0)) end) as hi from t),
    e as (select line_id, z, tx, ty, seq, round(x0 + lo * dx)::int as x1, round(y0 + lo * dy)::int as y1, round(x0 + hi * dx)::int as x2, round(y0 + hi * dy)::int as y2 from c where lo <= hi) select z, tx, ty, line_id, count(*) as segments, sum(x1 + 3 * y1 + 5 * x2 + 7 * y2)::bigint as checksum, (dense_rank() over (partition by z, tx, ty order by (line_id * 7919) % 1000 desc, line_id))::int as place from e where x1 <> x2 or y1 <> y2 group by z, tx, ty, line_id"""
)
def s12_tile_features(spark, d):
    """Lines of three zooms by tile, in the order of a made-up length; the features' parts are read back into segments."""
    v = adapted(spark, d, "track_points").withColumnRenamed("track_id", "line_id")
    lines = v.select("line_id").distinct().withColumn("rank", (F.col("line_id") * 7919) % 1000)
    f = T.tile_features(v, lines, [4, 5, 14, 17], [F.desc("rank"), F.asc("line_id")])
    part = F.transform("parts", lambda p: F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda k: F.element_at(p, k)["x"] + 3 * F.element_at(p, k)["y"] + 5 * F.element_at(p, k + 1)["x"] + 7 * F.element_at(p, k + 1)["y"]))
    flat = F.flatten(part)
    return f.select("z", "tx", "ty", "line_id", F.size(flat).cast("long").alias("segments"), F.aggregate(flat, F.lit(0).cast("long"), lambda a, x: a + x).alias("checksum"), "place")


@query(
    """select case when s_suppkey % 9 = 0 then null else 'dem' || s_suppkey end as slug, 'lidar' as kind, 'mapbox' as encoding, s_name as title, coalesce(case when s_suppkey % 4 > 0 then lower(s_name) end, '') as region, case when s_suppkey % 5 > 0 then s_nationkey + 2000 end as year, case when s_suppkey % 7 > 0 then s_acctbal::double end as native_res_m,
    case s_suppkey % 3 when 0 then '[[[1,2],[3,4],[5,6],[1,2]]]' when 1 then '[[[[1,2],[3,4],[5,6],[1,2]]]]' end as footprint from supplier where s_suppkey % 9 > 0"""
)
def s05_read_dem_catalog(spark, d):
    """A catalogue made of the suppliers, as text, and read."""
    p = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    text = lambda flag, c: F.when(flag, c.cast("string"))
    props = F.struct(text(k % 9 > 0, F.concat(F.lit("dem"), k.cast("string"))).alias("id"), F.col("s_name").alias("title"), text(k % 4 > 0, F.lower("s_name")).alias("region"), text(k % 5 > 0, F.col("s_nationkey") + 2000).alias("year"), text(k % 7 > 0, F.col("s_acctbal").cast("double")).alias("native_res_m"))
    ring = "[[[1,2],[3,4],[5,6],[1,2]]]"
    kind = F.when(k % 3 == 0, "MultiPolygon").when(k % 3 == 1, "Polygon").otherwise("Point")
    place = F.when(k % 3 == 0, F.lit(ring)).when(k % 3 == 1, F.lit(ring)).otherwise(F.lit("[1,2]"))
    whole = F.concat(F.lit('{"properties":'), F.to_json(props), F.lit(',"geometry":{"type":"'), kind, F.lit('","coordinates":'), place, F.lit("}}"))
    features = p.select(F.from_json(whole, dem_catalog._FEATURE).alias("f")).select("f.*")
    return dem_catalog.source_rows(features).select("slug", "kind", "encoding", "title", "region", "year", "native_res_m", "footprint")


_BESIDE = f"{_VERTICES}, b as (select line_id, seq, x + line_id * 50 as x, y from v)"
_SEGS = "s as (select *, sum(l) over (partition by line_id order by seq) - l as c0 from (select *, sqrt(power(x2 - x, 2) + power(y2 - y, 2)) as l from (select line_id, seq, x, y, lead(x) over w as x2, lead(y) over w as y2 from b window w as (partition by line_id order by seq)) where x2 is not null) where l > 0)"


@query(
    f"""with {_BESIDE}, {_SEGS}, x as (select p.line_id as pl, q.line_id as ql, p.c0 as pc, p.l as p_l, q.c0 as qc, q.l as q_l, p.x as px, p.y as py, p.x2 - p.x as dx, p.y2 - p.y as dy, q.x2 - q.x as ex, q.y2 - q.y as ey, q.x - p.x as gx, q.y - p.y as gy from s p join s q on (p.line_id < q.line_id or p.line_id = q.line_id and q.seq - p.seq >= 2)
    and least(p.x, p.x2) <= greatest(q.x, q.x2) and least(q.x, q.x2) <= greatest(p.x, p.x2) and least(p.y, p.y2) <= greatest(q.y, q.y2) and least(q.y, q.y2) <= greatest(p.y, p.y2)), t as (select *, (gx * ey - gy * ex) / nullif(dx * ey - dy * ex, 0) as t, (gx * dy - gy * dx) / nullif(dx * ey - dy * ex, 0) as u from x),
    k as (select pl, ql, pc + t * p_l as pa, qc + u * q_l as qa, round((px + t * dx) * 1000)::bigint as nx, round((py + t * dy) * 1000)::bigint as ny from t where t > 0 and t < 1 and u > 0 and u < 1),
    e as (select line_id, false as far, 0e0 as along, arg_min(x, seq) as ex, arg_min(y, seq) as ey from s group by 1 union all select line_id, true, sum(l), arg_max(x2, seq), arg_max(y2, seq) from s group by 1),
    m as (select e.line_id, far, s.line_id as other, s.seq, x, y, x2, y2, c0, l, ex, ey, least(greatest(((ex - x) * (x2 - x) + (ey - y) * (y2 - y)) / (l * l), 0), 1) as t from e join s on s.line_id <> e.line_id and ex between least(x, x2) - 5 and greatest(x, x2) + 5 and ey between least(y, y2) - 5 and greatest(y, y2) + 5),
    n as (select *, x + t * (x2 - x) as sx, y + t * (y2 - y) as sy, c0 + t * l as oa from m), o as (select *, sqrt(power(ex - sx, 2) + power(ey - sy, 2)) as away from n), j as (select * from (select *, row_number() over (partition by line_id, far order by away, other, seq) as k from o where away <= 5) where k = 1),
    a as (select e.line_id, along, round(coalesce(sx, e.ex) * 1000)::bigint as nx, round(coalesce(sy, e.ey) * 1000)::bigint as ny from e left join j on j.line_id = e.line_id and j.far = e.far union all select other, oa, round(sx * 1000)::bigint, round(sy * 1000)::bigint from j union all select pl, pa, nx, ny from k union all select ql, qa, nx, ny from k),
    f as (select line_id, along as d0, nx as ax, ny as ay, lead(along) over w as d1, lead(nx) over w as bx, lead(ny) over w as b_y from a window w as (partition by line_id order by along, nx, ny))
    select line_id, (row_number() over (partition by line_id order by d0, ax, ay) - 1)::int as edge, round(d0, 4) as d0, round(d1, 4) as d1, round(d1 - d0, 4) as length, ax, ay, bx, b_y from f where d1 - d0 > 1e-6"""
)
def j18_trail_network_edges(spark, d):
    v = _vertices(spark, d).drop("leg").withColumn("x", F.col("x") + F.col("line_id") * 50)
    out = N.trail_network_edges(v)
    return rounded(out.select("line_id", "edge", "d0", "d1", "length", F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("b_y")), 4)


#: A route per nation and a piece per supplier: three vertices in two legs along x, overlapping the next piece or leaving a gap, some drawn backwards, some with a way forced.
_ROUTES = """pc as (select s_nationkey as route_id, row_number() over (partition by s_nationkey order by s_suppkey)::int - 1 as place, s_suppkey as piece_id, case when s_suppkey % 9 = 4 then true when s_suppkey % 9 = 7 then false end as forced from supplier),
 pz as (select *, 100e0 * place - 18 * (piece_id % 3) as x0, 100e0 * place + 88 + 11 * (piece_id % 4) as x1, piece_id % 7 * 0.9e0 as h, piece_id % 5 in (1, 3) as back from pc),
 vx as (select piece_id, unnest([0, 1, 2]) as seq, unnest(case when back then [x1, 0.45e0 * x0 + 0.55e0 * x1, x0] else [x0, 0.45e0 * x0 + 0.55e0 * x1, x1] end) as x, unnest(case when back then [h + 1, h + 2.5e0, h] else [h, h + 2.5e0, h + 1] end) as y from pz)"""


@query(
    f"""with recursive {_ROUTES}, sg as (select *, sum(l) over (partition by piece_id order by seq) - l as c0, sum(l) over (partition by piece_id) as total from (select *, sqrt(power(x2 - x, 2) + power(y2 - y, 2)) as l from (select piece_id, seq, x, y, lead(x) over w as x2, lead(y) over w as y2 from vx window w as (partition by piece_id order by seq)) where x2 is not null)),
    en as (select piece_id, min_by(x, seq) as ax, min_by(y, seq) as ay, max_by(x2, seq) as bx, max_by(y2, seq) as b_y, max(total) as total from sg group by 1),
    pr as (select n.route_id, n.place, p.piece_id as p, n.piece_id as n from pc n join pc p on p.route_id = n.route_id and p.place = n.place - 1),
    wy as (select pr.*, a as was, b as turned, case when a then e.ax else e.bx end as ex, case when a then e.ay else e.b_y end as ey, case when b then f.bx else f.ax end as sx, case when b then f.b_y else f.ay end as sy, e.total as pt, f.total as nt from pr join en e on e.piece_id = p join en f on f.piece_id = n, (values (false), (true)) x(a), (values (false), (true)) y(b)),
    di as (select route_id, place, was, turned, 'p' as side, sqrt(power(x + t * (x2 - x) - sx, 2) + power(y + t * (y2 - y) - sy, 2)) as away, case when was then pt - c0 - t * l else c0 + t * l end as s from (select wy.*, g.*, least(greatest(((sx - x) * (x2 - x) + (sy - y) * (y2 - y)) / (l * l), 0), 1) as t from wy join sg g on g.piece_id = p) o
     union all select route_id, place, was, turned, 'n', sqrt(power(x + t * (x2 - x) - ex, 2) + power(y + t * (y2 - y) - ey, 2)), case when turned then nt - c0 - t * l else c0 + t * l end from (select wy.*, g.*, least(greatest(((ex - x) * (x2 - x) + (ey - y) * (y2 - y)) / (l * l), 0), 1) as t from wy join sg g on g.piece_id = n) o),
    nr as (select route_id, place, was, turned, min(away) filter (side = 'p') as dp, min_by(s, away) filter (side = 'p') as sp, min(away) filter (side = 'n') as dn, min_by(s, away) filter (side = 'n') as sn from di group by all),
    jn as (select *, case when kind = 'end' then de when kind = 'leaves' then dp else dn end as gap from (select *, case when sn > 0.5 and sn < nt - 1 and dn + 1 < case when lv then dp else de end then 'joins' when lv then 'leaves' else 'end' end as kind from (select wy.*, dp, sp, dn, sn, sqrt(power(ex - sx, 2) + power(ey - sy, 2)) as de, sp > 1 and sp < pt - 0.5 and dp + 1 < sqrt(power(ex - sx, 2) + power(ey - sy, 2)) as lv from wy join nr using (route_id, place, was, turned)) o) o),
    dp as (select route_id, place, t as turned, 0e0 as cost, t::int as turns, [t] as ways from pc, (values (false), (true)) x(t) where place = 0 and (forced is null or forced = t)
     union all select route_id, place, turned, b.cost, b.turns, list_append(b.ways, turned) from (select j.route_id, j.place, j.turned, min({{'cost': d.cost + j.gap + case when j.kind <> 'end' then 1 else 0 end, 'turns': d.turns + j.turned::int, 'was': j.was, 'ways': d.ways}}) as b from dp d join jn j on j.route_id = d.route_id and j.place = d.place + 1 and j.was = d.turned join pc on pc.route_id = j.route_id and pc.place = j.place where forced is null or forced = j.turned group by all) o),
    be as (select route_id, min({{'cost': cost, 'turns': turns, 'last': turned, 'ways': ways}}) as b from dp d where place = (select max(place) from pc where pc.route_id = d.route_id) group by 1),
    dr as (select pc.*, b.ways[pc.place + 1] as turned, b.ways[pc.place] as was from pc join be using (route_id)),
    jo as (select d.route_id, d.place, j.kind, j.gap, case when j.kind = 'leaves' then sp end as cp, case when j.kind = 'joins' then sn end as cn from dr d join jn j on j.route_id = d.route_id and j.place = d.place and j.was = d.was and j.turned = d.turned),
    rp as (select d.route_id, d.place, d.piece_id, d.turned, coalesce(j.kind, '') as kind, round(coalesce(j.gap, 0), 5) as gap, coalesce(j.gap > 3, false) as bridge, round(coalesce(j.cn, 0), 5) as kept0, round(coalesce(k.cp, e.total), 5) as kept1, round(coalesce(k.cp, e.total) - coalesce(j.cn, 0), 3) as drawn, case when coalesce(j.gap > 3, false) then round(j.gap, 3) end as bridge_m
    from dr d join en e using (piece_id) left join jo j on j.route_id = d.route_id and j.place = d.place left join jo k on k.route_id = d.route_id and k.place = d.place + 1)
    select route_id, place, piece_id, turned, kind, gap, bridge, kept0, kept1, case when kept1 - kept0 < 1 then 'cut away' end as error, case when bool_and(kept1 - kept0 >= 1) over w then drawn end as drawn, case when bool_and(kept1 - kept0 >= 1) over w then bridge_m end as bridge_m from rp window w as (partition by route_id)"""
)
def l10_assemble_route(spark, d):
    """Ways, joins and what is kept of every piece; ``drawn`` is measured on the route's legs but for their moved first vertices, ``bridge_m`` on its bridges."""
    s = table(spark, d, "supplier")
    k, place = F.col("s_suppkey"), F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")) - 1
    pieces = s.select(F.col("s_nationkey").alias("route_id"), place.alias("place"), k.alias("piece_id"), F.when(k % 9 == 4, True).when(k % 9 == 7, False).alias("forced"))
    p = F.col("piece_id")
    x0, x1, h, back = 100.0 * F.col("place") - 18 * (p % 3), 100.0 * F.col("place") + 88 + 11 * (p % 4), p % 7 * 0.9, (p % 5).isin(1, 3)
    middle = 0.45 * x0 + 0.55 * x1
    at = lambda leg, seq, x, y: F.struct(F.lit(leg).alias("leg"), F.lit(seq).alias("seq"), x.alias("x"), y.alias("y"))
    a, b = (F.when(back, x1).otherwise(x0), F.when(back, h + 1).otherwise(h)), (F.when(back, x0).otherwise(x1), F.when(back, h).otherwise(h + 1))
    legs = pieces.select("piece_id", F.explode(F.array(at(0, 0, *a), at(0, 1, middle, h + 2.5), at(1, 0, middle, h + 2.5), at(1, 1, *b))).alias("v")).select("piece_id", "v.*")
    joins, report, vertices = A.assemble_route(pieces, legs)
    step = Window.partitionBy("route_id", "n").orderBy("seq")
    ends = joins.filter("not bridge").select("route_id", "place", F.col("gap").alias("moved"))
    drawn = vertices.withColumn("l", F.hypot(F.col("x") - F.lag("x").over(step), F.col("y") - F.lag("y").over(step))).groupBy("route_id", "place").agg(F.sum(F.when(F.col("piece_id").isNotNull(), F.col("l"))).alias("drawn"), F.sum(F.when(F.col("piece_id").isNull(), F.col("l"))).alias("bridge_m"))
    out = report.join(joins.select("route_id", "place", "kind", "gap", "bridge"), ["route_id", "place"], "left").join(drawn, ["route_id", "place"], "left").join(ends, ["route_id", "place"], "left")
    near = F.abs(F.col("drawn") - F.col("kept1") + F.col("kept0")) <= F.coalesce("moved", F.lit(0.0)) + 1e-6
    out = out.select("route_id", "place", "piece_id", "turned", F.coalesce("kind", F.lit("")).alias("kind"), F.round(F.coalesce("gap", F.lit(0.0)), 5).alias("gap"), F.coalesce("bridge", F.lit(False)).alias("bridge"), F.round("kept0", 5).alias("kept0"), F.round("kept1", 5).alias("kept1"), "error", F.round(F.when(near, F.col("kept1") - F.col("kept0")).otherwise(F.col("drawn")), 3).alias("drawn"), F.round("bridge_m", 3).alias("bridge_m"))
    return rounded(out, 5)


@query(
    f"""with {_GRID}, b as (select min(r) as r0, max(r) as r1, min(c) as c0, max(c) as c1 from g), n as (select r, c, least(greatest(r + i, r0), r1) as nr, least(greatest(c + j, c0), c1) as nc from g, b, (values (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) o(i, j))
    select n.r, n.c, case when count(z) = 5 then round(avg(z), 6) end as mean from n left join g on g.r = nr and g.c = nc group by n.r, n.c"""
)
def g04_plus_mean(spark, d):
    return rounded(L.plus_mean(_grid(spark, d)))


@query(
    f"""with {_VERTICES}, s as (select * from (select line_id, seq, x, y, lead(x) over w as x2, lead(y) over w as y2 from v window w as (partition by line_id order by seq)) where x2 is not null and (x <> x2 or y <> y2)),
    k as (select *, greatest(floor(sqrt(power(x2 - x, 2) + power(y2 - y, 2)) / 4 + 0.5), 1)::bigint as n, row_number() over (partition by line_id order by seq) = 1 as first from s), j as (select *, unnest(range(case when first then 0 else 1 end, n + 1)) as j from k)
    select line_id, seq as seg, j::int as j, round(x + (x2 - x) * j / n, 4) + 0 as x, round(y + (y2 - y) * j / n, 4) + 0 as y from j"""
)
def l02_resample_quick(spark, d):
    return rounded(L.resample_quick(_vertices(spark, d), ["line_id"], 4.0), 4)


@query(
    f"""with {_VERTICES}, s as (select * from (select line_id, seq, x, y, lead(x) over w as x2, lead(y) over w as y2 from v window w as (partition by line_id order by seq)) where x2 is not null and (x <> x2 or y <> y2)),
    k as (select *, greatest(ceil(sqrt(power(x2 - x, 2) + power(y2 - y, 2)) / 5 - 1e-9), 1)::bigint as n from s), j as (select line_id, x + (x2 - x) * j / n as x, y + (y2 - y) * j / n as y from (select *, unnest(range(n + 1)) as j from k)),
    b as (select distinct line_id, bx, unnest(range(floor((y - 20) / 32)::bigint, floor((y + 20) / 32)::bigint + 1)) as b_y from (select *, unnest(range(floor((x - 20) / 32)::bigint, floor((x + 20) / 32)::bigint + 1)) as bx from j)) select line_id, count(*) as blocks, count(*) * 1024 as cells, count(*) * 1024 > 30000 as refused from b group by line_id"""
)
def g01_corridor_cells(spark, d):
    return terrain.corridor_cells(_vertices(spark, d).drop("leg"), 20.0, most=30_000)


#: A network that grows with the suppliers: a trail along every nation's row and a climb per supplier over one to three rows; a pair from each supplier to one of the eleven next.
_NET = """net as (select n_nationkey as line_id, -50e0 as x0, n_nationkey * 200e0 as y0, (select max(s_suppkey) * 20e0 + 50 from supplier) as x1, n_nationkey * 200e0 as y1 from nation union all select 1000 + s_suppkey, s_suppkey * 20e0, s_nationkey * 200e0 - 30, s_suppkey * 20e0, (s_nationkey + 1 + s_suppkey % 3) * 200e0 + 30 from supplier),
 asks as (select a.s_suppkey as pair_id, a.s_suppkey * 20e0 + 7 as x, a.s_nationkey * 200e0 + 45 as y, b.s_suppkey * 20e0 + 6 as x2, b.s_nationkey * 200e0 + 120 as y2 from supplier a join supplier b on b.s_suppkey = a.s_suppkey + 1 + a.s_suppkey * 7 % 11)"""
_AT_NODE = "select h.line_id as row_id, v.line_id as climb_id, v.x0 as x, h.y0 as y from net h join net v on h.line_id < 1000 and v.line_id >= 1000 and h.y0 > v.y0 and h.y0 < v.y1 and v.x0 > h.x0 and v.x0 < h.x1"
_FOLLOWED = f"""with recursive {_NET}, node as ({_AT_NODE}),
 stop as (select row_id as line_id, x as pos, x, y from node union all select climb_id, y, x, y from node union all select line_id, case when y0 = y1 then x0 else y0 end, x0, y0 from net union all select line_id, case when y0 = y1 then x1 else y1 end, x1, y1 from net),
 edge as (select * from (select line_id, pos as t0, x as ax, y as ay, lead(pos) over w as t1, lead(x) over w as bx, lead(y) over w as b_y from stop window w as (partition by line_id order by pos)) o where t1 > t0),
 ends as (select pair_id, 0 as far, x as px, y as py from asks union all select pair_id, 1, x2, y2 from asks),
 off as (select e.*, line_id, y0 = y1 as flat, sqrt(power(px - least(greatest(px, x0), x1), 2) + power(py - least(greatest(py, y0), y1), 2)) as away, case when y0 = y1 then least(greatest(px, x0), x1) else least(greatest(py, y0), y1) end as pos from ends e join net on px between x0 - 250 and x1 + 250 and py between y0 - 250 and y1 + 250),
 near as (select * from (select *, row_number() over (partition by pair_id, far order by away, line_id) as k from off where away <= 250) o where k = 1),
 spot as (select * from (select pair_id, far, away, n.line_id, n.pos, t0, t1, ax, ay, bx, b_y, row_number() over (partition by pair_id, far order by t0) as k from near n join edge e on e.line_id = n.line_id and n.pos between t0 - 1e-6 and t1 + 1e-6) o where k = 1),
 reach as (select pair_id, px as gx, py as gy from ends where far = 1),
 both_ways as (select ax as x, ay as y, bx as nx, b_y as ny, t1 - t0 as more, line_id from edge union all select bx, b_y, ax, ay, t1 - t0, line_id from edge),
 lanes as (select a.pair_id, b.x, b.y, b.nx, b.ny, more from asks a join net n on n.x0 <= greatest(a.x, a.x2) + 1500 + 0.25e0 * sqrt(power(a.x2 - a.x, 2) + power(a.y2 - a.y, 2)) and n.x1 >= least(a.x, a.x2) - 1500 - 0.25e0 * sqrt(power(a.x2 - a.x, 2) + power(a.y2 - a.y, 2)) and n.y0 <= greatest(a.y, a.y2) + 1500 + 0.25e0 * sqrt(power(a.x2 - a.x, 2) + power(a.y2 - a.y, 2)) and n.y1 >= least(a.y, a.y2) - 1500 - 0.25e0 * sqrt(power(a.x2 - a.x, 2) + power(a.y2 - a.y, 2)) join both_ways b on b.line_id = n.line_id and abs(b.x - a.x) < 3000 and abs(b.nx - a.x) < 3000),
 way(pair_id, x, y, metres) using key (pair_id, x, y) as (
  select pair_id, x, y, min(metres) from (select pair_id, ax as x, ay as y, pos - t0 as metres from spot where far = 0 union all select pair_id, bx, b_y, t1 - pos from spot where far = 0) o group by all
  union select t.pair_id, t.x, t.y, t.metres from (select w.pair_id, l.nx as x, l.ny as y, min(w.metres + l.more) as metres from way w join lanes l on l.pair_id = w.pair_id and l.x = w.x and l.y = w.y group by all) t left join recurring.way k on k.pair_id = t.pair_id and k.x = t.x and k.y = t.y where k.metres is null or t.metres < k.metres - 1e-9),
 got as (select w.pair_id, w.metres + least(case when w.x = ax and w.y = ay then pos - t0 else 1e18 end, case when w.x = bx and w.y = b_y then t1 - pos else 1e18 end) as metres from way w join spot g on g.pair_id = w.pair_id and g.far = 1 and (w.x = ax and w.y = ay or w.x = bx and w.y = b_y)
  union all select s.pair_id, abs(s.pos - g.pos) from spot s join spot g on s.pair_id = g.pair_id and s.far = 0 and g.far = 1 and s.line_id = g.line_id and s.t0 = g.t0),
 best as (select pair_id, min(metres) as metres from got group by 1)
 select a.pair_id, round(case when metres > 1e-6 then metres end, 4) as length, round(s.away, 4) as start_off, round(g.away, 4) as end_off, case when s.away is null or g.away is null then 'too far' when metres is null then 'not connected' when metres < 1e-6 then 'same place' end as error, round(case when metres > 1e-6 then metres end, 4) as drawn, round(case when metres > 1e-6 then metres end, 4) as on_trails
 from asks a left join spot s on s.pair_id = a.pair_id and s.far = 0 left join spot g on g.pair_id = a.pair_id and g.far = 1 left join best b on b.pair_id = a.pair_id"""


@query(_FOLLOWED)
def l11_follow_network(spark, d):
    """Lengths of the shortest ways; ``drawn`` is measured along the path's vertices and ``on_trails`` over the trails followed, so both must agree."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("k"), F.col("s_nationkey").alias("n"))
    width = F.lit(s.agg(F.max("k")).first()[0] * 20.0 + 50)
    line = lambda i, *at: F.struct(i.cast("long").alias("line_id"), F.array(*[F.struct(F.lit(q).alias("seq"), F.round(x, 6).cast("double").alias("x"), F.round(y, 6).cast("double").alias("y")) for q, (x, y) in enumerate(at)]).alias("at"))
    rows = table(spark, d, "nation").select(line(F.col("n_nationkey"), (F.lit(-50.0), F.col("n_nationkey") * 200.0), (width, F.col("n_nationkey") * 200.0)).alias("l"))
    climbs = s.select(line(F.col("k") + 1000, (F.col("k") * 20.0, F.col("n") * 200.0 - 30), (F.col("k") * 20.0, (F.col("n") + 1 + F.col("k") % 3) * 200.0 + 30)).alias("l"))
    v = rows.union(climbs).select("l.line_id", F.explode("l.at").alias("p")).select("line_id", "p.*")
    a, b = s.alias("a"), s.alias("b")
    pairs = a.join(shuffled(b), F.col("b.k") == F.col("a.k") + 1 + F.col("a.k") * 7 % 11).select(F.col("a.k").alias("pair_id"), (F.col("a.k") * 20.0 + 7).alias("x"), (F.col("a.n") * 200.0 + 45).alias("y"), (F.col("b.k") * 20.0 + 6).alias("x2"), (F.col("b.n") * 200.0 + 120).alias("y2"))
    got = settled(G.follow_network(v, N.trail_network_edges(v), pairs))
    step = Window.partitionBy("pair_id").orderBy("seq")
    drawn = G.route_vertices(got, v).withColumn("l", F.hypot(F.col("x") - F.lag("x").over(step), F.col("y") - F.lag("y").over(step))).groupBy("pair_id").agg(F.sum("l").alias("drawn"))
    out = got.join(shuffled(drawn), "pair_id", "left")
    return rounded(out.select("pair_id", "length", "start_off", "end_off", "error", "drawn", F.aggregate("trails", F.lit(0.0), lambda t, x: t + x["length"]).alias("on_trails")), 4)


#: Every line cut into pieces of ten steps, each third one turned round and each seventh left out.
_PIECES = f"""{_VERTICES}, k as (select line_id, seq, x, y, unnest(list_distinct([(seq - 1) // 10, (seq - 2) // 10])) as k from v), q as (select * from k where k >= 0 and k % 7 <> 5),
 e as (select line_id, k, count(*) as n, min_by(x, seq) as ax, min_by(y, seq) as ay, max_by(x, seq) as bx, max_by(y, seq) as b_y from q group by all having count(*) > 1)"""


@query(
    f"""with recursive {_PIECES}, w as (select line_id, k, round(ax, 3) as px, round(ay, 3) as py from e union all select line_id, k, round(bx, 3), round(b_y, 3) from e),
    t as (select line_id, min(k) as a, max(k) as b from w group by line_id, px, py having count(*) = 2 and min(k) < max(k)), l as (select line_id, a, b from t union select line_id, b, a from t),
    reach as (select line_id, k as a, k as b from e union select r.line_id, r.a, l.b from reach r join l on l.line_id = r.line_id and l.a = r.b),
    c as (select line_id, a as k, min(b) as least from reach group by all), s as (select line_id, k, sqrt(power(x - lag(x) over o, 2) + power(y - lag(y) over o, 2)) as m from q join e using (line_id, k) window o as (partition by line_id, k order by seq)),
    m as (select c.line_id, least, count(*) as pieces, sum(n) as points from c join e using (line_id, k) group by all), g as (select c.line_id, least, sum(m) as length from c join s using (line_id, k) group by all),
    f as (select m.line_id, row_number() over (partition by m.line_id order by m.least) - 1 as part, pieces, points, length, (select count(*) from t join c on c.line_id = t.line_id and c.k = t.a where t.line_id = m.line_id and c.least = m.least) as joints from m join g on g.line_id = m.line_id and g.least = m.least)
    select line_id, part, (points - least(joints, pieces - 1) )::bigint as points, round(length, 4) as length from f"""
)
def l09_merge_parts(spark, d):
    """Points and lengths of the merged lines; a piece turned round or put out of place would make one longer."""
    v = _vertices(spark, d).select("line_id", "seq", "x", "y")
    cut = v.withColumn("k", F.explode(F.array_distinct(F.array(F.floor((F.col("seq") - 1) / 10), F.floor((F.col("seq") - 2) / 10))))).filter("k >= 0 and k % 7 <> 5")
    own = cut.withColumn("n", F.count("*").over(Window.partitionBy("line_id", "k"))).filter("n > 1")
    pieces = own.select("line_id", F.col("k").alias("part"), F.when(F.col("k") % 3 == 1, -F.col("seq")).otherwise(F.col("seq")).alias("seq"), "x", "y")
    merged = N.merge_parts(pieces)
    step = Window.partitionBy("line_id", "part").orderBy("seq")
    length = F.hypot(F.col("x") - F.lag("x").over(step), F.col("y") - F.lag("y").over(step))
    out = merged.withColumn("l", length).groupBy("line_id", "part").agg(F.count("*").alias("points"), F.coalesce(F.sum("l"), F.lit(0.0)).alias("length"))
    return rounded(out, 4)
