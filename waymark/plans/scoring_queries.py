"""Elevation sources, scored lines and exports over the adapted tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import curve_value
from ..operators import lines as L
from ..operators import listings as I
from ..operators import scoring as R
from ..operators import terrain as T
from .adapters import adapted, table
from .catalogue_queries import _GRID, _VERTICES, _VIEWS, _grid, _members, _vertices, _views
from .registry import query, rounded

_SOURCES = """sources as (select s_name as slug, case s_suppkey % 4 when 0 then 'mapbox' else 'lidar' end as kind, s_suppkey % 5 <> 0 as enabled, s_suppkey % 7 = 0 as gated, case when s_suppkey % 13 <> 0 then 'u' end as cog_url, case when s_suppkey % 3 <> 0 then 'u' end as tiles_url,
 case when s_suppkey % 11 <> 0 then s_nationkey + 1e0 end as native_res, case when s_suppkey % 6 <> 0 then cast(2000 + s_suppkey % 20 as int) end as year, s_suppkey % 90 * 1e0 as w, s_suppkey % 80 * 1e0 as s, s_suppkey % 90 + 6e0 as e, s_suppkey % 80 + 5e0 as n from supplier)"""
_BOXES = "boxes as (select c_custkey as line_id, case when c_custkey % 10 = 0 then 'own' end as own, c_custkey % 97 * 1e0 as w, c_custkey % 83 * 1e0 as s, c_custkey % 97 + 1.5e0 as e, c_custkey % 83 + 1.5e0 as n from customer)"


def _from(spark, d, view, name):
    """The rows of a view of one table, in the SQL the oracle uses."""
    base = view.rsplit(" from ", 1)[1].rstrip(")")
    return spark.sql("with " + view.replace(f" from {base})", " from {t})") + f" select * from {name}", t=table(spark, d, base))


@query(f"with {_SOURCES} select slug from sources where enabled and not gated")
def p14_dem_visible(spark, d):
    return T.dem_visible(_from(spark, d, _SOURCES, "sources"), False).select("slug")


@query(
    f"""with {_SOURCES}, {_BOXES}, l as (select line_id, slug, 1 as g, row_number() over (partition by line_id order by native_res nulls last, year desc nulls first, slug) as k from boxes b join sources f on f.kind = 'lidar' and enabled and not gated and cog_url is not null and b.w <= f.e and b.e >= f.w and b.s <= f.n and b.n >= f.s
    union all select line_id, own, 0, 0 from boxes where own is not null union all select line_id, slug, 2, row_number() over (partition by line_id order by slug) from boxes, sources where kind = 'mapbox' and enabled and tiles_url is not null union all select line_id, 'terrarium', 3, 0 from boxes)
    select line_id, string_agg(slug, ',' order by g, k) as sources from l group by line_id"""
)
def j01_choose_dem_sources(spark, d):
    chosen = T.choose_dem_sources(_from(spark, d, _BOXES, "boxes"), _from(spark, d, _SOURCES, "sources"), 6.0)
    return chosen.select("line_id", F.array_join("sources", ",").alias("sources"))


_STACK = f"""with {_GRID}, cells as (select 'a' as source, r, c, z from g union all select 'b', r, c, r * 3e0 + c * c from g where r % 17 <> 3), p as (select o_orderkey as point_id, (o_custkey % 390) / 10e0 as x, o_orderkey / 300e0 as y from orders),
 q as (select point_id, source, k, x + dx as u, y + dy as v from p, (values ('a'), ('b')) s(source), (values (0, 0, 0), (1, 1, 0), (2, -1, 0), (3, 0, 1), (4, 0, -1)) o(k, dx, dy)),
 e as (select point_id, q.source, k, sum(z * (case when i = 1 then v - floor(v) else 1 - v + floor(v) end) * (case when j = 1 then u - floor(u) else 1 - u + floor(u) end)) as z, count(z) as n from q, (values (0, 0), (0, 1), (1, 0), (1, 1)) o(i, j), cells where cells.source = q.source and r = floor(v) + i and c = floor(u) + j group by all)"""


def _stack(spark, d):
    p = table(spark, d, "orders").select(F.col("o_orderkey").alias("point_id"), (F.col("o_custkey") % 390 / 10).alias("x"), (F.col("o_orderkey") / 300).alias("y"), F.array(F.lit("a"), F.lit("b")).alias("sources"))
    g = _grid(spark, d)
    other = g.filter("r % 17 <> 3").select(F.lit("b").alias("source"), "r", "c", (F.col("r") * 3.0 + F.col("c") * F.col("c")).alias("z"))
    return p, g.select(F.lit("a").alias("source"), "r", "c", "z").unionByName(other)


_STACKED = f"""{_STACK}, f as (select point_id, source, max(z) filter (k = 0) as z, (max(z) filter (k = 1) - max(z) filter (k = 2)) / 2 as gx, (max(z) filter (k = 3) - max(z) filter (k = 4)) / 2 as gy from e group by all having count(*) = 5 and min(n) = 4), b as (select *, row_number() over (partition by point_id order by source) as k from f)
    select p.point_id, round(z, 6) as z, round(gx, 6) + 0 as gx, round(gy, 6) + 0 as gy, source from p left join (select * from b where k = 1) b using (point_id)"""


@query(_STACKED)
def j04_sample_stack(spark, d):
    return rounded(T.sample_stack(*_stack(spark, d)))


_FIRST = f"{_STACK}, b as (select *, row_number() over (partition by point_id order by source) as place from e where k = 0 and n = 4) select p.point_id, round(z, 6) as z, source from p left join (select * from b where place = 1) b using (point_id)"


@query(_FIRST)
def j05_sample_first(spark, d):
    return rounded(T.sample_first(*_stack(spark, d)))


@query(
    f"""with {_VERTICES}, s as (select line_id, x, y, lead(x) over w as x2, lead(y) over w as y2 from v window w as (partition by line_id order by seq)), t as (select *, greatest(1, ceil(sqrt(power(x2 - x, 2) + power(y2 - y, 2)) / 5 - 1e-9))::bigint as n from s where x <> x2 or y <> y2),
    m as (select line_id, x + (x2 - x) * j / n as x, y + (y2 - y) * j / n as y from (select *, unnest(range(n + 1)) as j from t)) select distinct line_id, bx, unnest(range(floor((y - 20) / 32)::bigint, floor((y + 20) / 32)::bigint + 1)) as by from (select *, unnest(range(floor((x - 20) / 32)::bigint, floor((x + 20) / 32)::bigint + 1)) as bx from m)"""
)
def g01_corridor_blocks(spark, d):
    return T.corridor_blocks(_vertices(spark, d).drop("leg"), 20.0)


@query(
    f"""with {_GRID}, k as (select * from g where z is not null) select g.r, g.c, round(sqrt(power((coalesce(e.z, g.z) - coalesce(w.z, g.z)) / nullif((e.z is not null)::int + (w.z is not null)::int, 0), 2) + power((coalesce(n.z, g.z) - coalesce(s.z, g.z)) / nullif((n.z is not null)::int + (s.z is not null)::int, 0), 2)), 6) as slope
    from k g left join k e on e.r = g.r and e.c = g.c + 1 left join k w on w.r = g.r and w.c = g.c - 1 left join k n on n.r = g.r + 1 and n.c = g.c left join k s on s.r = g.r - 1 and s.c = g.c"""
)
def g09_gradient_slope(spark, d):
    return rounded(T.gradient_slope(_grid(spark, d)))


@query(f"with {_GRID}, a as (select r, c, sqrt(power(r - 25, 2) + power(c - 20, 2)) as away from g) select r, c, round(greatest(12 - 0.5e0 * away, 0), 6) as cone, round(12 * sqrt(greatest(1 - away * away / 576, 0)), 6) as dome, round(12 + 0.5e0 * (c - 20), 6) as plane from a")
def g10_analytic_surface(spark, d):
    g = _grid(spark, d)
    cone, dome, plane = (T.analytic_surface(g, k, 25.0, 20.0, 12.0, 0.5).withColumnRenamed("z", k) for k in ("cone", "dome", "plane"))
    return rounded(cone.join(dome, ["r", "c"]).join(plane, ["r", "c"]))


@query(f"with {_GRID}, {_VIEWS} select view_id, round(quantile_cont(z, 0.5), 6) as p50, round(quantile_cont(z, 0.9), 6) as p90, round(quantile_cont(z, 0.99), 6) as p99 from w left join g on c between c0 and c0 + 15 and r between r0 and r0 + 10 group by view_id")
def a22_twi_percentiles(spark, d):
    return rounded(T.view_percentiles(_grid(spark, d), "z", _views(spark, d)))


@query(
    """with a as (select line_id, unnest([500e0, 2500.5e0, 7000e0]) as q from (select distinct line_id from samples)), m as (select a.line_id, q, s.i, s.d, row_number() over (partition by a.line_id, q order by abs(s.d - q), s.d desc) as k from a join samples s using (line_id)) select line_id, q, i, d from m where k = 1"""
)
def j21_nearest_sample(spark, d):
    s = adapted(spark, d, "samples")
    return R.nearest_sample(s, s.select("line_id").distinct().withColumn("q", F.explode(F.array(F.lit(500.0), F.lit(2500.5), F.lit(7000.0)))))


@query("with m as (select l_orderkey as path, l_suppkey as trail, sum(l_quantity) as metres from lineitem group by all) select *, row_number() over (partition by path order by metres desc, trail)::int as place from m")
def a21_trail_shares(spark, d):
    return R.trail_shares(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_suppkey").alias("trail"), F.col("l_quantity").alias("metres")))


@query(
    """with c as (select l_suppkey as search, l_orderkey % 5 as candidate, l_linenumber as factor, sum(l_quantity) as cost, max(l_discount) * 100 as grade from lineitem group by all), g as (select search, candidate, max(grade) as grade from c group by all), o as (select * from c where candidate = 0),
    j as (select c.search, c.candidate, c.factor, c.cost, c.cost - coalesce(o.cost, 0) - 0.1e0 * greatest(coalesce(o.cost, 0), 1) as worse from c left join o on o.search = c.search and o.factor = c.factor where c.candidate <> 0),
    k as (select search, candidate, sum(cost) as total, max(worse) as worse, arg_max(factor, (worse, factor)) as factor from j group by all), w as (select search, sum(cost) as was from o group by all)
    select k.search, k.candidate, total < was and g.grade <= h.grade + 1 and worse <= 0 as offered, case when worse > 0 then k.factor end as worst from k join w using (search) join g on g.search = k.search and g.candidate = k.candidate join g h on h.search = k.search and h.candidate = 0"""
)
def a19_offer_rule(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("search"), (F.col("l_orderkey") % 5).alias("candidate"), F.col("l_linenumber").alias("factor"), "l_quantity", "l_discount")
    costs = li.groupBy("search", "candidate", "factor").agg(F.sum("l_quantity").alias("cost"))
    return R.offer_rule(costs, li.groupBy("search", "candidate").agg((F.max("l_discount") * 100).alias("grade")), 0)


@query(
    """with s as (select *, abs(gx * 100) as g, abs(gy * 30) as o, z - last_value(z ignore nulls) over (partition by line_id order by i rows between unbounded preceding and 1 preceding) as t from samples)
    select line_id, round(max(g), 6) as grade_max, round(quantile_cont(g, 0.95), 6) as grade_p95, round(max(w / 10), 6) as cut_max, round(avg(w / 10), 6) as cut_mean, round(max(o), 6) as offset_max, round(avg(o), 6) as offset_mean, round(coalesce(sum(w) filter (o >= 7.15e0), 0), 6) as edge_m, round(coalesce(sum(w) filter (degrees(heading) < 45), 0), 6) as fall_line_m, round(coalesce(sum(w) filter (w >= 10), 0), 6) as wet_m,
    round(arg_max(z, i) filter (z is not null) - arg_min(z, i) filter (z is not null), 6) as net_climb, round(least(coalesce(-sum(t) filter (t < 0), 0), coalesce(sum(t) filter (t > 0), 0)), 6) as lost from s group by line_id"""
)
def a23_line_stats(spark, d):
    s = adapted(spark, d, "samples").withColumns({"grade": F.col("gx") * 100, "offset": F.col("gy") * 30, "cut": F.col("w") / 10, "tsa": F.degrees("heading"), "twi": F.col("w")})
    return rounded(R.line_stats(s, 8.15))


@query(
    f"""with {_VERTICES}, s as (select line_id, seq as seg, x, y, lead(x) over w as x2, lead(y) over w as y2 from v window w as (partition by line_id order by seq)), h as (select line_id, seg, atan2(y2 - y, x2 - x) as a from s where x <> x2 or y <> y2), t as (select *, abs(a - lag(a) over (partition by line_id order by seg)) as t from h)
    select line_id, seg, round(coalesce(least(t, 2 * pi() - t), 0), 5) + 0 as turn from t"""
)
def w13_turning(spark, d):
    return rounded(R.turning(_vertices(spark, d).drop("leg")).select("line_id", "seg", "turn"), 5)


@query(
    """with s as (select line_id, i, w, case when gx > 0.1 then 1 when gx < -0.1 then -1 else 0 end as side from samples), r as (select *, i - row_number() over (partition by line_id, side order by i) as k from s)
    select line_id, side, min(i) as first_i, max(i) as last_i, sum(w) as metres from r where side <> 0 group by line_id, side, k having sum(w) >= 4"""
)
def w15_side_runs(spark, d):
    side = F.when(F.col("gx") > 0.1, 1).when(F.col("gx") < -0.1, -1).otherwise(0)
    return R.side_runs(adapted(spark, d, "samples").withColumn("side", side))


@query(
    """with v as (select line_id, w * sqrt(1 + gx * gx) as sl, abs(gx) * 100 as g, abs(gy) * 100 as s from samples), c as (select line_id, sum(sl * case when g <= 0 then 0.1 when g <= 10 then exp(ln(0.1) + (ln(10) - ln(0.1)) * g / 10) else 10 end) as grade, sum(sl * case when s <= 0 then 1 when s <= 40 then exp(ln(3) * s / 40) else 3 end) as slope from v group by line_id)
    select line_id, 'grade' as factor, round(grade, 4) as cost, round(2 * grade, 4) as contribution from c union all select line_id, 'slope', round(slope, 4), round(0.5e0 * slope, 4) from c"""
)
def c09_factor_costs(spark, d):
    s = adapted(spark, d, "samples").withColumn("sl", F.col("w") * F.sqrt(1 + F.col("gx") * F.col("gx")))
    values = {"grade": curve_value(F.abs("gx") * 100, [(0, 0.1), (10, 10)]), "slope": curve_value(F.abs("gy") * 100, [(0, 1), (40, 3)])}
    return rounded(R.factor_costs(s, values, {"grade": 2.0, "slope": 0.5}), 4)


@query("select line_id, bool_or(z is null) as off_terrain, bool_or(abs(gy * 30) > 7.15e0) as outside, bool_or(i > 0 and w < 0.001) as short_steps, max(d) > 15000 as too_long from samples group by line_id")
def c11_line_refusals(spark, d):
    return R.line_refusals(adapted(spark, d, "samples").withColumn("offset", F.col("gy") * 30), 7.15, 15_000.0)


@query("select track_id as line_id, sha256(string_agg('new,0,' || round(lon * 1e7)::bigint || ',' || round(lat * 1e7)::bigint, ';' order by seq)) as signature from track_points group by track_id")
def f14_legs_signature(spark, d):
    return R.legs_signature(adapted(spark, d, "track_points").select(F.col("track_id").alias("line_id"), F.lit(0).alias("leg"), "seq", F.lit("new").alias("kind"), "lon", "lat"))


@query(None)
def l05_simplify(spark, d):
    return R.simplify(_vertices(spark, d), 5.0)


@query("with p as (select l_suppkey as trail, l_orderkey as piece, sum(l_quantity) as length from lineitem group by all) select trail, arg_min(piece, (-length, piece)) as piece, max(length) as length, count(*) as pieces from p group by trail")
def o02_longest_piece(spark, d):
    p = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("trail"), F.col("l_orderkey").alias("piece")).agg(F.sum("l_quantity").alias("length"))
    return I.longest_piece(p, "trail")


@query("select alignment_id, project_id, row_number() over (partition by project_id order by case when visibility <> 'gated' then price end desc nulls last, alignment_id)::int as place from alignments")
def o03_sort_within_section(spark, d):
    a = adapted(spark, d, "alignments").withColumn("metric", F.expr("case when visibility <> 'gated' then price end"))
    return R.sort_within(a, "project_id", "metric", "alignment_id").select("alignment_id", "project_id", "place")


@query("with t as (select l_suppkey as setting, l_orderkey as run, sum(l_quantity) as total from lineitem group by all) select setting, min(total) as total, arg_min(run, (total, run)) as run from t group by setting")
def o06_best_per_group(spark, d):
    t = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("setting"), F.col("l_orderkey").alias("run")).agg(F.sum("l_quantity").alias("total"))
    return I.best_per_group(t, ["setting"], "total", "run")


@query("select user_id, event_id from events e where event_type = 'error' or not exists (from events f where f.user_id = e.user_id and f.event_type = 'error')")
def x01_trkpt_else_rtept(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    return R.preferred_points(e.filter("event_type = 'error'"), e.filter("event_type <> 'error' or event_type is null"), "user_id").select("user_id", "event_id")


@query("select l_orderkey as alignment_id, 'track' as kind, l_linenumber as n from lineitem union all select o_orderkey, 'waypoint', 1 from orders")
def x02_combined_export(spark, d):
    tracks = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("alignment_id"), F.col("l_linenumber").alias("n"))
    return I.combined({"track": tracks, "waypoint": table(spark, d, "orders").select(F.col("o_orderkey").alias("alignment_id"), F.lit(1).alias("n"))})


@query("select alignment_id, project_id from alignments where project_id in (select s_nationkey from supplier)")
def x03_distinct_visible(spark, d):
    return I.distinct_visible(adapted(spark, d, "alignments"), _members(spark, d), "project_id").select("alignment_id", "project_id")


@query(
    """with l as (select l_orderkey as alignment_id, count(*) as legs from lineitem group by all) select project_id, count(*) as alignments, sum(coalesce(legs, 0))::bigint as legs, count(parent_id) as variants, arg_max(alignment_id, (taken_at, alignment_id)) as newest from alignments left join l using (alignment_id) where visibility <> 'private' group by project_id"""
)
def j10_project_panel(spark, d):
    legs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("alignment_id"))
    return I.project_panel(adapted(spark, d, "alignments").filter("visibility <> 'private'"), legs)


@query(
    """with recursive p as (select alignment_id as project_id, name, parent_id, visibility <> 'private' as seen from alignments), up as (select project_id as id, parent_id as at, 1 as depth from p where parent_id is not null union all select up.id, p.parent_id, depth + 1 from up join p on p.project_id = up.at where p.parent_id is not null),
    pa as (select up.id, string_agg(up.at::varchar, ',' order by depth) as parents from up join p on p.project_id = up.at and p.seen group by 1), ch as (select parent_id as id, string_agg(project_id::varchar, ',' order by name, project_id) as children from p where seen and parent_id is not null group by 1),
    al as (select l_orderkey as id, l_linenumber as k, l_partkey % 3 as priority, 'n' || l_linenumber as name, count(*) as legs from lineitem group by all), aa as (select id, string_agg(k || ':' || legs, ',' order by priority, name, k) as alignments from al group by 1),
    tr as (select l_orderkey as id, string_agg(l_partkey::varchar, ',' order by l_shipdate desc, l_partkey) as tracks from (select distinct l_orderkey, l_partkey, l_shipdate from lineitem) o group by 1)
    select project_id, coalesce(parents, '') as parents, coalesce(children, '') as children, coalesce(alignments, '') as alignments, coalesce(tracks, '') as tracks from p left join pa on pa.id = project_id left join ch on ch.id = project_id left join aa on aa.id = project_id left join tr on tr.id = project_id where seen"""
)
def j10_project_pages(spark, d):
    """A page for every visible row of the tree of alignments, taken as projects; their lines are the alignments and, by ship date, the tracks."""
    p = adapted(spark, d, "alignments")
    projects = p.select(F.col("alignment_id").alias("project_id"), "name", "parent_id")
    li = table(spark, d, "lineitem")
    lines = li.select(F.col("l_orderkey").alias("project_id"), F.struct("l_orderkey", "l_linenumber", (F.col("l_partkey") % 3).alias("p")).alias("alignment_id"), F.concat(F.lit("n"), F.col("l_linenumber").cast("string")).alias("name"), (F.col("l_partkey") % 3).alias("priority"), F.lit(None).cast("long").alias("parent_id"))
    tracks = li.select(F.col("l_orderkey").alias("project_id"), F.col("l_partkey").alias("track_id"), F.lit("t").alias("name"), F.col("l_shipdate").alias("taken_at"), F.lit(1.0).alias("length_m")).distinct()
    out = I.project_pages(projects, p.filter("visibility <> 'private'").select(F.col("alignment_id").alias("project_id")), lines.distinct(), lines.select("alignment_id"), tracks)
    ids = lambda c, f: F.array_join(F.transform(c, lambda x: f(x).cast("string")), ",").alias(c)
    return out.select("project_id", ids("parents", lambda x: x["project_id"]), ids("children", lambda x: x["project_id"]), ids("alignments", lambda x: F.concat(x["alignment_id"]["l_linenumber"].cast("string"), F.lit(":"), x["legs"].cast("string"))), ids("tracks", lambda x: x["track_id"]))
