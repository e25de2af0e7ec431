"""Catalogue, geometry and scoring operators over the adapted tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import catalogue as C
from ..operators import lines as L
from ..operators import listings as I
from .adapters import adapted, table
from .registry import query, rounded

_MEMBERS = "members as (select s_suppkey as user_id, s_nationkey as project_id from supplier)"


def _members(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("user_id"), F.col("s_nationkey").alias("project_id"))


@query(f"with {_MEMBERS} select alignment_id, project_id, visibility from alignments where visibility in ('public', 'gated') or owner_id = 7 or project_id in (select project_id from members where user_id = 7)")
def p01_visible_rows(spark, d):
    return C.visible_rows(adapted(spark, d, "alignments"), {"id": 7, "data_user": True}, _members(spark, d)).select("alignment_id", "project_id", "visibility")


@query(f"with {_MEMBERS} select alignment_id, owner_id = 7 or project_id in (select project_id from members where user_id = 7) or visibility <> 'private' as editable from alignments")
def p02_can_edit(spark, d):
    a = adapted(spark, d, "alignments")
    own = _members(spark, d).filter("user_id = 7").select(F.col("project_id").alias("p")).distinct()
    j = a.join(own, a["project_id"] == own["p"], "left")
    return j.select("alignment_id", C.can_edit({"id": 7, "trail_editor": True}, F.col("owner_id"), F.col("visibility"), F.col("p").isNotNull()).alias("editable"))


@query("select alignment_id, case priority_text when 'Preferred' then 1 when ' alternate ' then 2 when 'Future' then 3 else 2 end::int as priority, case priority_text when 'Preferred' then 'preferred' when 'Future' then 'future' else 'alternate' end as label from alignments")
def p06_parse_priority(spark, d):
    p = C.parse_priority(F.col("priority_text"))
    return adapted(spark, d, "alignments").select("alignment_id", p.alias("priority"), C.priority_label(p).alias("label"))


@query("select doc_id, t as note from (select doc_id, regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '^\\s+|\\s+$', '', 'g') as t from documents) where length(t) between 1 and 5000")
def p12_clean_note(spark, d):
    return table(spark, d, "documents").select("doc_id", C.clean_note(F.col("text")).alias("note")).filter("note is not null")


@query("select track_id, seq from track_points where lon between -151.2 and -151.18 and lat between 59.6 and 59.63")
def p13_bbox_filter(spark, d):
    return I.bbox_filter(adapted(spark, d, "track_points"), -151.2, 59.6, -151.18, 59.63).select("track_id", "seq")


@query(
    """with a as (select l_orderkey as alignment_id, l_linenumber as leg from lineitem where l_quantity > 10) select alignment_id, min(leg) as first, max(leg) as last, count(leg) = count(distinct leg) and max(leg) - min(leg) + 1 = count(leg) as ok from a group by alignment_id"""
)
def p18_leg_range(spark, d):
    return C.leg_range(table(spark, d, "lineitem").filter("l_quantity > 10").select(F.col("l_orderkey").alias("alignment_id"), F.col("l_linenumber").alias("leg")))


@query(
    """with s as (select o_custkey as k, sum(o_totalprice) as a, count(*)::double as b from orders where o_orderkey % 3 <> 0 group by 1), n as (select o_custkey as k, sum(o_totalprice) as a, count(*)::double as b from orders group by 1),
    u as (select k, 'a' as metric, s.a as saved, n.a as now from s join n using (k) union all select k, 'b', s.b, n.b from s join n using (k))
    select k, metric, round(saved, 2) as saved, round(now, 2) as now, round(now - saved, 2) as delta, case when metric = 'a' then case when now < saved then 'better' else 'worse' end end as verdict from u where abs(now - saved) > greatest(0.005 * abs(saved), 0.05)"""
)
def p10_compare_saved_now(spark, d):
    o = table(spark, d, "orders")
    both = [x.groupBy(F.col("o_custkey").alias("k")).agg(F.sum("o_totalprice").alias("a"), F.count("*").cast("double").alias("b")) for x in (o.filter("o_orderkey % 3 <> 0"), o)]
    return rounded(C.compare_saved_now(*both, "k", {"a": -1, "b": 0}), 2)


@query("select n_nationkey as project_id, n_name as name, (select count(*) from alignments a where a.project_id = n_nationkey) as alignments, case when r_regionkey % 2 = 0 then r_name end as parent from nation join region on n_regionkey = r_regionkey")
def j09_project_listing(spark, d):
    projects = table(spark, d, "nation").select(F.col("n_nationkey").alias("project_id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("parent_id"))
    visible = table(spark, d, "region").filter("r_regionkey % 2 = 0").select(F.col("r_regionkey").alias("project_id"), F.col("r_name").alias("name"))
    return C.project_listing(projects, adapted(spark, d, "alignments").select("project_id"), visible)


@query("select count(*) as legs, a.project_id, a.parent_id is not null as variant from lineitem join alignments a on l_orderkey = a.alignment_id group by all")
def j11_legs_with_project(spark, d):
    legs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("alignment_id"))
    return I.legs_with_project(legs, adapted(spark, d, "alignments")).groupBy("project_id", "variant").agg(F.count("*").alias("legs"))


@query("select distinct l_partkey as trail, project_id from lineitem join alignments on alignment_id = l_orderkey")
def j12_study_projects(spark, d):
    """The projects on every trail."""
    return I.study_projects(adapted(spark, d, "alignments"), table(spark, d, "lineitem").select(F.col("l_partkey").alias("trail"), F.col("l_orderkey").alias("alignment_id")))


@query("select o_orderkey from orders where o_orderkey % 4 <> 0 and o_orderkey % 5 = 0")
def j13_gone_rows(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    return C.gone_rows(o.filter("o_orderkey % 4 <> 0"), o.filter("o_orderkey % 5 <> 0"), "o_orderkey")


@query(
    """select o_orderkey, case when o_orderkey % 5 <> 0 then o_totalprice * 2 else o_totalprice end as price, case when o_orderkey % 4 <> 0 then o_orderstatus end as enabled,
    case when o_orderkey % 4 = 0 then 'created' when o_orderkey % 5 <> 0 then 'updated' when o_orderkey % 2 = 0 then 'deleted' else 'kept' end as action from orders where o_orderkey % 4 <> 0 or o_orderkey % 5 <> 0"""
)
def j14_upsert(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("enabled"))
    new = o.filter("o_orderkey % 5 <> 0").select("o_orderkey", (F.col("price") * 2).alias("price"))
    return C.upsert(o.filter("o_orderkey % 4 <> 0"), new, "o_orderkey", ["price"], ["enabled"], delete=F.col("o_orderkey") % 2 == 0)


@query(
    """with recursive up as (select alignment_id as id, 1 as depth, parent_id as ancestor from alignments where parent_id is not null
    union all select u.id, u.depth + 1, a.parent_id from up u join alignments a on a.alignment_id = u.ancestor where a.parent_id is not null) select id, depth::int as depth, ancestor from up"""
)
def j15_ancestors(spark, d):
    return C.ancestors(spark, adapted(spark, d, "alignments").select("alignment_id", "parent_id"), "alignment_id")


@query(
    """with recursive down as (select alignment_id as id, alignment_id as root, 0 as depth from alignments a where parent_id is null or parent_id not in (select alignment_id from alignments)
    union all select a.alignment_id, d.root, d.depth + 1 from down d join alignments a on a.parent_id = d.id) select id, root, depth::int as depth from down"""
)
def j16_variant_tree(spark, d):
    return C.variant_tree(spark, adapted(spark, d, "alignments").select("alignment_id", "parent_id"), "alignment_id")


@query("select alignment_id, name || case when n > 1 then ' (' || n || ')' else '' end as name from (select alignment_id, project_id, name, row_number() over (partition by project_id, name order by alignment_id) as n from alignments)")
def w16_suffix_numbering(spark, d):
    return adapted(spark, d, "alignments").select("alignment_id", C.suffixed("name", ["alignment_id"], ["project_id"]).alias("name"))


@query(
    """with r as (select s_suppkey as id, case when s_suppkey % 4 = 1 then 'trail-' || (s_suppkey % 6 + 1) else 'trail' || case s_suppkey % 3 when 0 then '' else '-' || (s_suppkey % 3 + 1) end end as base from supplier), t as (select 'trail-' || (n_nationkey + 4) as slug from nation where n_nationkey % 2 = 0 union all select 'trail-2-2'),
    o as (select row_number() over (order by id) as k, id, base from r),
    walk as (with recursive w(k, id, slug, held) as (select 0::bigint, null::bigint, null::varchar, (select list(slug) from t) union all
      select o.k, o.id::bigint, p.slug, list_append(w.held, p.slug) from w join o on o.k = w.k + 1, lateral (select case when n = 1 then o.base else o.base || '-' || n end as slug from (select unnest(range(1, 2 + len(w.held))) as n) c where not list_contains(w.held, case when n = 1 then o.base else o.base || '-' || n end) order by n limit 1) p) select * from w where k > 0)
    select id, slug from walk"""
)
def w16_unique_slugs(spark, d):
    """Names that are one another's numbered forms, beside taken ones; the SQL walks the rows one by one."""
    k = F.col("s_suppkey")
    base = F.when(k % 4 == 1, F.concat(F.lit("trail-"), (k % 6 + 1).cast("string"))).otherwise(F.concat(F.lit("trail"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("-"), (k % 3 + 1).cast("string")))))
    taken = table(spark, d, "nation").filter("n_nationkey % 2 = 0").select(F.concat(F.lit("trail-"), (F.col("n_nationkey") + 4).cast("string")).alias("slug"))
    taken = taken.union(spark.createDataFrame([("trail-2-2",)], "slug string"))
    return C.unique_slugs(table(spark, d, "supplier").select(k.cast("long").alias("id"), base.alias("slug")), "slug", ["id"], taken)


@query("select alignment_id, (row_number() over (partition by project_id order by price desc, alignment_id) - 1)::int as section_order from alignments")
def w17_renumber_sections(spark, d):
    a = adapted(spark, d, "alignments").select("alignment_id", "project_id", "price")
    return C.renumber_sections(a, ["project_id"], [F.desc("price"), "alignment_id"]).select("alignment_id", "section_order")


@query("select (a.alignment_id + 1000000000)::bigint as alignment_id, a.project_id, a.alignment_id as parent_id, a.name || ' variant ' || (2 + (select count(*) from alignments c where c.parent_id = a.alignment_id)) as name from alignments a where alignment_id = (select max(parent_id) from alignments)")
def w19_duplicate_alignment(spark, d):
    a = adapted(spark, d, "alignments")
    source = a.agg(F.max("parent_id")).first()[0]
    copy, _ = C.duplicate_alignment(a, a.select("alignment_id"), source, source + 1_000_000_000)
    return copy.select(F.col("alignment_id").cast("long").alias("alignment_id"), "project_id", "parent_id", "name")


@query("select alignment_id, row_number() over (partition by project_id order by case priority_text when 'Preferred' then 1 when ' alternate ' then 2 when 'Future' then 3 else 2 end, name, alignment_id) as place, row_number() over (partition by project_id order by case when alignment_id % 3 > 0 then taken_at end desc nulls first, alignment_id) as track_place, row_number() over (partition by project_id order by case when alignment_id % 3 > 0 then taken_at end desc nulls last, alignment_id) as tile_place from alignments")
def o01_listing_orders(spark, d):
    a = adapted(spark, d, "alignments").withColumn("priority", C.parse_priority(F.col("priority_text"))).withColumn("taken_at", F.when(F.col("alignment_id") % 3 > 0, F.col("taken_at")))
    for kind, name in (("alignments", "by_name"), ("tracks", "track_place"), ("tiles", "tile_place")):
        a = C.placed(a, ["project_id"], [*C.listing_order(kind), F.col("alignment_id").asc()]).withColumnRenamed("place", name)
    return a.select("alignment_id", F.col("by_name").alias("place"), "track_place", "tile_place")


@query("select track_id, min(lon) as w, min(lat) as s, max(lon) as e, max(lat) as n from track_points group by track_id")
def a17_extent(spark, d):
    return I.extent(adapted(spark, d, "track_points"), ["track_id"])


@query("select o_orderkey, case when o_orderkey % 4 = 0 then 'created' when o_orderkey % 5 = 0 then 'disabled' else 'seen' end as state from orders where o_orderkey % 4 <> 0 or o_orderkey % 5 <> 0")
def x04_catalog_diff(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    return I.catalog_diff(o.filter("o_orderkey % 4 <> 0"), o.filter("o_orderkey % 5 <> 0"), "o_orderkey")


@query(
    """with c as (select l_linenumber as factor, l_suppkey as line, sum(l_discount) as cost from lineitem group by all), s as (select unnest(range(5)) as setting), t as (select setting, line, sum(cost * (1 + (setting * factor) % 3)) as total from c cross join s group by all),
    r as (select *, row_number() over (partition by setting order by round(total, 6), line) as n from t) select setting::int as setting, line, round(total, 6) as total from r where n = 1"""
)
def a18_weight_sweep(spark, d):
    li = table(spark, d, "lineitem")
    costs = li.groupBy(F.col("l_linenumber").alias("factor"), F.col("l_suppkey").alias("line")).agg(F.sum("l_discount").alias("cost"))
    settings = spark.range(5).select(F.col("id").cast("int").alias("setting"), F.explode(F.sequence(F.lit(1), F.lit(7))).alias("factor")).withColumn("k", 1.0 + (F.col("setting") * F.col("factor")) % 3)
    return rounded(L.weight_sweep(costs, settings).select("setting", "line", "total"))


@query("select line_id, least(greatest(floor(z / 1000 * 30), 0), 29)::int as bin, round(sum(w), 6) as weight from samples where z is not null group by all")
def a14_factor_histograms(spark, d):
    return rounded(L.factor_histograms(adapted(spark, d, "samples"), "z", 0.0, 1000.0))


@query("select least(greatest(floor((gx + 0.4) / 0.8 * 48), 0), 47)::int as cx, least(greatest(floor(z / 1000 * 32), 0), 31)::int as cy, round(sum(w), 6) as metres from samples where z is not null group by all")
def a15_cost_space(spark, d):
    return rounded(L.cost_space(adapted(spark, d, "samples"), ("gx", -0.4, 0.4), ("z", 0.0, 1000.0)))


@query(
    """with s as (select line_id, i, case when gx > 0.2 then 1 when gx < -0.2 then -1 end as side from samples)
    select line_id, i, coalesce(last_value(side ignore nulls) over (partition by line_id order by i), first_value(side ignore nulls) over (partition by line_id order by i rows between current row and unbounded following), 0)::int as side from s"""
)
def w10_hold_side(spark, d):
    return adapted(spark, d, "samples").select("line_id", "i", L.hold_side("gx", 0.2).alias("side"))


@query(
    """select line_id, i, round(d - coalesce(last_value(case when z > 900 then d end ignore nulls) over (partition by line_id order by i), first_value(d) over (partition by line_id order by i)), 6) as since from samples"""
)
def w12_run_since_site(spark, d):
    return rounded(adapted(spark, d, "samples").select("line_id", "i", L.run_since(F.col("z") > 900).alias("since")))


def _grid(spark, d):
    """Elevation cells from part: a surface over row and column of its key."""
    return table(spark, d, "part").select((F.col("p_partkey") / 40).cast("int").alias("r"), (F.col("p_partkey") % 40).cast("int").alias("c"), F.when(F.col("p_partkey") % 37 != 0, F.col("p_retailprice")).alias("z"))


_GRID = "g as (select (p_partkey // 40)::int as r, (p_partkey % 40)::int as c, case when p_partkey % 37 <> 0 then p_retailprice end as z from part)"


_SAMPLED = f"""with {_GRID}, p as (select o_orderkey as id, (o_custkey % 390) / 10e0 as x, o_orderkey / 300e0 as y from orders),
    q as (select id, x - floor(x) as fu, y - floor(y) as fv, floor(y)::int as r, floor(x)::int as c from p)
    select id as point_id, round((1 - fv) * ((1 - fu) * a.z + fu * b.z) + fv * ((1 - fu) * e.z + fu * f.z), 6) as z from q
    left join g a on a.r = q.r and a.c = q.c left join g b on b.r = q.r and b.c = q.c + 1 left join g e on e.r = q.r + 1 and e.c = q.c left join g f on f.r = q.r + 1 and f.c = q.c + 1"""
@query(_SAMPLED)
def j02_sample_grid_bilinear(spark, d):
    p = table(spark, d, "orders").select(F.col("o_orderkey").alias("point_id"), (F.col("o_custkey") % 390 / 10).alias("x"), (F.col("o_orderkey") / 300).alias("y"))
    return rounded(L.sample_grid(p, _grid(spark, d)))


#: A box of 16 columns and 11 rows for every customer; first rows go over the whole grid at every size.
_VIEWS = "w as (select c_custkey as view_id, (c_custkey % 25)::int as c0, (c_custkey // 30)::int as r0 from customer)"


def _views(spark, d):
    w = table(spark, d, "customer").select(F.col("c_custkey").alias("view_id"), (F.col("c_custkey") % 25).cast("int").alias("c0"), (F.col("c_custkey") / 30).cast("int").alias("r0"))
    return w.withColumns({"c1": F.col("c0") + 15, "r1": F.col("r0") + 10})


@query(f"with {_GRID} select g.r, g.c, round((e.z - w.z) / 4, 6) as zx, round((n.z - s.z) / 4, 6) as zy from g left join g e on e.r = g.r and e.c = g.c + 2 left join g w on w.r = g.r and w.c = g.c - 2 left join g n on n.r = g.r + 2 and n.c = g.c left join g s on s.r = g.r - 2 and s.c = g.c")
def g03_side_grids(spark, d):
    return rounded(L.side_grids(_grid(spark, d), 2, 1.0))


@query(f"with {_GRID} select g.r, g.c, case when count(h.z) = 9 then round(avg(h.z), 6) end as mean from g left join g h on h.r between g.r - 1 and g.r + 1 and h.c between g.c - 1 and g.c + 1 group by g.r, g.c")
def g04_box_mean(spark, d):
    return rounded(L.box_mean(_grid(spark, d), 1))


@query(
    f"""with {_GRID}, s as (select a.r, a.c, b.r - a.r as dr, b.c - a.c as dc, (a.z - b.z) / sqrt(power(a.r - b.r, 2) + power(a.c - b.c, 2)) as s from g a join g b on b.r between a.r - 1 and a.r + 1 and b.c between a.c - 1 and a.c + 1 where a.z > b.z)
    select r, c, dr, dc, round(power(s, 1.1) / sum(power(s, 1.1)) over (partition by r, c), 6) as weight from s"""
)
def g06_flow_weights(spark, d):
    return rounded(L.flow_weights(_grid(spark, d), 1.0).select("r", "c", "dr", "dc", "weight"))


@query("select p_partkey, case when p_size % 5 <> 0 and -10000 + (p_size * 65536 + p_partkey % 256 * 256 + p_partkey % 199) * 0.1e0 > -9999 then round(-10000 + (p_size * 65536 + p_partkey % 256 * 256 + p_partkey % 199) * 0.1e0, 6) end as mapbox, p_size * 256e0 + p_partkey % 256 + (p_partkey % 199) / 256e0 - 32768 as terrarium from part")
def s06_decode_dem_tiles(spark, d):
    p = table(spark, d, "part")
    r, g, b, a = F.col("p_size"), F.col("p_partkey") % 256, F.col("p_partkey") % 199, F.col("p_size") % 5
    return rounded(p.select("p_partkey", L.decode_rgb(r, g, b, a, "mapbox").alias("mapbox"), L.decode_rgb(r, g, b, a, "terrarium").alias("terrarium")))


def _vertices(spark, d):
    """Track points as lines in metres around the start."""
    p = adapted(spark, d, "track_points")
    return p.select(F.col("track_id").alias("line_id"), F.lit(0).alias("leg"), "seq", ((F.col("lon") + 151.19) * 56000).alias("x"), ((F.col("lat") - 59.62) * 111000).alias("y"))


_VERTICES = "v as (select track_id as line_id, seq, (lon + 151.19) * 56000 as x, (lat - 59.62) * 111000 as y from track_points)"


@query(
    f"""with {_VERTICES}, s as (select line_id, seq, sqrt(power(lead(x) over w - x, 2) + power(lead(y) over w - y, 2)) as l from v window w as (partition by line_id order by seq))
    select line_id, greatest(1, ceil(sum(l) / 5 - 1e-9))::bigint + 1 as samples, round(max(t) / greatest(1, ceil(sum(l) / 5 - 1e-9)), 5) as step from (select *, sum(l) over (partition by line_id) as t from s where l > 1e-9) group by line_id"""
)
def l01_resample_legs(spark, d):
    r = L.resample_legs(_vertices(spark, d), 5.0)
    return r.groupBy("line_id").agg(F.count("*").alias("samples"), F.round(F.max("d_leg") / (F.count("*") - 1), 5).alias("step"))


@query(
    f"""with {_VERTICES}, s as (select line_id, seq, sqrt(power(lead(x) over w - x, 2) + power(lead(y) over w - y, 2)) as l from v window w as (partition by line_id order by seq))
    select line_id, (sum(greatest(ceil(l / 4 - 1e-9), 1)) + 1)::bigint as points from s where l > 1e-9 group by line_id"""
)
def l02_densify(spark, d):
    return L.densify(_vertices(spark, d), ["line_id"], 4.0).groupBy("line_id").agg(F.count("*").alias("points"))


def _beside(spark, d):
    p = table(spark, d, "orders").select(F.col("o_orderkey").alias("point_id"), (F.col("o_custkey") * 5).cast("double").alias("x"), (F.col("o_orderkey") % 400 - 200).cast("double").alias("y"))
    return p, _vertices(spark, d).drop("leg").withColumn("x", F.col("x") + F.col("line_id") * 50)  # side by side, as trails lie


@query(
    f"""with {_VERTICES}, s as (select * from (select line_id, seq as seg, x, y, lead(x) over w as x2, lead(y) over w as y2 from (select line_id, seq, x + line_id * 50 as x, y from v) window w as (partition by line_id order by seq)) where x2 is not null and (x <> x2 or y <> y2)),
    p as (select o_orderkey as point_id, (o_custkey * 5)::double as px, (o_orderkey % 400 - 200)::double as py from orders),
    t as (select point_id, px, py, x, y, x2, y2, least(greatest(((px - x) * (x2 - x) + (py - y) * (y2 - y)) / (power(x2 - x, 2) + power(y2 - y, 2)), 0), 1) as t from p cross join s),
    m as (select point_id, min(sqrt(power(px - x - t * (x2 - x), 2) + power(py - y - t * (y2 - y), 2))) as distance from t group by point_id)
    select p.point_id, round(distance, 6) as distance from p left join m using (point_id)"""
)
def j06_nearest_on_lines(spark, d):
    return rounded(L.nearest_on_lines(*_beside(spark, d)).select("point_id", "distance"))


@query(
    f"""with {_VERTICES}, a as (select *, x - lag(x) over w as e1, y - lag(y) over w as e2, lead(x) over w - x as f1, lead(y) over w - y as f2 from v window w as (partition by line_id order by seq)),
    b as (select *, greatest(sqrt(e1 * e1 + e2 * e2), 1e-12) as la, greatest(sqrt(f1 * f1 + f2 * f2), 1e-12) as lb from a), c as (select *, e1 / la as ux, e2 / la as uy, acos(least(greatest((e1 * f1 + e2 * f2) / la / lb, -1), 1)) as t, case when e1 * f2 - e2 * f1 > 0 then 1 else -1 end as o from b),
    d as (select *, tan(least(t / 2, radians(89.5))) as h from c), e as (select *, least(greatest(1.5, least(4, 0.45 * least(la, lb) / h)) * h, 0.49 * least(la, lb)) as q from d),
    f as (select *, greatest(2, ceil(q / h * t / 0.75))::bigint as m from e), g as (select line_id, seq, 0 as j, x, y from f where t is null or t < radians(2) union all
    select line_id, seq, j, cx + q / h * cos(g0 + o * t * j / m), cy + q / h * sin(g0 + o * t * j / m) from (select *, atan2(-o * ux, o * uy) as g0, x - ux * q - uy * o * q / h as cx, y - uy * q + ux * o * q / h as cy, unnest(range(m + 1)) as j from f where t >= radians(2)) k),
    n as (select *, sqrt(power(x - lag(x) over w, 2) + power(y - lag(y) over w, 2)) as away from g window w as (partition by line_id order by seq, j)) select line_id, seq, j::int as j, round(x, 4) + 0 as x, round(y, 4) + 0 as y from n where away is null or away > 1e-6"""
)
def l04_fillet(spark, d):
    return rounded(L.fillet(_vertices(spark, d), 4.0, 0.75), 4)


@query(
    f"""with {_VERTICES}, s as (select * from (select line_id, seq, x, y, lead(x) over w as x2, lead(y) over w as y2 from v window w as (partition by line_id order by seq)) where x2 is not null and (x <> x2 or y <> y2)),
    c as (select p.line_id, p.seq as a, q.seq as b, (p.x2 - p.x) * (q.y - p.y) - (p.y2 - p.y) * (q.x - p.x) as s1, (p.x2 - p.x) * (q.y2 - p.y) - (p.y2 - p.y) * (q.x2 - p.x) as s2, (q.x2 - q.x) * (p.y - q.y) - (q.y2 - q.y) * (p.x - q.x) as s3, (q.x2 - q.x) * (p.y2 - q.y) - (q.y2 - q.y) * (p.x2 - q.x) as s4
    from s p join s q on p.line_id = q.line_id and q.seq - p.seq >= 2) select line_id, a, b from c where sign(s1) * sign(s2) < 0 and sign(s3) * sign(s4) < 0"""
)
def j19_self_crossings(spark, d):
    return L.self_crossings(_vertices(spark, d))


@query("select line_id, q, round(case when lo.d is null then hi.v when hi.d is null or hi.d = lo.d then lo.v else lo.v + (hi.v - lo.v) * (q - lo.d) / (hi.d - lo.d) end, 7) as z from (select line_id, unnest([500e0, 2500.5e0, 7000e0]) as q from (select distinct line_id from samples)) a, lateral (select arg_max(z, d) as v, max(d) as d from samples s where s.line_id = a.line_id and z is not null and d <= q) lo, lateral (select arg_min(z, d) as v, min(d) as d from samples s where s.line_id = a.line_id and z is not null and d >= q) hi")
def j08_interp_at(spark, d):
    s = adapted(spark, d, "samples").filter("z is not null")
    at = s.select("line_id").distinct().withColumn("q", F.explode(F.array(F.lit(500.0), F.lit(2500.5), F.lit(7000.0))))
    return rounded(L.interp_at(s, at, "z"), 7)


@query("select p_partkey, trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9_\\s-]', '', 'g'), '[-\\s]+', '-', 'g'), '-_') as slug from part")
def f11_slugify(spark, d):
    return table(spark, d, "part").select("p_partkey", S.slugify(F.col("p_name")).alias("slug"))


@query("select line_id, i, round(case when g <= 0 then 0.1 when g <= 10 then exp(ln(0.1) + (ln(10) - ln(0.1)) * g / 10) else 10 end, 6) as cost from (select line_id, i, sqrt(gx * gx + gy * gy) * 30 - 2 as g from samples)")
def f08_curve_value(spark, d):
    g = F.hypot("gx", "gy") * 30 - 2
    return rounded(adapted(spark, d, "samples").select("line_id", "i", S.curve_value(g, [(0, 0.1), (10, 10)]).alias("cost")))


@query("with c as (select l_orderkey as edge_id, l_linenumber as k, sum(l_discount) as low, sum(l_tax) as high from lineitem group by all), t as (select a.edge_id, a.k, coalesce(sum(b.low) filter (b.k < a.k), 0) + coalesce(sum(b.high) filter (b.k >= a.k), 0) as cost, abs(a.k - count(*) / 2) as off from c a join c b using (edge_id) group by a.edge_id, a.k) select edge_id, round(min(cost), 6) as cost from t group by edge_id")
def w18_switch_point(spark, d):
    c = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("edge_id"), F.col("l_linenumber").alias("k")).agg(F.sum("l_discount").alias("low"), F.sum("l_tax").alias("high"))
    best = L.switch_point(c)
    j = c.join(best.withColumnRenamed("k", "at"), "edge_id")
    return j.groupBy("edge_id").agg(F.round(F.sum(F.when(F.col("k") < F.col("at"), F.col("low")).otherwise(F.col("high"))), 6).alias("cost"))
