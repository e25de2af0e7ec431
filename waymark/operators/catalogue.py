"""Catalogue tables: access, names, trees, sections, upserts, exports' numbering, saved comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .rounds import settled

# --- access ---------------------------------------------------------------------


def visible_rows(rows: DataFrame, user: dict | None, members: DataFrame | None = None) -> DataFrame:
    """Rows a user sees: public ones, gated ones for data users and staff, own ones, and those of projects the user is a member of; all for a superuser, public ones for nobody."""
    if user and user.get("superuser"):
        return rows
    seen = F.col("visibility") == "public"
    if user is None:
        return rows.filter(seen)
    if user.get("data_user") or user.get("staff"):
        seen |= F.col("visibility") == "gated"
    seen |= F.col("owner_id") == F.lit(user["id"])
    seen = F.coalesce(seen, F.lit(False))
    if members is None:
        return rows.filter(seen)
    own = members.filter(F.col("user_id") == F.lit(user["id"])).select(F.col("project_id").alias("_p")).distinct()
    return rows.join(own, rows["project_id"] == F.col("_p"), "left").filter(seen | F.col("_p").isNotNull()).drop("_p")


def can_edit(user: dict | None, owner: Column, visibility: Column, is_member: Column) -> Column:
    if user is None:
        return F.lit(False)
    if user.get("superuser"):
        return F.lit(True)
    return F.coalesce(owner == F.lit(user["id"]), F.lit(False)) | F.coalesce(is_member, F.lit(False)) | (F.lit(bool(user.get("trail_editor"))) & (visibility != "private"))


# --- names and kinds --------------------------------------------------------------

# Words for priorities, in the order they are looked for; codes of trail classes; kinds of legs.
PRIORITY_WORDS = [("preferred", 1), ("primary", 1), ("proposed", 1), ("alternate", 2), ("alternative", 2), ("option", 2), ("future", 3), ("someday", 3)]
TRAIL_CLASSES = ["major", "regular", "route", "ski", "sidewalk", "abandoned"]
LEG_KINDS = {"restored": "restore", "restore": "restore", "reroute": "reroute"}


def map_fields(props: Column, aliases: list[str]) -> Column:
    """First alias with a value, whatever the case of the names; trimmed."""
    low = F.map_from_entries(F.array_distinct(F.transform(F.map_entries(props), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))))
    return F.coalesce(*[F.nullif(F.trim(F.try_element_at(low, F.lit(a.lower()))), F.lit("")) for a in aliases])


def parse_priority(text: Column, default: int = 1) -> Column:
    t = F.lower(F.trim(text))
    exact = reduce(lambda w, kv: w.when(t == kv[0], kv[1]), PRIORITY_WORDS, F.when(F.lit(False), 0))
    number = t.try_cast("double")
    held = reduce(lambda w, kv: w.when(F.contains(t, F.lit(kv[0])), kv[1]), PRIORITY_WORDS, F.when(F.lit(False), 0))
    return F.coalesce(exact, F.when(number.isNotNull(), F.when(number >= 1, number.cast("int")).otherwise(default)), held, F.lit(default))


def priority_label(p: Column) -> Column:
    return F.when(p == 2, "alternate").when(p >= 3, "future").otherwise("preferred")


def leg_kind(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return reduce(lambda w, kv: w.when(t == kv[0], kv[1]), LEG_KINDS.items(), F.when(F.lit(False), "")).otherwise("new")


def classify_trail(symbol: Column, default: Column, area: Column, name: Column) -> DataFrame:
    """struct(trail_class, status, visibility, name) of an imported feature."""
    code = F.lower(F.trim(symbol))
    kind = F.when(F.coalesce(code, F.lit("")) == "", "regular").when(code.isin(TRAIL_CLASSES), code).otherwise("other")
    plain = F.nullif(F.trim(name), F.lit(""))
    where = F.nullif(F.trim(area), F.lit(""))
    label = F.concat(F.lit("Unnamed "), kind, F.coalesce(F.concat(F.lit(", "), where), F.lit("")))
    return F.struct(kind.alias("trail_class"), F.when(kind == "abandoned", "historic").otherwise("open").alias("status"), F.when(F.lower(F.trim(default)) == "hidden", "gated").otherwise("public").alias("visibility"), F.coalesce(plain, label).alias("name"))


def clean_note(text: Column, most: int = 5000) -> Column:
    """Line ends unified and white space trimmed; null when nothing or too much is left."""
    t = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"^\s+|\s+$", "")
    return F.when((F.length(t) > 0) & (F.length(t) <= most), t)


def suffixed(name: str, order: list, by: list[str] = ()) -> Column:
    """Repeated names get " (2)", " (3)" in order."""
    n = F.row_number().over(Window.partitionBy(*by, name).orderBy(*order))
    return F.when(n == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit(" ("), n.cast("string"), F.lit(")")))


_NUMBERED = r"^(.*)-([2-9]|[1-9][0-9]+)$"


def _readings(slug: Column) -> Column:
    """What a slug stands for: itself as a name, and the name before its number."""
    number = F.regexp_extract(slug, _NUMBERED, 2).try_cast("long")
    return F.array_compact(F.array(F.struct(slug.alias("base"), F.lit(1).cast("long").alias("n")), F.when(number.isNotNull(), F.struct(F.regexp_extract(slug, _NUMBERED, 1).alias("base"), number.alias("n")))))


def unique_slugs(rows: DataFrame, slug: str, order: list[str], taken: DataFrame) -> DataFrame:
    """``rows`` with slugs of which none repeats and none is in ``taken``.slug: as if each row in ``order`` took its own name, or the first of name-2, name-3, ... that is free.

    All rows take numbers at once, each knowing which slugs earlier rows of other names
    hold by the round before; that is repeated until no row moves. A row's slug follows
    from those before it only, so the rounds end; there are as many as names that clash in
    a chain. Rows that share an order key follow one another in some order. Null slugs stay.
    """
    base = settled(rows.withColumn("_id", F.monotonically_increasing_id()))
    key = F.struct(*order, "_id")
    asked = base.filter(F.col(slug).isNotNull()).select("_id", F.col(slug).alias("base"), key.alias("key"), F.row_number().over(Window.partitionBy(slug).orderBy(key)).cast("long").alias("k"))
    asked = settled(asked)
    names = asked.select("base").distinct()
    read = lambda f, held: f.select(F.explode(_readings(F.col("slug"))).alias("r"), held.alias("held"), F.col("own").alias("own")).select("r.base", "r.n", "held", "own").filter("own is null or own <> base").join(names, "base", "left_semi").select("base", "n", "held")
    nobody = F.lit(None).cast(asked.schema["key"].dataType)
    fixed = settled(read(taken.filter("slug is not null").select("slug", F.lit(None).cast("string").alias("own")).distinct(), nobody))
    now = asked.withColumn("n", F.col("k"))
    while True:
        called = now.withColumn("slug", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), F.col("n").cast("string"))))
        holders = called.groupBy("slug").agg(F.min_by("base", "key").alias("own"), F.min("key").alias("key"))
        used = fixed.union(read(holders, F.col("key"))).groupBy("base").agg(F.array_sort(F.collect_set(F.struct("n", "held"))).alias("used"))
        known = F.filter(F.coalesce("used", F.array().cast(used.schema["used"].dataType)), lambda u: u["held"].isNull() | (u["held"] < F.col("key")))
        number = F.aggregate(F.array_distinct(F.transform(known, lambda u: u["n"])), F.col("k"), lambda n, u: F.when(u <= n, n + 1).otherwise(n))
        moved = settled(called.join(used, "base", "left").select("_id", "base", "key", "k", number.alias("n"), F.col("n").alias("was"), "slug"))
        if moved.filter("n <> was").isEmpty():
            break
        now = moved.drop("was", "slug")
    final = moved.select("_id", F.col("slug").alias("_slug"))
    out = base.join(final, "_id", "left")
    return out.select(*[F.col("_slug").alias(c) if c == slug else F.col(c) for c in rows.columns])


# --- legs -------------------------------------------------------------------------


def validate_legs(legs: DataFrame) -> DataFrame:
    """(alignment_id, errors) from legs (alignment_id, leg, kind, effort_factor, coords array<struct<lon,lat>>); an empty list is valid, an alignment without legs isn't seen here."""
    from ..functions.scalars import equirect_m

    c = F.col
    bad = {
        "bad effort factor": ~c("effort_factor").between(0, 100),
        "legs do not meet": equirect_m(c("end.lon"), c("end.lat"), c("start.lon"), c("start.lat")) > 0.5,
        "out of range": F.exists("coords", lambda p: ~(p["lon"].between(-180, 180) & p["lat"].between(-90, 90))),
        "too few points": F.size("coords") < 2,
        "unknown kind": ~c("kind").isin("existing", "new", "reroute", "restore"),
    }
    flag = lambda k: F.coalesce(bad[k], F.lit(False)).alias(k)
    own = [k for k in bad if k != "legs do not meet"]
    # flags and a leg's two ends go on, not its vertices
    ends = [F.try_element_at("coords", F.lit(k)).alias(n) for k, n in ((1, "start"), (-1, "stop"))]
    small = legs.select("alignment_id", "leg", F.size("coords").alias("n"), *[flag(k) for k in own], *ends)
    # windows in one order: no map of all alignments is held in memory
    order = Window.partitionBy("alignment_id").orderBy("leg")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    met = small.withColumns({"end": F.lag("stop").over(order), "place": F.row_number().over(order)}).select("alignment_id", "leg", "place", "n", *own, flag("legs do not meet"))
    whole = met.select("alignment_id", "place", *[F.max(k).over(every).alias(k) for k in bad], F.count(F.lit(1)).over(every).alias("legs"), F.sum("n").over(every).alias("points")).filter("place = 1")
    found = [F.when(c(k), F.lit(k)) for k in bad] + [F.when(c("legs") > 500, F.lit("too many legs")), F.when(c("points") > 50000, F.lit("too many points"))]
    return whole.select("alignment_id", F.array_compact(F.array(*found)).alias("errors"))


def exact_joints(legs: DataFrame, near: float = 0.5, name_most: int = 200, notes_most: int = 5000) -> DataFrame:
    """``legs`` whose first vertex is the last one of the leg before where they meet within ``near`` metres, with names and notes cut to length."""
    from ..functions.scalars import equirect_m

    order = Window.partitionBy("alignment_id").orderBy("leg")
    end = F.lag(F.try_element_at("coords", F.lit(-1))).over(order)
    start = F.try_element_at("coords", F.lit(1))
    meets = F.coalesce(equirect_m(end["lon"], end["lat"], start["lon"], start["lat"]) <= near, F.lit(False))
    out = legs.withColumn("coords", F.when(meets, F.concat(F.array(end), F.slice("coords", 2, F.greatest(F.size("coords") - 1, F.lit(0))))).otherwise(F.col("coords")))
    return out.withColumns({c: F.substring(c, 1, most) for c, most in (("name", name_most), ("notes", notes_most)) if c in legs.columns})


def leg_range(picked: DataFrame) -> DataFrame:
    """(alignment_id, first, last, ok): picked legs without gaps or repeats."""
    out = picked.groupBy("alignment_id").agg(F.min("leg").alias("first"), F.max("leg").alias("last"), F.count("leg").alias("n"), F.count_distinct("leg").alias("u"))
    return out.select("alignment_id", "first", "last", ((F.col("n") == F.col("u")) & (F.col("last") - F.col("first") + 1 == F.col("n"))).alias("ok"))


# --- trees and sections -----------------------------------------------------------


def ancestors(spark: SparkSession, nodes: DataFrame, id_col: str, parent_col: str = "parent_id") -> DataFrame:
    """(id, depth, ancestor), nearest first; a chain that comes back on itself ends there.

    Known chains are doubled in length each round, so a tree of depth n takes about log2 n rounds, whatever its rows.
    """
    known = nodes.filter(F.col(parent_col).isNotNull() & (F.col(parent_col) != F.col(id_col))).select(F.col(id_col).alias("id"), F.lit(1).alias("depth"), F.col(parent_col).alias("ancestor"))
    known, reach = settled(known), 1
    while True:
        ends, above = known.filter(F.col("depth") == reach).select("id", F.col("ancestor").alias("at")), known.select(F.col("id").alias("at"), "depth", "ancestor")
        more = ends.join(above, "at").filter("ancestor <> id").select("id", (F.col("depth") + reach).alias("depth"), "ancestor")
        more = settled(more.join(known.select("id", "ancestor"), ["id", "ancestor"], "left_anti").groupBy("id", "ancestor").agg(F.min("depth").alias("depth")).select("id", "depth", "ancestor"))
        if more.isEmpty():
            return known
        known, reach = settled(known.union(more)), 2 * reach


def variant_tree(spark: SparkSession, nodes: DataFrame, id_col: str, parent_col: str = "parent_id") -> DataFrame:
    """(id, root, depth): a node whose parent is not among the nodes is a root; nodes of a ring have none and are left out.

    Each round every node jumps to where its ancestor has got, so a tree of depth n takes about log2 n rounds.
    """
    n = nodes.select(F.col(id_col).alias("id"), F.col(parent_col).alias("at"))
    parents = n.select(F.col("id").alias("at"), F.lit(True).alias("found"))
    started = n.join(parents, "at", "left").select("id", F.when(F.col("found"), F.col("at")).otherwise(F.col("id")).alias("root"), F.when(F.col("found"), 1).otherwise(0).alias("depth"), F.col("found").isNull().alias("done"))
    # a node next to a root is as good as done after the first round
    now, open_ = settled(started), None
    while True:
        left = now.filter("not done").count()
        if left == 0 or left == open_:
            return now.filter("done").select("id", "root", "depth")
        open_ = left
        jump = now.select(F.col("id").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"), F.col("done").alias("there"))
        moved = now.filter("not done").join(jump, "root").select("id", F.col("next").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), F.col("there").alias("done"))
        now = settled(now.filter("done").union(moved))


def move_with_variants(spark: SparkSession, nodes: DataFrame, id_col: str, moved, section) -> DataFrame:
    """(id, section_id): the moved node, and descendants reached through nodes of its old section, go to the new one."""
    was = nodes.filter(F.col(id_col) == F.lit(moved)).select(F.col("section_id").alias("_was"), F.lit(True).alias("_one"))
    inside = nodes.join(F.broadcast(was), F.col("section_id").eqNullSafe(F.col("_was"))).filter("_one")  # one row
    cut = inside.select(F.col(id_col).alias("id"), F.when(F.col(id_col) != F.lit(moved), F.col("parent_id")).alias("parent_id"))
    goes = variant_tree(spark, cut, "id").filter(F.col("root") == F.lit(moved)).select(F.col("id").alias("_id"))
    joined = nodes.join(goes, nodes[id_col] == goes["_id"], "left")
    return joined.select(F.col(id_col).alias("id"), F.when(F.col("_id").isNull(), F.col("section_id")).otherwise(F.lit(section)).alias("section_id"))


def renumber_sections(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    return rows.withColumn("section_order", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def move_section(rows: DataFrame, by: list[str], moved: Column, step: int) -> DataFrame:
    """The moved section changes places with its neighbour; at the ends nothing happens."""
    w = Window.partitionBy(*by).orderBy("section_order")
    flag = rows.withColumn("_m", moved)
    met = F.lag("_m").over(w) if step > 0 else F.lead("_m").over(w)
    goes = F.col("_m") & (F.lead("section_order").over(w) if step > 0 else F.lag("section_order").over(w)).isNotNull()
    return flag.withColumn("section_order", F.when(goes, F.col("section_order") + step).when(F.coalesce(met, F.lit(False)), F.col("section_order") - step).otherwise(F.col("section_order"))).drop("_m")


def duplicate_alignment(alignments: DataFrame, legs: DataFrame, source, new_id) -> tuple[DataFrame, DataFrame]:
    """The rows of a copy that is a variant of ``source``, named after how many variants there are."""
    count = alignments.filter(F.col("parent_id") == F.lit(source)).agg(F.count("*").alias("_n"))
    row = alignments.filter(F.col("alignment_id") == F.lit(source)).crossJoin(F.broadcast(count))  # one row with one count
    copy = row.withColumn("name", F.concat("name", F.lit(" variant "), (F.col("_n") + 2).cast("string"))).withColumn("parent_id", F.lit(source)).withColumn("alignment_id", F.lit(new_id)).drop("_n")
    return copy, legs.filter(F.col("alignment_id") == F.lit(source)).withColumn("alignment_id", F.lit(new_id))


# --- listings ---------------------------------------------------------------------


def listing_order(kind: str) -> list[Column]:
    """The order of a listing: alignments by priority and name, tracks latest first with undated ones before ("tiles": after) them, trails longest first, DEMs by kind, region and title."""
    c = F.col
    return {
        "alignments": [c("priority").asc(), c("name").asc()],
        "tracks": [c("taken_at").desc_nulls_first()],
        "tiles": [c("taken_at").desc_nulls_last()],
        "trails": [c("length_m").desc_nulls_last()],
        "dems": [c("kind").asc(), c("region").asc(), c("title").asc()],
    }[kind]


def placed(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """``rows`` with their ``place`` from 1 in each group."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def project_listing(projects: DataFrame, alignments: DataFrame, visible: DataFrame) -> DataFrame:
    """(project_id, name, alignments, parent): the parent is named only if it is visible itself."""
    counts = alignments.groupBy("project_id").agg(F.count("*").alias("alignments"))
    parents = visible.select(F.col("project_id").alias("parent_id"), F.col("name").alias("parent"))
    return projects.join(counts, "project_id", "left").join(parents, "parent_id", "left").select("project_id", "name", F.coalesce("alignments", F.lit(0)).alias("alignments"), "parent")


def merge_waypoints(points: DataFrame, by: list[str], joiner: str = " / ") -> DataFrame:
    """Waypoints at one place (4 decimals): names joined unless contained already, the first one's position, first-seen order."""
    rows = points.groupBy(*by, F.round("lon", 4).alias("_x"), F.round("lat", 4).alias("_y")).agg(F.array_sort(F.collect_list(F.struct("seq", "name", "lon", "lat"))).alias("p"))
    return rows.select(*by, F.col("p")[0]["seq"].alias("seq"), F.col("p")[0]["lon"].alias("lon"), F.col("p")[0]["lat"].alias("lat"), told_once("p", "name", joiner).alias("name"))


def told_once(rows: str, field: str, joiner: str) -> Column:
    """A field's texts in the order of the rows, joined; one that is in the text so far is left out."""
    return F.aggregate(rows, F.lit(""), lambda acc, x: F.when(acc == "", x[field]).when(F.contains(acc, x[field]), acc).otherwise(F.concat(acc, F.lit(joiner), x[field])))


# --- upserts ----------------------------------------------------------------------


def upsert(old: DataFrame, new: DataFrame, key: str, columns: list[str], keep: list[str] = (), delete: Column | None = None) -> DataFrame:
    """Merge by a unique key: (key, columns, keep, action). New values win, ``keep`` columns survive; rows absent from ``new`` that meet ``delete`` go."""
    o = old.select(key, *[F.col(c).alias(f"o_{c}") for c in (*columns, *keep)], F.lit(True).alias("_o"))
    n = new.select(key, *[F.col(c).alias(f"n_{c}") for c in columns], F.lit(True).alias("_n"))
    both = o.join(n, key, "full")
    gone = F.col("_n").isNull()
    action = F.when(F.col("_o").isNull(), "created").when(~gone, "updated").when(delete if delete is not None else F.lit(False), "deleted").otherwise("kept")
    values = [F.when(gone, F.col(f"o_{c}")).otherwise(F.col(f"n_{c}")).alias(c) for c in columns]
    return both.select(key, *values, *[F.col(f"o_{c}").alias(c) for c in keep], action.alias("action"))


def gone_rows(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.join(new, key, "left_anti")


# --- comparing a saved evaluation with the current one ------------------------------


def compare_saved_now(saved: DataFrame, now: DataFrame, key: str, better: dict[str, int]) -> DataFrame:
    """(key, metric, saved, now, delta, verdict); changes within 0.5 % or 0.05 are suppressed. ``better``: 1 if more is better, -1 if less, 0 if neither."""
    metrics = list(better)
    s, n = (x.unpivot([key], [F.col(m).cast("double").alias(m) for m in metrics], "metric", v) for x, v in ((saved, "saved"), (now, "now")))
    joined = s.join(n, [key, "metric"]).withColumn("delta", F.col("now") - F.col("saved")).filter(F.abs("delta") > F.greatest(0.005 * F.abs("saved"), F.lit(0.05)))
    way = F.create_map(*[F.lit(x) for kv in better.items() for x in kv])[F.col("metric")]
    return joined.withColumn("verdict", F.when(way * F.col("delta") > 0, "better").when(way * F.col("delta") < 0, "worse"))


def merged_settings(*layers: Column) -> Column:
    """Maps merged left to right: later layers win, nulls change nothing."""
    return reduce(lambda a, b: F.map_zip_with(a, b, lambda k, x, y: F.coalesce(y, x)), [F.coalesce(x, F.expr("cast(map() as map<string,double>)")) for x in layers])


def merged_factors(defaults: Column, *layers: Column) -> Column:
    """Factor settings (map of struct<k, curve>) laid over the defaults, left to right: a layer changes the ``k`` and the ``curve`` that it gives; names that the defaults don't have are left out."""

    def over(old: Column, layer: Column) -> Column:
        changed = lambda name, f: F.struct(*[F.coalesce(F.try_element_at(layer, name)[p], f[p]).alias(p) for p in ("k", "curve")])
        return F.when(layer.isNull(), old).otherwise(F.transform_values(old, changed))

    return reduce(over, layers, defaults)
