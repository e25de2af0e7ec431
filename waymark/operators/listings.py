"""Small joins and groupings of the catalogue that listings and exports are made of."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .catalogue import ancestors
from .rounds import settled


def bbox_filter(rows: DataFrame, west: float, south: float, east: float, north: float, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Rows in the box, edges included; the comparisons reach the scan."""
    return rows.filter(F.col(lon).between(west, east) & F.col(lat).between(south, north))


def extent(points: DataFrame, by: list[str], lon: str = "lon", lat: str = "lat") -> DataFrame:
    """(by, w, s, e, n) of the points of each group."""
    return points.groupBy(*by).agg(F.min(lon).alias("w"), F.min(lat).alias("s"), F.max(lon).alias("e"), F.max(lat).alias("n"))


def project_panel(alignments: DataFrame, legs: DataFrame, boxes: DataFrame | None = None) -> DataFrame:
    """(project_id, alignments, legs, variants, newest[, w, s, e, n]): counts of a project's alignments, of their legs and of those with a parent, the one taken last, and the box around those of ``boxes`` (alignment_id, w, s, e, n)."""
    a = alignments.join(legs.groupBy("alignment_id").agg(F.count("*").alias("_legs")), "alignment_id", "left")
    aggs = [F.count("*").alias("alignments"), F.sum(F.coalesce("_legs", F.lit(0))).alias("legs"), F.count("parent_id").alias("variants"), F.max_by("alignment_id", F.struct("taken_at", "alignment_id")).alias("newest")]
    if boxes is not None:
        a = a.join(boxes, "alignment_id", "left")
        aggs += [F.min("w").alias("w"), F.min("s").alias("s"), F.max("e").alias("e"), F.max("n").alias("n")]
    return a.groupBy("project_id").agg(*aggs)


def project_pages(projects: DataFrame, visible: DataFrame, alignments: DataFrame, legs: DataFrame, tracks: DataFrame) -> DataFrame:
    """(project_id, name, parents, children, alignments, tracks[, w, s, e, n]): what the page of every visible project shows, as arrays.

    ``projects``: project_id, name, parent_id; ``visible``: the project_ids that the user
    sees; ``alignments``: project_id, alignment_id, name, priority, parent_id [, w, s, e, n];
    ``legs``: alignment_id; ``tracks``, those the user sees: project_id, track_id, name,
    taken_at, length_m. Parents are (project_id, name), nearest first, and children by name,
    both only where the user sees them, though a hidden parent doesn't hide those above it;
    alignments (alignment_id, name, priority, parent_id, legs) go by priority and name,
    tracks newest first, undated ones last. A project without any has empty arrays.
    """
    seen = visible.select("project_id").distinct()
    shown = settled(projects.join(seen, "project_id", "left_semi").select("project_id", "name", "parent_id"))
    names = shown.select(F.col("project_id").alias("other"), F.col("name").alias("other_name"))
    listed = lambda rows, key, item, name: rows.groupBy("project_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(*key, item.alias("item")))), lambda x: x["item"]).alias(name))
    other = F.struct(F.col("other").alias("project_id"), F.col("other_name").alias("name"))
    chain = ancestors(projects.sparkSession, projects, "project_id").select(F.col("id").alias("project_id"), "depth", F.col("ancestor").alias("other"))
    parents = listed(chain.join(names, "other"), ["depth"], other, "parents")
    below = shown.filter("parent_id is not null").select(F.col("parent_id").alias("project_id"), F.col("project_id").alias("other"), F.col("name").alias("other_name"))
    children = listed(below, ["other_name", "other"], other, "children")
    counted = alignments.join(legs.groupBy("alignment_id").agg(F.count("*").alias("legs")), "alignment_id", "left").withColumn("legs", F.coalesce("legs", F.lit(0)))
    own = listed(counted, ["priority", "name", "alignment_id"], F.struct("alignment_id", "name", "priority", "parent_id", "legs"), "alignments")
    when = [F.col("taken_at").isNull().alias("undated"), (-F.unix_micros(F.col("taken_at").cast("timestamp"))).alias("age"), F.col("name").alias("by_name"), F.col("track_id").alias("by_id")]
    recent = listed(tracks, when, F.struct("track_id", "name", "taken_at", "length_m"), "tracks")
    out = shown.select("project_id", "name")
    for part in (parents, children, own, recent):
        name = part.columns[1]
        out = out.join(part, "project_id", "left").withColumn(name, F.coalesce(name, F.array().cast(part.schema[name].dataType)))
    if {"w", "s", "e", "n"} <= set(alignments.columns):
        out = out.join(alignments.groupBy("project_id").agg(F.min("w").alias("w"), F.min("s").alias("s"), F.max("e").alias("e"), F.max("n").alias("n")), "project_id", "left")
    return out


def legs_with_project(legs: DataFrame, alignments: DataFrame) -> DataFrame:
    """Legs with their alignment's project and whether it is a variant."""
    return legs.join(alignments.select("alignment_id", "project_id", F.col("parent_id").isNotNull().alias("variant")), "alignment_id")


def study_projects(alignments: DataFrame, on_trail: DataFrame) -> DataFrame:
    """(trail, project_id): the projects that have an alignment on a trail, from (trail, alignment_id)."""
    return alignments.select("alignment_id", "project_id").join(on_trail.select("trail", "alignment_id").distinct(), "alignment_id").select("trail", "project_id").distinct()


def longest_piece(pieces: DataFrame, by: str) -> DataFrame:
    """(by, piece, length, pieces): the longest piece, the smallest of equals, and how many there are."""
    return pieces.groupBy(by).agg(F.min_by("piece", F.struct(-F.col("length"), "piece")).alias("piece"), F.max("length").alias("length"), F.count("*").alias("pieces"))


def best_per_group(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """(by, value, name) of the row with the least value in each group, the smallest name of equals; rows without a value don't count."""
    return rows.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.min(value).alias(value), F.min_by(name, F.struct(value, name)).alias(name))


def combined(parts: dict[str, DataFrame]) -> DataFrame:
    """All parts one under the other, by column name, with the part's name as ``kind``."""
    rows = [p.withColumn("kind", F.lit(k)) for k, p in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)


def distinct_visible(rows: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """Rows whose key is allowed, each once however often it is."""
    return rows.join(allowed.select(key), key, "left_semi")


def catalog_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, state): "seen" in both, "created" in the new one only, "disabled" in the old one only; one full join."""
    o, n = (x.select(key).distinct().withColumn(f, F.lit(True)) for x, f in ((old, "_o"), (new, "_n")))
    return o.join(n, key, "full").select(key, F.when(F.col("_o").isNull(), "created").when(F.col("_n").isNull(), "disabled").otherwise("seen").alias("state"))
