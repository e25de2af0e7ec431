"""Lines cut to slippy map tiles, in the tiles' own integer coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import lonlat_to_tile_px

EXTENT, BUFFER, LEAST_ZOOM, MOST_ZOOM = 4096, 64, 5, 18


def _clip(low: Column, high: Column, start: Column, step: Column, least: float, most: float) -> tuple[Column, Column]:
    """The part of a segment's parameters for which ``start + t step`` lies between the bounds."""
    a, b = F.try_divide(least - start, step), F.try_divide(most - start, step)
    outside = (start < least) | (start > most)
    still = step == 0
    return F.when(still, F.when(outside, 2.0).otherwise(low)).otherwise(F.greatest(low, F.least(a, b))), F.when(still, high).otherwise(F.least(high, F.greatest(a, b)))


def tile_segments(vertices: DataFrame, zooms: list[int]) -> DataFrame:
    """(line_id, z, tx, ty, seq, x1, y1, x2, y2): every segment in each tile whose buffered square it meets, cut to it, in whole units of 1/4096 tile from the tile's corner; segments of no length go.

    ``vertices`` has line_id, seq, lon, lat. Zooms outside 5 to 18 have no tiles.
    """
    w = Window.partitionBy("line_id").orderBy("seq")
    rows = vertices.withColumn("z", F.explode(F.array(*[F.lit(z) for z in zooms if LEAST_ZOOM <= z <= MOST_ZOOM])))
    w = Window.partitionBy("line_id", "z").orderBy("seq")
    u, v = lonlat_to_tile_px(F.col("lon"), F.col("lat"), F.col("z"), EXTENT)
    s = rows.withColumns({"u": u, "v": v}).withColumns({"u2": F.lead("u").over(w), "v2": F.lead("v").over(w)}).filter("u2 is not null")
    span = lambda a, b: F.sequence(F.floor((F.least(a, b) - BUFFER) / EXTENT), F.floor((F.greatest(a, b) + BUFFER) / EXTENT))
    last = F.pow(F.lit(2), F.col("z")) - 1
    s = s.withColumn("tx", F.explode(span("u", "u2"))).withColumn("ty", F.explode(span("v", "v2"))).filter(F.col("tx").between(0, last) & F.col("ty").between(0, last))
    s = s.withColumns({"x0": F.col("u") - F.col("tx") * EXTENT, "y0": F.col("v") - F.col("ty") * EXTENT, "dx": F.col("u2") - F.col("u"), "dy": F.col("v2") - F.col("v")})
    low, high = _clip(F.lit(0.0), F.lit(1.0), F.col("x0"), F.col("dx"), -BUFFER, EXTENT + BUFFER)
    s = s.withColumns({"low": low, "high": high})
    low, high = _clip(F.col("low"), F.col("high"), F.col("y0"), F.col("dy"), -BUFFER, EXTENT + BUFFER)
    s = s.withColumns({"low": low, "high": high}).filter("low <= high")
    at = lambda c, t: F.round(F.col(f"{c}0") + F.col(t) * F.col(f"d{c}")).cast("int")
    out = s.select("line_id", "z", "tx", "ty", "seq", at("x", "low").alias("x1"), at("y", "low").alias("y1"), at("x", "high").alias("x2"), at("y", "high").alias("y2"))
    return out.filter("x1 <> x2 or y1 <> y2")


def tile_features(vertices: DataFrame, attributes: DataFrame, zooms: list[int], order: list[Column]) -> DataFrame:
    """(z, tx, ty, place, line_id, parts, attributes ...): a row per line and tile, places from 1 in ``order`` of the attributes; ``parts`` are runs of points, a new one wherever the line left the tile.

    Give the attributes (line_id and more) of visible lines only.
    """
    cuts = tile_segments(vertices, zooms)
    w = Window.partitionBy("z", "tx", "ty", "line_id").orderBy("seq")
    broken = (F.lag("x2").over(w) != F.col("x1")) | (F.lag("y2").over(w) != F.col("y1")) | F.lag("x2").over(w).isNull()
    parted = cuts.withColumn("part", F.sum(broken.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = F.array_sort(F.collect_list(F.struct("seq", F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")).alias("p"))))
    first = F.min_by(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), "seq")
    runs = parted.groupBy("z", "tx", "ty", "line_id", "part").agg(F.concat(F.array(first), F.transform(ends, lambda e: e["p"])).alias("points"))
    lines = runs.groupBy("z", "tx", "ty", "line_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "points"))), lambda r: r["points"]).alias("parts"))
    placed = lines.join(attributes, "line_id").withColumn("place", F.row_number().over(Window.partitionBy("z", "tx", "ty").orderBy(*order)))
    return placed.select("z", "tx", "ty", "place", "line_id", "parts", *[c for c in attributes.columns if c != "line_id"])
