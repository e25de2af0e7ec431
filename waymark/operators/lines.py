"""Line geometry on vertex tables (line_id, leg, seq, x, y): resampling, nearest points, crossings, terrain grids, costs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import packed
from .rounds import settled


def segments(vertices: DataFrame, by: list[str]) -> DataFrame:
    """(by, seg, x, y, x2, y2, length, c0): segments with the distance at their start; those of no length dropped."""
    w = Window.partitionBy(*by).orderBy("seq")
    s = vertices.select(*by, F.col("seq").alias("seg"), "x", "y", F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2")).filter("x2 is not null")
    s = s.withColumn("length", F.hypot(F.col("x2") - F.col("x"), F.col("y2") - F.col("y"))).filter("length > 0")
    upto = F.sum("length").over(Window.partitionBy(*by).orderBy("seg").rowsBetween(Window.unboundedPreceding, 0))
    return s.withColumn("c0", upto - F.col("length"))


def resample_legs(vertices: DataFrame, spacing: float = 1.524, rule: str = "ceil") -> DataFrame:
    """(line_id, leg, k, x, y, d_leg): equal steps in every leg, a joint belongs to the earlier leg. "ceil" steps are at most the spacing, "round" as near it as can be."""
    by = ["line_id", "leg"]
    seg = segments(vertices, by)
    whole = Window.partitionBy(*by)
    total = F.sum("length").over(whole)
    n = F.greatest(F.lit(1), (F.ceil(total / spacing - 1e-9) if rule == "ceil" else F.bround(total / spacing)).cast("int"))
    seg = seg.withColumns({"total": total, "n": n, "last": F.max("seg").over(whole), "first_leg": F.min("leg").over(Window.partitionBy("line_id"))})
    step = F.col("total") / F.col("n")
    low = F.floor(F.col("c0") / step + 1e-9).cast("int") + 1
    high = F.when(F.col("seg") == F.col("last"), F.col("n")).otherwise(F.floor((F.col("c0") + F.col("length")) / step + 1e-9).cast("int"))
    low = F.when((F.col("c0") == 0) & (F.col("leg") == F.col("first_leg")), 0).otherwise(low)
    out = seg.withColumns({"low": low, "high": high, "step": step}).filter("low <= high").withColumn("k", F.explode(F.sequence("low", "high")))
    t = F.least(F.greatest((F.col("k") * F.col("step") - F.col("c0")) / F.col("length"), F.lit(0.0)), F.lit(1.0))
    return out.select(*by, "k", (F.col("x") + t * (F.col("x2") - F.col("x"))).alias("x"), (F.col("y") + t * (F.col("y2") - F.col("y"))).alias("y"), (F.col("k") * F.col("step")).alias("d_leg"))


def densify(vertices: DataFrame, by: list[str], step: float) -> DataFrame:
    """Every vertex kept, and points between so that no gap exceeds ``step``."""
    seg = segments(vertices, by)
    n = F.greatest(F.ceil(F.col("length") / step - 1e-9), F.lit(1)).cast("int")
    low = F.when(F.col("c0") == 0, 0).otherwise(1)
    out = seg.withColumns({"n": n, "j": F.explode(F.sequence(low, n))})
    t = F.col("j") / F.col("n")
    return out.select(*by, "seg", "j", (F.col("x") + t * (F.col("x2") - F.col("x"))).alias("x"), (F.col("y") + t * (F.col("y2") - F.col("y"))).alias("y"), (F.col("c0") + t * F.col("length")).alias("d"))


def resample_quick(vertices: DataFrame, by: list[str], spacing: float) -> DataFrame:
    """(by, seg, j, x, y): every segment in equal steps, as near the spacing as can be, one at least; each vertex once."""
    seg = segments(vertices, by)
    n = F.greatest(F.floor(F.col("length") / spacing + 0.5), F.lit(1)).cast("int")
    out = seg.withColumns({"n": n, "j": F.explode(F.sequence(F.when(F.col("c0") == 0, 0).otherwise(1), n))})
    t = F.col("j") / F.col("n")
    return out.select(*by, "seg", "j", (F.col("x") + t * (F.col("x2") - F.col("x"))).alias("x"), (F.col("y") + t * (F.col("y2") - F.col("y"))).alias("y"))


def rebuild_from_legs(vertices: DataFrame) -> DataFrame:
    """Legs in order as one line; a vertex equal to the one before it goes."""
    w = Window.partitionBy("line_id").orderBy("leg", "seq")
    again = (F.col("x") == F.lag("x").over(w)) & (F.col("y") == F.lag("y").over(w))
    kept = vertices.withColumn("_a", F.coalesce(again, F.lit(False))).filter("not _a").drop("_a")
    return kept.withColumn("n", F.row_number().over(w) - 1)


def fillet(vertices: DataFrame, radius: float, step: float, least: float = 1.5) -> DataFrame:
    """(line_id, seq, j, x, y): interior vertices become arcs tangent to both neighbours, a point every ``step`` metres or closer, two steps at least.

    An arc has the radius asked for, less where its tangents would take more than 45 % of
    a neighbour, but ``least`` if that leaves tangents of at most 49 %. Turns under 2
    degrees stay as they are; points that coincide with the one before them go.
    """
    w = Window.partitionBy("line_id").orderBy("seq")
    v = vertices.withColumns({"ax": F.col("x") - F.lag("x").over(w), "ay": F.col("y") - F.lag("y").over(w), "bx": F.lead("x").over(w) - F.col("x"), "by": F.lead("y").over(w) - F.col("y")})
    v = v.withColumns({"la": F.greatest(F.hypot("ax", "ay"), F.lit(1e-12)), "lb": F.greatest(F.hypot("bx", "by"), F.lit(1e-12))})
    v = v.withColumns({"ax": F.col("ax") / F.col("la"), "ay": F.col("ay") / F.col("la"), "bx": F.col("bx") / F.col("lb"), "by": F.col("by") / F.col("lb")})
    turn = F.acos(F.least(F.greatest(F.col("ax") * F.col("bx") + F.col("ay") * F.col("by"), F.lit(-1.0)), F.lit(1.0)))
    side = F.when(F.col("ax") * F.col("by") - F.col("ay") * F.col("bx") > 0, 1.0).otherwise(-1.0)
    v = v.withColumns({"turn": turn, "side": side}).withColumn("half", F.greatest(F.tan(F.least(F.col("turn") / 2, F.lit(math.radians(89.5)))), F.lit(1e-9)))
    short = F.least("la", "lb")
    wanted = F.greatest(F.lit(float(least)), F.least(F.lit(float(radius)), 0.45 * short / F.col("half")))
    v = v.withColumn("reach", F.least(wanted * F.col("half"), 0.49 * short)).withColumn("r", F.col("reach") / F.col("half"))
    bends = F.coalesce(F.col("turn") >= math.radians(2), F.lit(False))
    v = v.withColumn("m", F.when(bends, F.greatest(F.lit(2), F.ceil(F.col("r") * F.col("turn") / step)).cast("int"))).withColumn("j", F.explode(F.when(F.col("m").isNotNull(), F.sequence(F.lit(0), F.col("m"))).otherwise(F.array(F.lit(0)))))
    px, py = F.col("x") - F.col("ax") * F.col("reach"), F.col("y") - F.col("ay") * F.col("reach")
    cx, cy = px - F.col("ay") * F.col("side") * F.col("r"), py + F.col("ax") * F.col("side") * F.col("r")
    angle = F.atan2(py - cy, px - cx) + F.col("side") * F.col("turn") * F.col("j") / F.col("m")
    arc = lambda centre, f, own: F.when(F.col("m").isNotNull(), centre + F.col("r") * f(angle)).otherwise(F.col(own)).alias(own)
    out = v.select("line_id", "seq", "j", arc(cx, F.cos, "x"), arc(cy, F.sin, "y"))
    w = Window.partitionBy("line_id").orderBy("seq", "j")
    moved = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    return out.withColumn("_moved", moved).filter("_moved is null or _moved > 1e-6").drop("_moved")


def _cells(x: Column, y: Column, size: float, ring: int = 0) -> Column:
    span = F.sequence(F.lit(-ring), F.lit(ring))
    return F.flatten(F.transform(span, lambda i: F.transform(span, lambda j: F.struct((F.floor(x / size) + i).alias("cx"), (F.floor(y / size) + j).alias("cy")))))


def _segment_cells(size: float, pad: float = 1e-6) -> Column:
    """The grid cells that a segment (x, y, x2, y2) touches or comes within ``pad`` of, column by column; about its length over ``size`` of them."""
    low, high = F.least("x", "x2"), F.greatest("x", "x2")
    rise = F.try_divide(F.col("y2") - F.col("y"), F.col("x2") - F.col("x"))

    def rows(i: Column) -> Column:
        a, b = (F.coalesce(F.col("y") + (edge - F.col("x")) * rise, other) for edge, other in ((F.greatest(i * size - pad, low), F.col("y")), (F.least((i + 1) * size + pad, high), F.col("y2"))))
        least, most = F.greatest(F.least(a, b), F.least("y", "y2")), F.least(F.greatest(a, b), F.greatest("y", "y2"))
        return F.sequence(F.floor((least - pad) / size), F.floor((most + pad) / size))

    columns = F.sequence(F.floor((low - pad) / size), F.floor((high + pad) / size))
    return F.flatten(F.transform(columns, lambda i: F.transform(rows(i), lambda j: F.struct(i.alias("cx"), j.alias("cy")))))


def nearest_on_lines(points: DataFrame, lines: DataFrame, limit: float | None = None, same_line: bool = False) -> DataFrame:
    """(point_id, line_id, seg, distance, along): nearest place on any line, at any distance; with ``limit``, null beyond so many metres. The first segment wins ties.

    With ``same_line`` a point has a line_id and looks at that line only.
    """
    keys = ["line_id"] if same_line else []
    if limit is not None:
        return _near_within(points, lines, keys, float(limit))
    best = _near_at_any_distance(points, lines, keys).groupBy("point_id").agg(F.min(F.struct("distance", "line_id", "seg", "along")).alias("b"))
    return points.select("point_id").join(best, "point_id", "left").select("point_id", "b.line_id", "b.seg", "b.distance", "b.along")


def _near_within(points: DataFrame, lines: DataFrame, keys: list[str], limit: float) -> DataFrame:
    """Nearest places within ``limit``. A segment is listed in every cell that it comes within the limit of, so a point looks at its own cell only and moves once."""
    size, pad = 2 * limit, limit * (1 + 1e-9) + 1e-6
    seg = segments(lines, ["line_id"]).withColumn("cell", F.explode(_segment_cells(size, pad)))
    own = F.struct("line_id", "seg", "x", "y", (F.col("x2") - F.col("x")).alias("dx"), (F.col("y2") - F.col("y")).alias("dy"), "length", "c0")
    listed = seg.groupBy(*keys, "cell.cx", "cell.cy").agg(F.collect_list(own).alias("near"))
    p = points.select("point_id", *keys, F.col("x").alias("px"), F.col("y").alias("py")).withColumns({"cx": F.floor(F.col("px") / size), "cy": F.floor(F.col("py") / size)})

    def share(s: Column) -> Column:
        t = ((F.col("px") - s["x"]) * s["dx"] + (F.col("py") - s["y"]) * s["dy"]) / (s["length"] * s["length"])
        return F.struct(s.alias("s"), F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)).alias("t"))

    def place(q: Column) -> Column:
        s, t = q["s"], q["t"]
        distance = F.hypot(F.col("px") - s["x"] - t * s["dx"], F.col("py") - s["y"] - t * s["dy"])
        return F.struct(distance.alias("distance"), s["line_id"].alias("line_id"), s["seg"].alias("seg"), (s["c0"] + t * s["length"]).alias("along"))

    best = F.array_min(F.filter(F.transform(F.transform("near", share), place), lambda q: q["distance"] <= limit))
    met = p.join(listed.hint("shuffle_hash"), [*keys, "cx", "cy"], "left").select("point_id", best.alias("b"))
    return met.select("point_id", "b.line_id", "b.seg", "b.distance", "b.along")


def _cut_to_cells(rows: DataFrame, keys: list[str], x: Column, y: Column, each: int, least: float = 0.0) -> tuple[DataFrame, int]:
    """``rows`` with cx and cy, their cells in a square that is cut in 4 x 4 until a taken cell holds ``each`` rows on average or is about ``least`` wide; and how often it is cut. Two actions."""
    size = rows.agg(F.count("*").alias("n"), *[f(m).alias(k) for k, f, m in (("x0", F.min, x), ("x1", F.max, x), ("y0", F.min, y), ("y1", F.max, y))]).first()
    wide = max(size.x1 - size.x0, size.y1 - size.y0, least) or 1.0 if size.n else 1.0
    deepest = max(1, min(12, int(math.log(wide / least, 4)) if least > 0 else 12))
    at = lambda k: [F.least(F.floor((m - F.lit(low or 0.0)) / F.lit(wide) * 4**k), F.lit(4**k - 1)) for m, low in ((x, size.x0), (y, size.y0))]
    taken = rows.agg(*[F.approx_count_distinct(F.struct(*keys, *at(k))) for k in range(1, deepest + 1)]).first()
    depth = next((k for k in range(1, deepest + 1) if size.n <= each * taken[k - 1]), deepest)
    cx, cy = at(depth)
    return rows.withColumns({"cx": cx, "cy": cy}), depth


def _near_at_any_distance(points: DataFrame, lines: DataFrame, keys: list[str], points_each: int = 128, segments_each: int = 64) -> DataFrame:
    """(point_id, line_id, seg, distance, along): the nearest place of each finite point, from one or several blocks of segments.

    Branch and bound by blocks of points: points that lie together go down a tree of cells as one
    box, to leaves of at most ``segments_each`` segments. Each side of a leaf's or cell's box is
    touched by a segment, which bounds the distance of a whole block from above; what is farther
    goes. A block's own points then rule out leaves once more, and only the rest meet its points.
    So points move once, however many cells are near.
    """
    seg = settled(segments(lines, ["line_id"]).filter("length < double('infinity')"))
    long = seg.agg(F.avg("length")).first()[0] or 0.0
    mx, my = (F.col("x") + F.col("x2")) / 2, (F.col("y") + F.col("y2")) / 2
    seg, depth = _cut_to_cells(seg, keys, mx, my, segments_each, long)
    chunk = F.floor((F.row_number().over(Window.partitionBy(*keys, "cx", "cy").orderBy(mx, my)) - 1) / segments_each)
    edges = (("xl", F.min, F.least, "x", "x2"), ("xh", F.max, F.greatest, "x", "x2"), ("yl", F.min, F.least, "y", "y2"), ("yh", F.max, F.greatest, "y", "y2"))
    own = F.array_sort(F.collect_list(F.struct("line_id", "seg", "x", "y", "x2", "y2", "length", "c0"))).alias("segs")
    leaves = seg.withColumn("chunk", chunk).groupBy(*keys, "cx", "cy", "chunk").agg(own, *[f(g(a, b)).alias(n) for n, f, g, a, b in edges])
    leaves = settled(leaves.withColumn("leaf", F.monotonically_increasing_id()))

    p = points.select("point_id", *keys, F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py")).filter("abs(px) < double('infinity') and abs(py) < double('infinity')")
    p, _ = _cut_to_cells(p, keys, F.col("px"), F.col("py"), points_each)
    part = F.floor((F.row_number().over(Window.partitionBy(*keys, "cx", "cy").orderBy("px", "py")) - 1) / (4 * points_each))
    blocks = p.withColumn("part", part).groupBy(*keys, "cx", "cy", "part").agg(F.collect_list(F.struct("point_id", "px", "py")).alias("points"), *[f(c).alias(n) for n, f, c in (("pxl", F.min, "px"), ("pxh", F.max, "px"), ("pyl", F.min, "py"), ("pyh", F.max, "py"))])
    blocks = settled(blocks.withColumn("block", F.monotonically_increasing_id()))

    at = blocks.select("block", *keys, "pxl", "pxh", "pyl", "pyh", F.lit(0).cast("long").alias("ux"), F.lit(0).cast("long").alias("uy"))
    for k in range(1, depth + 1):
        own = [F.shiftright(c, 2 * (depth - k)).alias(c) for c in ("cx", "cy")]
        nodes = leaves.select("leaf", *keys, "cx", "cy", "xl", "xh", "yl", "yh") if k == depth else leaves.groupBy(*keys, *own).agg(*[f(n).alias(n) for n, f, *_ in edges])
        nodes = nodes.withColumns({"ux": F.shiftright("cx", 2), "uy": F.shiftright("cy", 2)})
        few = not keys and k <= 4 and k < depth  # at most 65,536 nodes, whatever the input
        f = at.join(F.broadcast(nodes) if few else nodes, [*keys, "ux", "uy"])
        away = lambda a, b, q: F.greatest(F.abs(F.col(a) - F.col(q)), F.abs(F.col(b) - F.col(q)))
        (nx, fx, lx), (ny, fy, ly) = (
            (F.least(away(a, b, lo), away(a, b, hi)), F.greatest(away(a, b, lo), away(a, b, hi)), F.greatest(F.col(lo) - F.col(b), F.col(a) - F.col(hi), F.lit(0.0)))
            for a, b, lo, hi in (("pxl", "pxh", "xl", "xh"), ("pyl", "pyh", "yl", "yh"))
        )
        f = f.withColumns({"least": F.hypot(lx, ly), "most": F.least(F.hypot(nx, fy), F.hypot(fx, ny))})
        f = f.withColumn("most", F.min("most").over(Window.partitionBy("block"))).filter(F.col("least") <= F.col("most") * (1 + 1e-9) + 1e-6)
        if k < depth:
            at = f.select("block", *keys, "pxl", "pxh", "pyl", "pyh", F.col("cx").alias("ux"), F.col("cy").alias("uy"))
    listed = f.groupBy("block").agg(F.collect_list(F.struct("leaf", "xl", "xh", "yl", "yh")).alias("leaves"))
    xy = F.transform("points", lambda q: F.struct(q["px"].alias("px"), q["py"].alias("py"))).alias("points")
    needed = listed.join(blocks.select("block", xy), "block").mapInArrow(_needed_leaves, "block long, leaf long")
    met = needed.join(leaves.select("leaf", "segs"), "leaf").join(blocks.select("block", "points").hint("merge"), "block")
    types = [f"point_id {points.schema['point_id'].dataType.simpleString()}", *[f"{c} {lines.schema[n].dataType.simpleString()}" for c, n in (("line_id", "line_id"), ("seg", "seq"))]]
    return met.select("block", "segs", "points").mapInArrow(_nearest_in_blocks, ", ".join([*types, "distance double", "along double"]))


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """Offsets of a column of lists of structs, and the fields of all its items."""
    lists = batch.column(name)
    items = lists.values
    return lists.offsets.to_numpy(), {n: items.field(n) for n in (f.name for f in items.type)}


def _needed_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, leaf): leaves whose box comes as near to one of the block's points as the nearest segment can be."""
    for batch in batches:
        at, points = _lists(batch, "points")
        of, boxes = _lists(batch, "leaves")
        px, py, leaf = points["px"].to_numpy(), points["py"].to_numpy(), boxes["leaf"].to_numpy()
        sides = np.stack([boxes[n].to_numpy() for n in ("xl", "xh", "yl", "yh")])
        blocks, out = batch.column("block").to_numpy(), []
        for k in range(batch.num_rows):
            xl, xh, yl, yh = sides[:, of[k] : of[k + 1]]
            keep = np.zeros(len(xl), bool)
            step = max(1, 500_000 // len(xl))
            for i in range(at[k], at[k + 1], step):
                x, y = (v[i : min(i + step, at[k + 1]), None] for v in (px, py))
                ax, bx, ay, by = np.abs(x - xl), np.abs(x - xh), np.abs(y - yl), np.abs(y - yh)
                most = np.minimum(np.hypot(np.minimum(ax, bx), np.maximum(ay, by)), np.hypot(np.maximum(ax, bx), np.minimum(ay, by))).min(1, keepdims=True)
                least = np.hypot(np.maximum(np.maximum(xl - x, x - xh), 0), np.maximum(np.maximum(yl - y, y - yh), 0))
                keep |= (least <= most * (1 + 1e-9) + 1e-6).any(0)
            found = leaf[of[k] : of[k + 1]][keep]
            out.append((np.full(len(found), blocks[k]), found))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["block", "leaf"])


def _nearest_in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nearest place of each point in the leaves that come one after another with the same block; the first segment wins ties."""
    names = ["point_id", "line_id", "seg", "distance", "along"]
    block, ids, best = None, None, None

    def told():
        return pa.RecordBatch.from_arrays([ids, *[pa.array(best[n].tolist(), types[n]) if n in types else pa.array(best[n]) for n in names[1:]]], names)

    for batch in batches:
        at, points = _lists(batch, "points")
        of, segs = _lists(batch, "segs")
        types = {n: segs[n].type for n in ("line_id", "seg")}
        s = {n: a.to_numpy(zero_copy_only=False) for n, a in segs.items()}
        px, py = points["px"].to_numpy(), points["py"].to_numpy()
        for k, own in enumerate(batch.column("block").to_numpy()):
            i, j = slice(at[k], at[k + 1]), slice(of[k], of[k + 1])
            x, y, dx, dy = s["x"][j], s["y"][j], s["x2"][j] - s["x"][j], s["y2"][j] - s["y"][j]
            gx, gy = px[i, None] - x, py[i, None] - y
            t = np.clip((gx * dx + gy * dy) / (s["length"][j] * s["length"][j]), 0.0, 1.0)
            away = np.hypot(gx - t * dx, gy - t * dy)
            first = away.argmin(1)
            row = np.arange(len(first))
            got = {"distance": away[row, first], "line_id": s["line_id"][j][first], "seg": s["seg"][j][first], "along": s["c0"][j][first] + t[row, first] * s["length"][j][first]}
            if block != own:
                if best is not None:
                    yield told()
                block, ids, best = own, points["point_id"].slice(at[k], at[k + 1] - at[k]), got
                continue
            a, b = got, best
            same = lambda n: a[n] == b[n]
            better = (a["distance"] < b["distance"]) | (same("distance") & ((a["line_id"] < b["line_id"]) | (same("line_id") & (a["seg"] < b["seg"]))))
            best = {n: np.where(better, a[n], b[n]) for n in got}
    if best is not None:
        yield told()


def interp_at(profile: DataFrame, at: DataFrame, value: str) -> DataFrame:
    """(line_id, q, value): linear between samples (line_id, d), held at the ends, for the distances ``at`` (line_id, q)."""
    here = profile.select("line_id", F.col("d").alias("pos"), F.struct("d", F.col(value).alias("v")).alias("s"), F.lit(None).cast("double").alias("q"))
    asked = at.select("line_id", F.col("q").cast("double").alias("pos"), F.lit(None).cast(here.schema["s"].dataType).alias("s"), F.col("q").cast("double").alias("q"))
    up = Window.partitionBy("line_id").orderBy("pos", F.col("s").isNull().cast("int")).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("line_id").orderBy(F.desc("pos"), F.col("s").isNull().cast("int").desc()).rowsBetween(Window.unboundedPreceding, 0)
    both = here.union(asked).withColumns({"a": F.last("s", True).over(up), "b": F.last("s", True).over(down)}).filter("q is not null")
    a, b = F.coalesce("a", "b"), F.coalesce("b", "a")
    mixed = F.when(b["d"] > a["d"], a["v"] + (b["v"] - a["v"]) * (F.col("q") - a["d"]) / (b["d"] - a["d"])).otherwise(a["v"])
    return both.select("line_id", "q", mixed.alias(value))


def read_around(samples: DataFrame, value: str, reach: float) -> DataFrame:
    """``samples`` (line_id, i, d) with low and high, ``reach`` before and behind each but on its line, and before and after, the ``value`` there, linear between samples.

    A place reads from the last sample at or before it and the one after that, so a line's windows are all it takes.
    """
    w, whole = Window.partitionBy("line_id").orderBy("i"), Window.partitionBy("line_id")
    # the range frame of a double needs SQL
    last = lambda frame: F.expr(f"last(_at) over (partition by line_id order by d range between {frame})")
    s = samples.withColumn("_at", F.struct("d", F.col(value).cast("double").alias("v"), F.lead("d").over(w).alias("d2"), F.lead(F.col(value).cast("double")).over(w).alias("v2")))
    own = F.struct("d", "i", "_at")
    s = s.withColumns({"_first": F.min(own).over(whole)["_at"], "_zero": F.max(F.when(F.col("d") <= 0, own)).over(whole)["_at"], "_a": last(f"unbounded preceding and {float(reach)!r}D preceding"), "_b": last(f"current row and {float(reach)!r}D following")})
    s = s.withColumns({"low": F.greatest(F.col("d") - reach, F.lit(0.0)), "high": F.least(F.col("d") + reach, F.max("d").over(whole))})
    s = s.withColumn("_a", F.coalesce(F.when(F.col("d") - reach > 0, F.col("_a")).otherwise(F.col("_zero")), F.col("_first")))

    def read(p: Column, q: Column) -> Column:
        return F.when((p["d2"] > p["d"]) & (q > p["d"]), p["v"] + (p["v2"] - p["v"]) * (q - p["d"]) / (p["d2"] - p["d"])).otherwise(p["v"])

    return s.withColumns({"before": read(F.col("_a"), F.col("low")), "after": read(F.col("_b"), F.col("high"))}).drop("_at", "_first", "_zero", "_a", "_b")


def cut_line(vertices: DataFrame, cuts: DataFrame) -> DataFrame:
    """(line_id, d, x, y) of the part between cuts (line_id, d0, d1), its ends interpolated."""
    seg = segments(vertices, ["line_id"])
    w = Window.partitionBy("line_id")
    ends = seg.withColumn("last", F.max("seg").over(w))
    points = ends.select("line_id", F.col("c0").alias("d"), "x", "y").union(ends.filter("seg = last").select("line_id", F.col("c0") + F.col("length"), "x2", "y2"))
    inside = points.join(cuts, "line_id").filter("d > d0 and d < d1").select("line_id", "d", "x", "y")
    asked = cuts.select("line_id", F.explode(F.array("d0", "d1")).alias("q"))
    edges = interp_at(points, asked, "x").join(interp_at(points, asked, "y"), ["line_id", "q"])
    return inside.union(edges.select("line_id", F.col("q").alias("d"), "x", "y"))


def _side(ax, ay, bx, by, px, py) -> Column:
    return F.signum((bx - ax) * (py - ay) - (by - ay) * (px - ax))


def self_crossings(vertices: DataFrame, size: float = 50.0) -> DataFrame:
    """(line_id, a, b): segments of a line, not neighbours, that properly cross. They meet in the cells that both touch and each pair is told once."""
    seg = segments(vertices, ["line_id"]).select("line_id", "seg", "x", "y", "x2", "y2").withColumn("cell", F.explode(_segment_cells(size)))
    p, q = seg.alias("p"), seg.alias("q")
    c = lambda side, n: F.col(f"{side}.{n}")
    met = p.join(q, (c("p", "line_id") == c("q", "line_id")) & (c("p", "cell") == c("q", "cell")) & (c("q", "seg") - c("p", "seg") >= 2))
    s1, s2 = (_side(c("p", "x"), c("p", "y"), c("p", "x2"), c("p", "y2"), c("q", k), c("q", m)) for k, m in (("x", "y"), ("x2", "y2")))
    s3, s4 = (_side(c("q", "x"), c("q", "y"), c("q", "x2"), c("q", "y2"), c("p", k), c("p", m)) for k, m in (("x", "y"), ("x2", "y2")))
    return met.filter((s1 * s2 < 0) & (s3 * s4 < 0)).select(c("p", "line_id").alias("line_id"), c("p", "seg").alias("a"), c("q", "seg").alias("b")).distinct()


# --- terrain ----------------------------------------------------------------------


def sample_grid(points: DataFrame, cells: DataFrame, x0: float = 0.0, y0: float = 0.0, res: float = 1.0) -> DataFrame:
    """(point_id, z): bilinear between cell centres at (x0 + c res, y0 + r res); null unless all four have a value."""
    p = points.select("point_id", ((F.col("x") - x0) / res).alias("u"), ((F.col("y") - y0) / res).alias("v")).withColumns(packed.probes([(0, 0)]))
    return packed.read_tiles(p, packed.pack_tiles(cells.select("r", "c", "z"))).select("point_id", F.get("z", F.lit(0)).alias("z"))


def side_grids(cells: DataFrame, offset: int, res: float) -> DataFrame:
    """(r, c, zx, zy): slopes by the cells ``offset`` away on either side; null where one is missing."""
    z = cells.select("r", "c", "z")
    near = lambda dr, dc, n: z.select((F.col("r") - dr).alias("r"), (F.col("c") - dc).alias("c"), F.col("z").alias(n))
    out = z
    for dr, dc, n in ((0, offset, "e"), (0, -offset, "w"), (offset, 0, "n"), (-offset, 0, "s")):
        out = out.join(near(dr, dc, n), ["r", "c"], "left")
    return out.select("r", "c", ((F.col("e") - F.col("w")) / (2 * offset * res)).alias("zx"), ((F.col("n") - F.col("s")) / (2 * offset * res)).alias("zy"))


def box_mean(cells: DataFrame, half: int) -> DataFrame:
    """Mean over a square of cells, only where it is full: each cell is sent to its neighbours and summed."""
    span = F.sequence(F.lit(-half), F.lit(half))
    sent = cells.filter("z is not null").withColumn("dr", F.explode(span)).withColumn("dc", F.explode(span)).groupBy((F.col("r") + F.col("dr")).alias("r"), (F.col("c") + F.col("dc")).alias("c")).agg(F.count("z").alias("n"), F.avg("z").alias("mean"))
    return cells.select("r", "c").join(sent, ["r", "c"], "left").select("r", "c", F.when(F.col("n") == (2 * half + 1) ** 2, F.col("mean")).alias("mean"))


def plus_mean(cells: DataFrame, offset: int = 1) -> DataFrame:
    """(r, c, mean): a cell's mean with the four cells ``offset`` away; beyond the grid's box the cell at its edge counts again, and a missing value makes the mean null."""
    box = cells.agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    ways = F.array(*[F.struct(F.lit(i * offset).alias("dr"), F.lit(j * offset).alias("dc")) for i, j in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))])
    asked = cells.select("r", "c").crossJoin(F.broadcast(box)).withColumn("w", F.explode(ways))  # one row of aggregates
    held = lambda v, low, high: F.least(F.greatest(v, F.col(low)), F.col(high))
    asked = asked.select("r", "c", held(F.col("r") + F.col("w.dr"), "r0", "r1").alias("nr"), held(F.col("c") + F.col("w.dc"), "c0", "c1").alias("nc"))
    met = asked.join(cells.select(F.col("r").alias("nr"), F.col("c").alias("nc"), "z"), ["nr", "nc"], "left")
    return met.groupBy("r", "c").agg(F.when(F.count("z") == 5, F.avg("z")).alias("mean"))


def flow_weights(cells: DataFrame, res: float, power: float = 1.1) -> DataFrame:
    """(r, c, dr, dc, weight): shares of a cell's water to its lower neighbours, by slope to a power."""
    steps = F.array(*[F.struct(F.lit(i).alias("dr"), F.lit(j).alias("dc"), F.lit(math.hypot(i, j) * res).alias("run")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])
    z = cells.filter("z is not null")
    wide = z.select("r", "c", "z", F.explode(steps).alias("s")).select("r", "c", "z", "s.dr", "s.dc", "s.run")
    other = z.select(F.col("r").alias("nr"), F.col("c").alias("nc"), F.col("z").alias("nz"))
    down = wide.join(other, (F.col("r") + F.col("dr") == F.col("nr")) & (F.col("c") + F.col("dc") == F.col("nc"))).withColumn("s", (F.col("z") - F.col("nz")) / F.col("run")).filter("s > 0")
    p = F.pow("s", F.lit(power))
    return down.withColumn("p", p).select("r", "c", "dr", "dc", "s", (F.col("p") / F.sum("p").over(Window.partitionBy("r", "c"))).alias("weight"))


def decode_rgb(r: Column, g: Column, b: Column, a: Column, encoding: str) -> Column:
    """Metres of an elevation pixel; null for transparent pixels and the no-data height."""
    if encoding == "terrarium":
        return r * 256.0 + g + b / 256.0 - 32768
    h = -10000 + (r * 65536 + g * 256 + b) * 0.1
    return F.when((a != 0) & (h > -9999), h)


# --- scored lines -----------------------------------------------------------------


def hold_side(value: str, threshold: float) -> Column:
    """+1 or -1 where the cross slope is decided, held through flats; a leading flat takes the first side; 0 if there is none."""
    side = F.when(F.col(value) > threshold, 1).when(F.col(value) < -threshold, -1)
    w = Window.partitionBy("line_id").orderBy("i")
    last = F.last(side, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = F.last(side, True).over(Window.partitionBy("line_id").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0))
    return F.coalesce(last, first, F.lit(0)).cast("int")


def run_since(site: Column) -> Column:
    """Metres since the last site, or since the start."""
    w = Window.partitionBy("line_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return F.col("d") - F.coalesce(F.last(F.when(site, F.col("d")), True).over(w), F.first("d").over(w))


def switch_point(costs: DataFrame) -> DataFrame:
    """(edge_id, k): where to change from the low to the high tracing at least cost; ties go to the middle; a missing cost is infinite."""
    w = Window.partitionBy("edge_id").orderBy("k")
    inf = F.lit(float("inf"))
    low, high = F.coalesce("low", inf), F.coalesce("high", inf)
    before = F.coalesce(F.sum(low).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum(high).over(Window.partitionBy("edge_id").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0))
    n = F.count("*").over(Window.partitionBy("edge_id"))
    priced = costs.withColumns({"cost": before + after, "off": F.abs(F.col("k") - n / 2)})
    return priced.groupBy("edge_id").agg(F.min_by("k", F.struct("cost", "off", "k")).alias("k"))


def factor_histograms(samples: DataFrame, value: str, low: float, high: float, bins: int = 30) -> DataFrame:
    """(line_id, bin, weight): values clipped into the range, weighted by w."""
    at = F.least(F.greatest(F.floor((F.col(value) - low) / (high - low) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    return samples.filter(F.col(value).isNotNull()).groupBy("line_id", at.alias("bin")).agg(F.sum("w").alias("weight"))


def cost_space(samples: DataFrame, x: tuple, y: tuple, cells: tuple[int, int] = (48, 32)) -> DataFrame:
    """(cx, cy, metres) over two values (name, low, high), clamped."""
    at = [F.least(F.greatest(F.floor((F.col(n) - a) / (b - a) * k), F.lit(0)), F.lit(k - 1)).cast("int") for (n, a, b), k in zip((x, y), cells, strict=True)]
    return samples.filter(F.col(x[0]).isNotNull() & F.col(y[0]).isNotNull()).groupBy(at[0].alias("cx"), at[1].alias("cy")).agg(F.sum("w").alias("metres"))


def weight_sweep(costs: DataFrame, settings: DataFrame, margin: float = 0.05) -> DataFrame:
    """(setting, line, total, replaces): the cheapest line of each setting; it replaces the setting's input line only if cheaper by more than the margin. Settings are a small table of (setting, factor, k)."""
    priced = costs.join(settings, "factor").groupBy("setting", "line").agg(F.sum(F.col("k") * F.col("cost")).alias("total"))
    return priced.groupBy("setting").agg(F.min(F.struct("total", "line")).alias("b"), F.min_by("total", "line").alias("first")).select("setting", "b.line", "b.total", (F.col("first") - F.col("b.total") > margin).alias("replaces"))
