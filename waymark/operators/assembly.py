"""One route from pieces in order: how neighbours join, which way each runs, what is cut off, and the legs that result.

Neighbours join end to end, or the next piece leaves the middle of the one before (which
is cut there), or the one before ends on the middle of the next (whose beginning is cut).
Every pair is priced for the four ways its pieces can run; the ways are then chosen by a
fold along the route that holds the best of both for the last piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lines import segments
from .rounds import settled

#: Metres: ends this near are one place, a gap that is snapped, what a join in the middle must gain, the least length of a piece.
MEET, SNAP, PREFER, LEAST = 0.5, 3.0, 1.0, 1.0


def _piece_lines(legs: DataFrame) -> DataFrame:
    """(piece_id, seq, x, y): the legs (piece_id, leg, seq, x, y) in order; the first vertex of a later leg is the joint and not repeated."""
    place = F.row_number().over(Window.partitionBy("piece_id", "leg").orderBy("seq"))
    first = F.min("leg").over(Window.partitionBy("piece_id"))
    kept = legs.withColumns({"_p": place, "_first": first}).filter((F.col("_p") > 1) | (F.col("leg") == F.col("_first")))
    return kept.select("piece_id", (F.row_number().over(Window.partitionBy("piece_id").orderBy("leg", "seq")) - 1).alias("seq"), "x", "y")


def _nearest(points: DataFrame, seg: DataFrame) -> DataFrame:
    """(k, away, ahead, back): for points (k, piece_id, px, py) the distance from the piece, and the distance along it of the nearest place that comes first from its start, and from its end."""
    dx, dy = F.col("x2") - F.col("x"), F.col("y2") - F.col("y")
    met = points.join(seg, "piece_id")
    t = F.least(F.greatest(((F.col("px") - F.col("x")) * dx + (F.col("py") - F.col("y")) * dy) / (F.col("length") * F.col("length")), F.lit(0.0)), F.lit(1.0))
    met = met.withColumn("t", t).withColumn("away", F.hypot(F.col("x") + F.col("t") * dx - F.col("px"), F.col("y") + F.col("t") * dy - F.col("py")))
    along = F.col("c0") + F.col("t") * F.col("length")
    best = met.groupBy("k").agg(F.min(F.struct("away", "seg", along.alias("s"))).alias("a"), F.min(F.struct(F.col("away").alias("away"), (-F.col("seg")).alias("seg"), along.alias("s"))).alias("b"))
    return best.select("k", F.col("a.away").alias("away"), F.col("a.s").alias("ahead"), F.col("b.s").alias("back"))


def piece_joins(pieces: DataFrame, lines: DataFrame) -> DataFrame:
    """(route_id, place, was_turned, turned, kind, gap, cut_prev, cut_next) for each piece after the first and each way both can run.

    ``pieces``: route_id, place, piece_id; ``lines``: the pieces' vertices. Cuts are metres
    from the start of the piece as it runs.
    """
    seg = settled(segments(lines, ["piece_id"]))
    ends = seg.groupBy("piece_id").agg(F.min_by(F.struct("x", "y"), "seg").alias("a"), F.max_by(F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")), "seg").alias("b"), F.sum("length").alias("total"))
    order = Window.partitionBy("route_id").orderBy("place")
    pairs = pieces.withColumn("prev", F.lag("piece_id").over(order)).filter("prev is not null")
    side = lambda n, key: ends.select(F.col("piece_id").alias(key), *[F.col(c).alias(f"{n}_{c}") for c in ("a", "b", "total")])
    pairs = settled(pairs.select("route_id", "place", F.col("prev").alias("p"), F.col("piece_id").alias("n")).join(side("p", "p"), "p").join(side("n", "n"), "n"))
    asks = [("p", "n_a"), ("p", "n_b"), ("n", "p_a"), ("n", "p_b")]  # the line looked at, and the point that asks
    points = pairs.select(F.explode(F.array(*[F.struct(F.struct("route_id", "place", F.lit(k).alias("ask")).alias("k"), F.col(line).alias("piece_id"), F.col(f"{at}.x").alias("px"), F.col(f"{at}.y").alias("py")) for k, (line, at) in enumerate(asks)])).alias("q")).select("q.*")
    near = _nearest(points, seg).groupBy(F.col("k.route_id").alias("route_id"), F.col("k.place").alias("place")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("k.ask").alias("ask"), F.struct("away", "ahead", "back").alias("v")))).alias("near"))
    ways = F.explode(F.array(*[F.struct(F.lit(a).alias("was_turned"), F.lit(b).alias("turned")) for a in (False, True) for b in (False, True)]))
    w = pairs.join(near, ["route_id", "place"]).withColumn("w", ways).select("*", "w.*")
    end = F.when(F.col("was_turned"), F.col("p_a")).otherwise(F.col("p_b"))
    start = F.when(F.col("turned"), F.col("n_b")).otherwise(F.col("n_a"))
    on_p, on_n = F.col("near")[F.when(F.col("turned"), 1).otherwise(0)], F.col("near")[F.when(F.col("was_turned"), 2).otherwise(3)]
    s_p = F.when(F.col("was_turned"), F.col("p_total") - on_p["back"]).otherwise(on_p["ahead"])
    s_n = F.when(F.col("turned"), F.col("n_total") - on_n["back"]).otherwise(on_n["ahead"])
    w = w.withColumns({"end": end, "start": start, "s_p": s_p, "s_n": s_n, "d_p": on_p["away"], "d_n": on_n["away"]})
    w = w.withColumn("d_end", F.hypot(F.col("end.x") - F.col("start.x"), F.col("end.y") - F.col("start.y")))
    leaves = (F.col("s_p") > LEAST) & (F.col("s_p") < F.col("p_total") - MEET) & (F.col("d_p") + PREFER < F.col("d_end"))
    best = F.when(leaves, F.col("d_p")).otherwise(F.col("d_end"))
    joins = (F.col("s_n") > MEET) & (F.col("s_n") < F.col("n_total") - LEAST) & (F.col("d_n") + PREFER < best)
    kind = F.when(joins, "joins").when(leaves, "leaves").otherwise("end")
    return w.withColumn("kind", kind).select(
        "route_id",
        "place",
        "was_turned",
        "turned",
        "kind",
        F.when(F.col("kind") == "joins", F.col("d_n")).when(F.col("kind") == "leaves", F.col("d_p")).otherwise(F.col("d_end")).alias("gap"),
        F.when(F.col("kind") == "leaves", F.col("s_p")).alias("cut_prev"),
        F.when(F.col("kind") == "joins", F.col("s_n")).alias("cut_next"),
    )


def _directions(pieces: DataFrame, joins: DataFrame) -> DataFrame:
    """(route_id, place, piece_id, turned): the ways that make gaps and ``PREFER`` for each join in the middle least, then the reversals; as drawn on a tie. ``forced`` is honoured."""
    inf = float("inf")
    price = F.col("gap") + F.when(F.col("kind") != "end", PREFER).otherwise(0.0)
    priced = joins.groupBy("route_id", "place").agg(F.map_from_entries(F.collect_list(F.struct((F.when(F.col("was_turned"), 2).otherwise(0) + F.when(F.col("turned"), 1).otherwise(0)).alias("w"), price.alias("cost")))).alias("prices"))
    rows = pieces.join(priced, ["route_id", "place"], "left").groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("place", "piece_id", "forced", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.col("prices")[k]).alias("prices")))).alias("all"))
    state = lambda cost, turns, ways: F.struct(cost.cast("double").alias("cost"), turns.cast("int").alias("turns"), ways.alias("ways"))
    barred = lambda piece, turned: F.when(piece["forced"].isNotNull() & (piece["forced"] != F.lit(turned)), F.lit(inf)).otherwise(0.0)
    first, none = F.get("all", F.lit(0)), F.array().cast("array<boolean>")
    begin = F.struct(*[state(barred(first, t), F.lit(int(t)), F.concat(none, F.array(F.lit(t)))).alias(n) for t, n in ((False, "f"), (True, "r"))])
    less = lambda b, a: (b["cost"] < a["cost"]) | ((b["cost"] == a["cost"]) & (b["turns"] < a["turns"]))

    def step(acc: Column, piece: Column) -> Column:
        def reach(turned: bool) -> Column:
            a, b = (state(acc[n]["cost"] + F.get(piece["prices"], F.lit(2 * int(was) + int(turned))) + barred(piece, turned), acc[n]["turns"] + int(turned), F.concat(acc[n]["ways"], F.array(F.lit(turned)))) for was, n in ((False, "f"), (True, "r")))
            return F.when(less(b, a), b).otherwise(a)

        return F.struct(reach(False).alias("f"), reach(True).alias("r"))

    folded = rows.withColumn("d", F.aggregate(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))), begin, step))
    ways = F.when(less(F.col("d")["r"], F.col("d")["f"]), F.col("d")["r"]["ways"]).otherwise(F.col("d")["f"]["ways"])
    zipped = folded.select("route_id", F.explode(F.arrays_zip(F.col("all").alias("piece"), ways.alias("turned"))).alias("z"))
    return zipped.select("route_id", F.col("z.piece.place").alias("place"), F.col("z.piece.piece_id").alias("piece_id"), F.col("z.turned").alias("turned"))


def assemble_route(pieces: DataFrame, legs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The joins, the pieces and the vertices of routes put together from pieces.

    ``pieces``: route_id, place, piece_id, forced (null, or whether the piece is turned
    round); ``legs``: piece_id, leg, seq, x, y in metres, consecutive legs sharing their
    joint. A piece without legs makes no join and is an error of its route.

    joins: (route_id, place, kind, gap, bridge, snapped, cut_prev, cut_next), a row per
    piece after the first; a gap up to ``SNAP`` metres is closed, a longer one bridged.
    pieces: (route_id, place, piece_id, turned, length, kept0, kept1, error); a piece cut
    to under ``LEAST`` metres is "cut away", one without legs "no legs".
    vertices: (route_id, n, place, piece_id, leg, seq, x, y): n numbers the route's legs,
    each starting where the one before ends; a bridge has no piece and no leg. Routes with
    an error have none.
    """
    lines = settled(_piece_lines(legs))
    pieces = settled(pieces.select("route_id", "place", "piece_id", "forced"))
    lengths = settled(segments(lines, ["piece_id"]).groupBy("piece_id").agg(F.sum("length").alias("length")))
    options = settled(piece_joins(pieces, lines))
    ways = settled(_directions(pieces, options))
    order = Window.partitionBy("route_id").orderBy("place")
    run = ways.withColumn("was_turned", F.lag("turned").over(order))
    chosen = settled(run.filter("was_turned is not null").join(options, ["route_id", "place", "was_turned", "turned"]).select("route_id", "place", "kind", "gap", (F.col("gap") > SNAP).alias("bridge"), F.when((F.col("gap") > MEET) & (F.col("gap") <= SNAP), F.col("gap")).otherwise(0.0).alias("snapped"), "cut_prev", "cut_next"))
    report = ways.join(lengths, "piece_id", "left").join(chosen.select("route_id", "place", "cut_prev", "cut_next"), ["route_id", "place"], "left")
    report = report.withColumns({"kept0": F.coalesce("cut_next", F.lit(0.0)), "kept1": F.coalesce(F.lead("cut_prev").over(order), F.col("length"))})
    error = F.when(F.col("length").isNull(), "no legs").when(F.col("kept1") - F.col("kept0") < LEAST, "cut away")
    report = settled(report.select("route_id", "place", "piece_id", "turned", "length", "kept0", "kept1", error.alias("error")))
    return chosen, report, _route_legs(report, chosen, legs)


def _route_legs(report: DataFrame, joins: DataFrame, legs: DataFrame) -> DataFrame:
    wrong = report.filter("error is not null").select("route_id").distinct()
    good = report.join(wrong, "route_id", "left_anti")
    seg = segments(legs, ["piece_id", "leg"])
    sizes = seg.groupBy("piece_id", "leg").agg(F.sum("length").alias("size"))
    offset = F.coalesce(F.sum("size").over(Window.partitionBy("piece_id").orderBy("leg").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    seg = seg.join(sizes.withColumn("offset", offset), ["piece_id", "leg"])
    # what is kept, measured from the piece's start as drawn
    low = F.when(F.col("turned"), F.col("total") - F.col("kept1")).otherwise(F.col("kept0"))
    high = F.when(F.col("turned"), F.col("total") - F.col("kept0")).otherwise(F.col("kept1"))
    cut = good.withColumnRenamed("length", "total").join(seg, "piece_id").withColumns({"low": F.greatest(low, "offset"), "high": F.least(high, F.col("offset") + F.col("size"))}).filter("high - low > 1e-6")
    a, b = F.greatest(F.col("low") - F.col("offset"), F.col("c0")), F.least(F.col("high") - F.col("offset"), F.col("c0") + F.col("length"))
    cut = cut.withColumns({"a": a, "b": b}).filter("b >= a")
    at = lambda d: F.struct(d.alias("d"), (F.col("x") + (d - F.col("c0")) / F.col("length") * (F.col("x2") - F.col("x"))).alias("x"), (F.col("y") + (d - F.col("c0")) / F.col("length") * (F.col("y2") - F.col("y"))).alias("y"))
    points = cut.select("route_id", "place", "piece_id", "leg", "turned", F.explode(F.array(at(F.col("a")), at(F.col("b")))).alias("p"))
    points = points.select("route_id", "place", "piece_id", "leg", F.when(F.col("turned"), -F.col("leg")).otherwise(F.col("leg")).alias("run"), F.when(F.col("turned"), -F.col("p.d")).otherwise(F.col("p.d")).alias("d"), "p.x", "p.y")
    points = settled(points.groupBy("route_id", "place", "piece_id", "leg", "run").agg(F.array_sort(F.collect_list(F.struct("d", "x", "y"))).alias("line")))
    w = Window.partitionBy("route_id").orderBy("place", "run")
    bounds = points.groupBy("route_id", "place").agg(F.min_by("line", "run").alias("first"), F.max_by("line", "run").alias("last"))
    tail = F.lag(F.element_at("last", -1)).over(Window.partitionBy("route_id").orderBy("place"))
    bridges = bounds.withColumn("tail", tail).join(joins.filter("bridge").select("route_id", "place"), ["route_id", "place"])
    kind = points.schema
    bridges = bridges.select("route_id", "place", F.lit(None).cast(kind["piece_id"].dataType).alias("piece_id"), F.lit(None).cast(kind["leg"].dataType).alias("leg"), F.lit(None).cast(kind["run"].dataType).alias("run"), F.array("tail", F.element_at("first", 1)).alias("line"))
    every = points.union(bridges).withColumns({"n": F.row_number().over(w) - 1, "before": F.lag(F.element_at("line", -1)).over(w)})
    joined = F.when(F.col("before").isNotNull(), F.concat(F.array("before"), F.slice("line", 2, F.size("line") - 1))).otherwise(F.col("line"))
    rows = every.select("route_id", "n", "place", "piece_id", "leg", F.posexplode(joined).alias("k", "p")).select("route_id", "n", "place", "piece_id", "leg", "k", "p.x", "p.y")
    on = Window.partitionBy("route_id", "n").orderBy("k")
    moved = F.hypot(F.col("x") - F.lag("x").over(on), F.col("y") - F.lag("y").over(on))
    kept = rows.withColumn("moved", moved).filter("moved is null or moved > 1e-6").withColumn("size", F.count("*").over(Window.partitionBy("route_id", "n"))).filter("size > 1")
    number = F.dense_rank().over(Window.partitionBy("route_id").orderBy("n"))
    return kept.select("route_id", (number - 1).alias("n"), "place", "piece_id", "leg", (F.row_number().over(on) - 1).alias("seq"), "x", "y")
