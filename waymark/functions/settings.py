"""Factor settings as columns: checks, repairs and older layers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Nodes of a curve, its least and greatest value, what a value of 0 is read as, the greatest weight.
NODES, LEAST, GREATEST, ZERO_AS, MOST = (2, 9), 1e-4, 1e4, 0.01, 10_000.0
#: An older layer's own length weight, and the metres its weights were per.
OLD_LENGTH, OLD_METRES = 8.1, 100.0
#: Factors that are no longer read.
RETIRED = ["offset", "length"]


def clean_curve(nodes: Column) -> Column:
    """An array of (x, y) with values of 0 repaired."""
    return F.transform(nodes, lambda p: F.struct(p["x"].alias("x"), F.when(p["y"] == 0, ZERO_AS).otherwise(p["y"]).alias("y")))


def curve_error(nodes: Column) -> Column:
    """What is wrong with a curve of (x, y) nodes; null if nothing."""
    number = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    y_ok = lambda p: (p["y"] == 0) | p["y"].between(LEAST, GREATEST)
    down = F.exists(F.sequence(F.lit(1), F.size(nodes) - 1), lambda k: F.get(nodes, k)["x"] < F.get(nodes, k - 1)["x"])
    return (
        F.when(nodes.isNull() | ~F.size(nodes).between(*NODES), "nodes")
        .when(F.exists(nodes, lambda p: p.isNull() | ~number(p["x"]) | ~number(p["y"])), "number")
        .when(F.exists(nodes, lambda p: ~y_ok(p)), "value")
        .when(down, "order")
    )


def weight_error(k: Column) -> Column:
    """What is wrong with a weight; null if nothing."""
    return F.when(k.isNull() | F.isnan(k), "number").when(~k.between(0.0, MOST), "weight")


def clean_parameter(value: Column, low: float, high: float, whole: bool = False) -> Column:
    """A parameter in its range, rounded half to even if ``whole``; null if it is none or out of range."""
    return F.when(value.between(low, high) & ~F.isnan(value), F.bround(value) if whole else value)


def factor_error(name: Column, k: Column, nodes: Column, known: list[str]) -> Column:
    """The first fault of a factor's settings: "unknown", or what its weight or curve has; a retired one has none. Nulls of k and nodes are not given."""
    return F.when(name.isin(RETIRED), F.lit(None).cast("string")).when(~name.isin(known) | name.isNull(), "unknown").otherwise(F.coalesce(F.when(k.isNotNull(), weight_error(k)), F.when(nodes.isNotNull(), curve_error(nodes))))


def upgraded_weight(k: Column, length_k: Column, per_metre: Column) -> Column:
    """An older layer's weight in metres: as a multiple of its length weight, per turn or corner times 100."""
    lk = F.coalesce(length_k, F.lit(OLD_LENGTH))
    return F.when(k.isNotNull(), F.when(lk <= 0, 0.0).otherwise(F.round(k / lk * F.when(per_metre, 1.0).otherwise(OLD_METRES), 4)))


def mirrored_curve(nodes: Column) -> Column:
    """An older cut-and-fill curve over depth, mirrored to both signs; null if that has too many or too few nodes."""
    fill = F.filter(nodes, lambda p: p["x"] >= 0)
    cut = F.transform(F.reverse(F.filter(fill, lambda p: p["x"] > 0)), lambda p: F.struct((-p["x"]).alias("x"), p["y"].alias("y")))
    both = F.concat(cut, fill)
    return F.when(F.size(both).between(*NODES), both)
