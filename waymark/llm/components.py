"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialise, release


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on directed pairs (u, v) with u > v; the result is again such pairs.

    Large: each node's larger neighbours go to its smallest neighbour or itself.
    Small: each node and its smaller neighbours go to the smallest of them.
    """
    near = edges.union(edges.select(F.col("v"), F.col("u"))).toDF("u", "v") if large else edges
    least = near.groupBy("u").agg(F.min("v").alias("m"))
    if large:
        least = least.select("u", F.least("u", "m").alias("m"))
        joined = near.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        joined = near.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
    return joined.filter("a > b").toDF("u", "v").distinct()


#: Edges of which a task keeps a spanning forest.
FOREST_EDGES = 1 << 18


def _forest(batches):
    """The edges of a task without those whose ends its earlier edges join already."""
    root: dict = {}

    def find(x):
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for batch in batches:
        keep = []
        for u, v in zip(*(map(_hashable, batch.column(c).to_pylist()) for c in ("u", "v")), strict=True):
            a, b = find(u), find(v)
            root[a] = b
            keep.append(a != b)
        yield batch.filter(pa.array(keep, pa.bool_()))


def _hashable(x):
    return tuple(x.items()) if isinstance(x, dict) else x


def connected_components(edges: DataFrame, label: str, most_rounds: int = 50) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns u, v of any one ordered type); root is the least node of its component.

    First a task drops the edges that join nothing anew among its ``FOREST_EDGES``, so many
    links within a group don't travel. Each round's pairs are written to the shared folder,
    so lineage stays short. A null end takes no part; loops and repeated edges change nothing.
    """
    pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u is not null and v is not null and u > v").distinct()
    whole = materialise(pairs, label)
    tasks = max(1, math.ceil(whole.count() / FOREST_EDGES))
    pairs = materialise(whole.coalesce(tasks).mapInArrow(_forest, whole.schema), label)
    release(whole)
    for _ in range(most_rounds):
        if _only_stars(pairs):
            break
        done, pairs = pairs, materialise(_star(_star(pairs, True), False), label)
        release(done)
    else:
        raise RuntimeError(f"components not settled after {most_rounds} rounds")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(pairs.select("v", "v")).distinct()


def _only_stars(pairs: DataFrame) -> bool:
    """Every node has one smaller neighbour, which has none itself: each component is a star about its least node."""
    sides = pairs.select(F.col("u").alias("node"), F.lit(1).alias("up")).union(pairs.select("v", F.lit(0)).distinct())
    return sides.groupBy("node").agg(F.count("*").alias("n"), F.max("up").alias("up")).filter("up = 1 and n > 1").isEmpty()
