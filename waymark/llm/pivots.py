"""Operator 11: near-duplicate vectors by a pivot-permutation index.

1. Equal vectors are one class, named by a digest and counted; only classes go on.
2. Reference points (pivots) are chosen from a bounded sample of the classes, drawn by
   hash, no two of them closer than ``APART``. A class is described by its ``NEAREST``
   pivots in the order of their closeness.
3. The inverted list of a pivot holds the classes that name it. Two classes are
   candidates if they share at least ``SHARED`` pivots; the pair belongs to the list of
   the first pivot (by number) that they share, so it is met once. A list of more than
   ``LIST`` classes is parted by the second pivot shared, which changes no candidate; a
   list that is still longer (near copies, which share all) is dealt to blocks, and each
   pair of blocks is a group of its own, of at most about twice ``BLOCK`` classes.
4. In a group shared pivots are counted list by list, and the candidates are verified by
   their cosine in double precision. A group gives, for each class, the number of linked
   vectors and one link to the local component, never its pairs.
5. Components are found over these links and handed to every vector of a class.

Pairs that share fewer pivots are missed; the tests measure the recall against brute
force. The number of pivots follows the square root of the number of classes, up to
``MOST_PIVOTS``.

Defined results: vectors that are null, empty, zero or hold null or non-finite components
link with nothing, have no links and are their own component. Only vectors of the same
length can link; each length has pivots of its own. Rows that repeat an id are vectors of
their own. A null id's component is the least id that is not null, or null. An empty
table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import bounded_batches, materialise

NEAREST, SHARED = 10, 2
#: Sampled pivots have a smaller cosine than this with one another.
APART = 0.8
#: The most pivots, and the sampled classes looked at for each.
MOST_PIVOTS, TRIES = 8192, 4
#: Classes of a list that is not parted, and of a block of one that stays longer.
LIST, BLOCK = 4096, 2048


def _rows(column: pa.Array) -> np.ndarray:
    """Vectors of one length, written as doubles, as a matrix."""
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), "<f8").reshape(len(data), -1)


def classes_of(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, class, size, vector): a digest and the components as doubles, both null for vectors that take no part."""

    def name(batches):
        for batch in batches:
            digests, sizes, data = [], [], []
            for one in batch.column(1).to_pylist():
                x = np.array(one if one and None not in one else [], np.float64) + 0.0
                if x.size and np.isfinite(x).all() and x.any():
                    data.append(x.astype("<f8").tobytes())
                    digests.append(hashlib.blake2b(data[-1], digest_size=16).digest())
                    sizes.append(len(x))
                else:
                    data.append(None)
                    digests.append(None)
                    sizes.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(data, pa.binary())], ["id", "class", "size", "vector"])

    kind = vectors.schema[id_col].dataType.simpleString()
    return bounded_batches(vectors.select(id_col, vector_col), 4000).mapInArrow(name, f"id {kind}, class binary, size int, vector binary")


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def choose_pivots(classes: DataFrame, n: int) -> np.ndarray:
    """At most ``MOST_PIVOTS`` unit vectors of the sample, apart from one another."""
    wanted = min(MOST_PIVOTS, max(64, 1 << math.ceil(math.log2(4 * math.sqrt(n)))))
    sample = classes.select("vector").orderBy(F.xxhash64("class"), "class").limit(TRIES * wanted)
    points = _unit(np.array([np.frombuffer(r.vector, "<f8") for r in sample.collect()]))
    kept = np.empty((wanted, points.shape[1]))
    count = 0
    for x in points:
        if count == wanted:
            break
        if not count or (kept[:count] @ x).max() < APART:
            kept[count] = x
            count += 1
    return kept[:count]


def describe(classes: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``classes`` with ``near``: the numbers of the nearest pivots, closest first (of equally close ones the smaller number)."""
    nearest = min(NEAREST, len(pivots))

    def each(batches):
        for batch in batches:
            if batch.num_rows:
                close = _unit(_rows(batch.column("vector"))) @ pivots.T
                near = np.argsort(-close, axis=1, kind="stable")[:, :nearest].astype(np.int32)
                yield batch.append_column("near", pa.array(near.tolist(), pa.list_(pa.int32())))

    return bounded_batches(classes, 4000).mapInArrow(each, classes.schema.simpleString()[7:-1].replace(":", " ") + ", near array<int>")


def _linked(vectors: np.ndarray, near: np.ndarray, sides: np.ndarray, first: int, second: int, least: float, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """The linked pairs (positions a < b) of a group: shared pivots are counted list by list, then candidates verified."""
    n = len(vectors)
    counts, taken = np.zeros((n, n), np.uint8), np.zeros((n, n), bool)
    order = np.argsort(near, axis=None, kind="stable")
    own = order // near.shape[1]
    pivots, starts, sizes = np.unique(near.ravel()[order], return_index=True, return_counts=True)
    other = (pivots < first) | ((first < pivots) & (pivots < second))  # a pair that shares such a pivot belongs to another list
    short = sizes <= 64
    for at, size, elsewhere in zip(starts[~short].tolist(), sizes[~short].tolist(), other[~short].tolist(), strict=True):
        both = own[at : at + size, None], own[None, at : at + size]
        counts[both] += 1
        if elsewhere:
            taken[both] = True
    member = np.repeat(np.arange(len(pivots)), sizes)  # of the short lists all pairs at once
    member, left = member[short[member]], own[short[member]]
    width = sizes[member]
    right = own[np.repeat(starts[member] - np.cumsum(width) + width, width) + np.arange(int(width.sum()))]
    pairs = np.repeat(left, width) * n + right
    np.add.at(counts.ravel(), pairs, np.uint8(1))
    taken.ravel()[pairs[np.repeat(other[member], width)]] = True
    allowed = (counts >= shared) & ~taken
    unit = _unit(vectors)
    found = []
    for k in range(0, n, 512):
        cut = slice(k, k + 512)
        later = np.arange(n)[None, :] > np.arange(n)[cut, None] if sides.min() == sides.max() else sides[cut, None] < sides[None, :]
        a, b = np.nonzero(allowed[cut] & later & (unit[cut] @ unit.T >= least))
        found.append((a + k, b))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least position that each position reaches by the pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def candidate_groups(described: DataFrame) -> DataFrame:
    """A row per class and group: pivots ``first`` and ``second`` (-1: not parted), blocks ``x`` <= ``y`` and the class's own block."""
    numbers = F.array_sort("near")
    posted = described.select("class", F.explode(F.slice(numbers, 1, F.greatest(F.size("near") - (SHARED - 1), F.lit(1)))).alias("first"))
    lists = posted.groupBy("first").count()
    long_lists = {r.first: True for r in lists.filter(F.col("count") > LIST).select("first").collect()}
    own = F.when(F.col("first").isin(list(long_lists)), F.filter("numbers", lambda p: p > F.col("first"))).otherwise(F.array(F.lit(-1))) if long_lists else F.array(F.lit(-1))
    rows = described.withColumn("numbers", numbers)
    rows = rows.select("class", "n", "vector", "near", "numbers", F.explode(F.slice("numbers", 1, F.greatest(F.size("near") - (SHARED - 1), F.lit(1)))).alias("first"))
    rows = rows.withColumn("second", F.explode(own)).drop("numbers")
    held = rows.groupBy("first", "second").count().filter(F.col("count") > LIST).select("first", "second", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(held, ["first", "second"], "left").na.fill(1, ["blocks"])
    rows = rows.withColumn("block", F.pmod(F.xxhash64("class"), "blocks").cast("int"))
    return rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("class", "n", "vector", "near", "first", "second", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))


def near_duplicates(vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per row of ``vectors``: id, n_links (other vectors linked directly), component_id and kept."""
    named = materialise(classes_of(vectors, id_col, vector_col), "vectors")
    valid = named.filter("class is not null")
    classes = materialise(valid.groupBy("class", "size").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.first("vector").alias("vector")), "classes")
    sizes = classes.groupBy("size").count().filter(F.col("count") > 1).collect()

    def verify(table: pa.Table) -> pa.Table:
        first, second = table.column("first")[0].as_py(), table.column("second")[0].as_py()
        near = np.array(table.column("near").to_pylist())
        sides = (table.column("block").to_numpy() != table.column("x")[0].as_py()).astype(np.int8)
        if sides.min() == sides.max() and table.column("x")[0].as_py() != table.column("y")[0].as_py():
            a = b = np.empty(0, np.int64)  # only one of the two blocks has classes
        else:
            a, b = _linked(_rows(table.column("vector").combine_chunks()), near, sides, first, second, least, min(SHARED, near.shape[1]))
        n = table.column("n").to_numpy()
        links = np.zeros(len(n), np.int64)
        np.add.at(links, a, n[b])
        np.add.at(links, b, n[a])
        root = _local_roots(len(n), a, b)
        at = np.flatnonzero(links)
        names = table.column("class").combine_chunks()
        return pa.table({"class": names.take(pa.array(at)), "root": names.take(pa.array(root[at])), "links": links[at]}, pa.schema([("class", pa.binary()), ("root", pa.binary()), ("links", pa.int64())]))

    found = None
    for size, n in sizes:
        own = classes.filter(F.col("size") == size)
        described = materialise(describe(own, choose_pivots(own, n)), "described")
        part = candidate_groups(described).groupBy("first", "second", "x", "y").applyInArrow(verify, "class binary, root binary, links long")
        found = part if found is None else found.unionByName(part)
    if found is None:
        result = classes.select("class", (F.col("n") - 1).alias("n_links"), F.col("least").alias("component_id"))
    else:
        found = materialise(found, "links")
        roots = connected_components(found.select(F.col("class").alias("u"), F.col("root").alias("v")), "components")
        links = found.groupBy("class").agg(F.sum("links").alias("links"))
        joined = classes.select("class", "n", "least").join(links, "class", "left").join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
        smallest = joined.groupBy("root").agg(F.min("least").alias("component_id"))
        result = joined.join(smallest, "root").select("class", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = named.select("id", "class").join(result, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
