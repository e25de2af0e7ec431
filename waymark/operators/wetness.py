"""Pits filled over any number of tiles, and the wetness index of a terrain grid, tile by tile with a halo."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import packed
from .rounds import settled

# Exponent of the flow shares, least slope, metres that a filled flat rises by each cell.
POWER, LEAST_SLOPE, RISE = 1.1, 0.01, 1e-4
_WAYS = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]


def _moved(a: np.ndarray, i: int, j: int, outside: float) -> np.ndarray:
    """What each cell's neighbour at (i, j) holds."""
    out = np.full_like(a, outside)
    h, w = a.shape
    out[max(0, -i) : h - max(0, i), max(0, -j) : w - max(0, j)] = a[max(0, i) : h - max(0, -i), max(0, j) : w - max(0, -j)]
    return out


def _flooded(ground: np.ndarray, level: np.ndarray) -> np.ndarray:
    """``level`` lowered to what the ground and the levels already known allow; both flat, nan in the ground where there is none, and a rim of one cell.

    A cell stands at its ground or, where that isn't over its lowest neighbour's level, a
    small rise above that. Cells are met from the lowest level up.
    """
    side = math.isqrt(len(ground))
    steps = [i * side + j for i, j in _WAYS]
    low, floor = level.tolist(), ground.tolist()
    known = np.isfinite(ground).reshape(side, side)
    known[[0, -1]] = False
    known[:, [0, -1]] = False
    open_ = known.ravel().tolist()
    queue = [(x, k) for k, x in enumerate(low) if x != math.inf]
    heapq.heapify(queue)
    while queue:
        x, k = heapq.heappop(queue)
        if x > low[k]:
            continue
        for step in steps:
            q = k + step
            if 0 <= q < len(low) and open_[q]:
                y = floor[q] if floor[q] > x else x + RISE
                if y < low[q]:
                    low[q] = y
                    heapq.heappush(queue, (y, q))
    return np.array(low)


def _shore(ground: np.ndarray) -> np.ndarray:
    """Starting levels of a square with its rim: the ground itself at the edge of the data, which has a neighbour without data, else none."""
    known = np.isfinite(ground)
    inner = np.logical_and.reduce([_moved(known, i, j, True) for i, j in _WAYS])
    level = np.where(known & ~inner, ground, np.inf)
    level[[0, -1]] = np.inf
    level[:, [0, -1]] = np.inf
    return level


def _cut(i: int, last: int) -> slice:
    """Of rows 0..last with a rim: the own rows next to the neighbour on side i, all own rows for 0."""
    return {-1: slice(1, 2), 0: slice(1, last), 1: slice(last - 1, last)}[i]


def fill_pits(cells: DataFrame, side: int = packed.SIDE) -> DataFrame:
    """(r, c, z, filled): every pit raised so that all cells drain to the edge of the data, over any number of tiles.

    Each tile floods itself from the edge of the data and from what its neighbours say of
    the cells along its border. A tile whose border cells sank tells its neighbours, and
    those flood again; rounds end when no border sinks, so a lake that spans tiles stands
    at one level. A round is a written table and sends border cells only. Cells that
    nothing drains, which only data without an edge has, stay at no level (null).
    """
    wide = side + 2
    tiles = packed.pack_tiles(cells, [], side, 1).select("tr", "tc", F.col("blob").alias("ground"))
    ddl = "tr long, tc long, ground binary, level binary, told boolean"
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    empty = {n: F.lit(None).cast(k) for n, k in (("ground", "binary"), ("level", "binary"), ("i", "int"), ("j", "int"), ("strip", "binary"))}
    rows = tiles.withColumns({n: empty[n] for n in ("level", "i", "j", "strip")})

    def flood(table: pa.Table) -> pa.Table:
        got = table.to_pylist()
        own = next((r for r in got if r["ground"] is not None), None)
        if own is None:
            return schema.empty_table()  # a neighbour without data
        ground = np.frombuffer(own["ground"], "<f8")
        square = ground.reshape(wide, wide)
        first = own["level"] is None
        level = _shore(square) if first else np.frombuffer(own["level"], "<f8").reshape(wide, wide).copy()
        before = level.copy()
        for r in got:
            if r["strip"] is not None:  # from the neighbour on side (i, j) to the rim there
                at = tuple({-1: slice(0, 1), 0: slice(1, wide - 1), 1: slice(wide - 1, wide)}[x] for x in (r["i"], r["j"]))
                level[at] = np.minimum(level[at], np.frombuffer(r["strip"], "<f8").reshape(level[at].shape))
        if first or (level < before).any():
            level = _flooded(ground, level.ravel()).reshape(wide, wide)
        own_before, own_now = before[1:-1, 1:-1], level[1:-1, 1:-1]
        sank = own_now < (np.inf if first else own_before)
        told = bool(sank[[0, -1]].any() or sank[:, [0, -1]].any())
        return pa.table({"tr": [own["tr"]], "tc": [own["tc"]], "ground": [own["ground"]], "level": [level.tobytes()], "told": [told]}, schema)

    def tell(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                level = np.frombuffer(r["level"], "<f8").reshape(wide, wide)
                out += [(r["tr"] + i, r["tc"] + j, -i, -j, level[_cut(i, wide - 1), _cut(j, wide - 1)].tobytes()) for i, j in _WAYS]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["tr", "tc", "i", "j", "strip"])

    while True:
        now = settled(rows.groupBy("tr", "tc").applyInArrow(flood, ddl))
        news = now.filter("told").select("tr", "tc", "level")
        if news.isEmpty():
            break
        messages = news.mapInArrow(tell, "tr long, tc long, i int, j int, strip binary").select("tr", "tc", empty["ground"].alias("ground"), empty["level"].alias("level"), "i", "j", "strip")
        rows = now.drop("told").withColumns({n: empty[n] for n in ("i", "j", "strip")}).unionByName(messages)

    kinds = dict(cells.dtypes)

    def unpack(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ground, level = (np.frombuffer(r[n], "<f8").reshape(wide, wide)[1:-1, 1:-1] for n in ("ground", "level"))
                at = np.nonzero(np.isfinite(ground))
                yield pa.RecordBatch.from_arrays([pa.array(at[0] + r["tr"] * side), pa.array(at[1] + r["tc"] * side), pa.array(ground[at]), pa.array(level[at], mask=np.isinf(level[at]))], ["r", "c", "z", "filled"])

    return now.select("tr", "tc", "ground", "level").mapInArrow(unpack, "r long, c long, z double, filled double").select(F.col("r").cast(kinds["r"]), F.col("c").cast(kinds["c"]), "z", "filled")


def wetness(z: np.ndarray, f: np.ndarray, res: float) -> np.ndarray:
    """ln(a / tan b) of a grid ``z`` and its filled surface ``f``: a is the area that drains through a cell for each metre of its width, shared among lower neighbours by slope to a power; b the steepest descent of the unfilled ground."""
    known = np.isfinite(z)
    surface, ground = np.where(known, f, np.inf), np.where(known, z, np.inf)
    runs = [math.hypot(i, j) * res for i, j in _WAYS]
    shares = [np.maximum(np.where(known, surface, 0) - np.where(known, _moved(surface, i, j, np.inf), np.inf), 0) / run for (i, j), run in zip(_WAYS, runs, strict=True)]
    shares = [np.where(np.isfinite(s), s, 0.0) ** POWER for s in shares]
    total = sum(shares)
    shares = [np.divide(s, total, out=np.zeros_like(s), where=total > 0) for s in shares]
    area = moving = known.astype(float)
    while moving.any():  # one step of all water a round, until the last has left
        moving = sum(_moved(moving * s, -i, -j, 0.0) for (i, j), s in zip(_WAYS, shares, strict=True))
        area = area + moving
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = np.maximum.reduce([np.where(known, ground - _moved(ground, i, j, np.inf), 0.0) / run for (i, j), run in zip(_WAYS, runs, strict=True)])
        return np.where(known, np.log(area * res / np.maximum(slope, LEAST_SLOPE)), np.nan)


def twi(cells: DataFrame, res: float, core: int = 256, halo: int = 30, side: int = packed.SIDE) -> DataFrame:
    """(r, c, twi) of every cell with a height: pits are filled over all tiles first, then a tile of ``core`` cells a side is read with ``halo`` more around it, so upslope area counts that far beyond it at least."""
    near = lambda v: F.sequence(F.floor((F.col(v) - halo) / core), F.floor((F.col(v) + halo) / core))
    kinds = dict(cells.dtypes)
    surface = settled(fill_pits(cells, side))
    tiles = surface.select("r", "c", "z", "filled", F.explode(near("r")).alias("tr")).withColumn("tc", F.explode(near("c")))

    def read(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = (pdf[n].to_numpy(np.int64) for n in ("r", "c"))
        grids = np.full((2, r.max() - r.min() + 1, c.max() - c.min() + 1), np.nan)
        grids[0, r - r.min(), c - c.min()] = pdf["z"]
        grids[1, r - r.min(), c - c.min()] = pdf["filled"]
        out = pdf[["r", "c"]].assign(twi=wetness(grids[0], grids[1], res)[r - r.min(), c - c.min()])
        return out[(r // core == pdf["tr"][0]) & (c // core == pdf["tc"][0])]

    return tiles.groupBy("tr", "tc").applyInPandas(read, f"r {kinds['r']}, c {kinds['c']}, twi double")
