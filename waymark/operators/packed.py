"""Elevation as packed tiles, read for points by whole groups.

A tile is one row: its key, row and column number, and the values of a square of cells as
one blob of doubles, with ``halo`` cells of the neighbours on every side, so that a point
and its probes are answered by one tile. Reading groups the points of a tile, in portions
of at most ``PORTION``; a point moves once, and tiles without points are left out before
they move.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .rounds import settled

#: Cells on a side of a tile, and points that are answered at once.
SIDE, PORTION = 64, 20_000


def _tile(at: Column, side: int) -> Column:
    return F.floor(at / F.lit(side)).cast("long")


def pack_tiles(cells: DataFrame, keys: list[str] = (), side: int = SIDE, halo: int = 1) -> DataFrame:
    """(keys, tr, tc, side, halo, blob) of cells (keys, r, c, z); cells without a value are not stored and read as missing."""
    keys, wide = list(keys), side + 2 * halo
    around = lambda c: F.sequence(_tile(F.col(c) - halo, side), _tile(F.col(c) + halo, side))
    sent = cells.filter("z is not null").select(*keys, "r", "c", F.col("z").cast("double").alias("z"), F.explode(around("r")).alias("tr")).withColumn("tc", F.explode(around("c")))

    kinds = dict(sent.dtypes)
    ddl = "".join(f"`{k}` {kinds[k]}, " for k in keys) + "tr long, tc long, blob binary"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def pack(table: pa.Table) -> pa.Table:
        tr, tc = table.column("tr")[0].as_py(), table.column("tc")[0].as_py()
        values = np.full(wide * wide, np.nan)
        r, c = table.column("r").to_numpy() - tr * side + halo, table.column("c").to_numpy() - tc * side + halo
        values[r * wide + c] = table.column("z").to_numpy()
        own = table.slice(0, 1).select([*keys, "tr", "tc"])
        return own.append_column("blob", pa.array([values.tobytes()], pa.binary())).cast(schema)

    packed = sent.groupBy(*keys, "tr", "tc").applyInArrow(pack, ddl)
    return packed.select(*keys, "tr", "tc", F.lit(side).alias("side"), F.lit(halo).alias("halo"), "blob")


def bilinear(values: np.ndarray, u: np.ndarray, v: np.ndarray, c0: int = 0, r0: int = 0) -> np.ndarray:
    """Between the four cells around (column u, row v) of a square of values that begins at column c0 and row r0; not a number unless all four have one."""
    c, r = np.floor(u).astype(np.int64), np.floor(v).astype(np.int64)
    fu, fv = u - c, v - r
    c, r = c - c0, r - r0
    return (1 - fv) * ((1 - fu) * values[r, c] + fu * values[r, c + 1]) + fv * ((1 - fu) * values[r + 1, c] + fu * values[r + 1, c + 1])


def read_tiles(points: DataFrame, tiles: DataFrame, keys: list[str] = (), side: int = SIDE, halo: int = 1) -> DataFrame:
    """``points`` with ``z``: the value at each of their probes, null where one of the four cells is missing.

    ``points`` has the keys, u and v (column and row) and arrays du and dv, the probes'
    steps from there in cells, none longer than ``halo`` - 1. Points that are null or not
    finite, and points without a tile, have null at every probe. ``side`` and ``halo`` are
    those that the tiles were packed with; a tile of another shape fails the job.
    """
    keys, wide = list(keys), side + 2 * halo
    at = [*keys, "tr", "tc"]
    finite = F.abs(F.col("u")) < float("inf"), F.abs(F.col("v")) < float("inf")
    placed = points.withColumns({"tr": F.when(finite[1], _tile(F.col("v"), side)), "tc": F.when(finite[0], _tile(F.col("u"), side))})
    portions = placed.groupBy(at).agg(F.ceil(F.count("*") / PORTION).cast("long").alias("portions"))
    asked = placed.join(portions.filter("portions > 1"), at, "left").withColumn("portion", F.pmod(F.xxhash64("u", "v", F.monotonically_increasing_id()), F.coalesce("portions", F.lit(1)))).drop("portions")
    shape = F.when((F.col("side") == side) & (F.col("halo") == halo), F.col("blob")).otherwise(F.raise_error(F.lit("tiles of another shape")).cast("binary"))
    held = tiles.select(*at, shape.alias("blob")).join(portions, at).withColumn("portion", F.explode(F.sequence(F.lit(0).cast("long"), F.col("portions") - 1))).drop("portions")
    names = points.columns
    ddl = ", ".join(f"`{n}` {kind}" for n, kind in points.dtypes) + ", z array<double>"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def read(mine: pa.Table, tile: pa.Table) -> pa.Table:
        rows = mine.num_rows
        counts = pc.fill_null(pc.list_value_length(mine.column("du")), 0).to_numpy()
        if rows and tile.num_rows:
            c0, r0 = (tile.column(n)[0].as_py() * side - halo for n in ("tc", "tr"))
            values = np.frombuffer(tile.column("blob")[0].as_py(), "<f8").reshape(wide, wide)
            u, v = (np.repeat(mine.column(n).to_numpy(), counts) + _flat(mine.column(f"d{n}")) for n in "uv")
            z = bilinear(values, u, v, c0, r0)
        else:
            z = np.full(int(counts.sum()), np.nan)
        edges = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        found = pa.ListArray.from_arrays(edges, pa.array(z, mask=np.isnan(z)))
        return mine.select(names).append_column("z", found).cast(schema)

    return asked.groupBy(*at, "portion").cogroup(held.groupBy(*at, "portion")).applyInArrow(read, ddl)


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    parts = [np.asarray(x.flatten()) for x in column.chunks]
    return np.concatenate([np.empty(0), *parts])


def probes(steps: list[tuple[float, float]]) -> dict[str, Column]:
    """The columns du and dv of probes that are alike for all points."""
    return {n: F.array(*[F.lit(float(s[k])) for s in steps]) for k, n in enumerate(("du", "dv"))}


def read_ranked(points: DataFrame, tiles: DataFrame, steps: list[tuple[float, float]], side: int = SIDE, halo: int = 2) -> DataFrame:
    """``points`` (point_id, x, y, sources) as (point_id, z, source) from the first source with a value at every probe.

    Each round asks the next source of the points that have none yet and writes the
    answers; rounds go up to the longest list. Without any source z and source are null.
    """
    rest, done = points.select("point_id", F.col("x").cast("double").alias("u"), F.col("y").cast("double").alias("v"), "sources"), []
    nothing = lambda f: f.select("point_id", F.lit(None).cast("array<double>").alias("z"), F.lit(None).cast("string").alias("source"))
    rounds = points.agg(F.max(F.size("sources"))).first()[0] or 0
    for k in range(rounds):
        has = F.coalesce(F.size("sources"), F.lit(0)) > k
        done.append(nothing(rest.filter(~has)))
        asked = rest.filter(has).withColumn("source", F.get("sources", F.lit(k))).withColumns(probes(steps))
        got = settled(read_tiles(asked, tiles, ["source"], side, halo))
        whole = F.forall("z", lambda z: z.isNotNull())
        done.append(got.filter(whole).select("point_id", "z", "source"))
        rest = got.filter(~whole).select("point_id", "u", "v", "sources")
    out = nothing(rest)
    for part in done:
        out = part.unionByName(out)
    return out
