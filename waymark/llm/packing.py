"""Operators 2 and 3: packing documents into sequences of a fixed length.

Both cut documents longer than a sequence into pieces without loss (the first
piece takes the remainder), deal the pieces to groups of a bounded size by hash,
and pack each group in one task. A group leaves about one sequence part filled,
so the loss against one global packing is about one sequence in ``GROUP_PIECES``
pieces.

* ``vector_pack``: best fit under several capacities at once (tokens, documents,
  attention cost); among the bins that can take a piece, the one with the least
  weighted residual norm, or the largest weighted dot product, gets it.
* ``pack_matrices``: best fit decreasing on tokens, the bin found by a segment tree
  over capacities; writes id matrices, cumulative lengths and position resets.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .scratch import bounded_batches
from .vocabulary import json_vocabulary

#: Pieces dealt to one packing task, a document counted as one and one more for every ``PIECE_BYTES`` of its text.
GROUP_PIECES, PIECE_BYTES = 16_384, 4096


def cut_points(length: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; the first one takes the remainder."""
    if length <= size:
        return [(0, length)]
    first = length % size
    return [(0, first)] * (first > 0) + [(a, size) for a in range(first, length, size)]


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, size: int, end_id: int, groups: int, id_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bin_group, id, piece, start, length, ids_crc32[, ids]), a row per piece; ids little-endian, two bytes each where the vocabulary allows, else four."""
    kind = dict(docs.dtypes)[id_col]
    names = ["bin_group", "id", "piece", "start", "length", "ids_crc32"] + ["ids"] * bool(id_bytes)

    def run(batches):
        vocabulary = json_vocabulary(tokenizer_path)
        again: Counter = Counter()  # rows that repeat go to groups one after the other
        for batch in batches:
            ids = batch.column("id").to_pylist()
            seeds = batch.column("seed").to_pylist()
            rows: list[tuple] = []
            for own, seed, found in zip(ids, seeds, vocabulary.encode(batch.column("text").to_pylist()), strict=True):
                data = np.append(found, end_id).astype("<u4")
                place = seed + again[seed]
                again[seed] += 1
                for k, (start, length) in enumerate(cut_points(len(data), size)):
                    part = data[start : start + length]
                    row = ((place + k * 7919) % groups, own, k, start, length, zlib.crc32(part.tobytes()))
                    rows.append((*row, (part.astype("<u2") if id_bytes == 2 else part).tobytes()) if id_bytes else row)
            yield pa.RecordBatch.from_arrays([pa.array(x) if i != 1 else pa.array(x, batch.schema.field("id").type) for i, x in enumerate(zip(*rows, strict=True))], names) if rows else pa.RecordBatch.from_pylist([], schema)

    ddl = f"bin_group long, id {kind}, piece long, start long, length long, ids_crc32 long" + ", ids binary" * bool(id_bytes)
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = bounded_batches(docs).select(F.col(id_col).alias("id"), F.pmod(F.xxhash64(id_col, text), F.lit(1 << 40)).alias("seed"), text.alias("text"))
    return rows.mapInArrow(run, ddl)


def group_count(docs: DataFrame, text_col: str = "text", group_pieces: int = GROUP_PIECES) -> int:
    """From the rows and the bytes of their texts, so that long documents make more groups and not larger ones."""
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text_col).cast("long")), F.lit(0))).first()
    return max(1, math.ceil((n + size / PIECE_BYTES) / group_pieces))


# --- vector best fit ------------------------------------------------------------


def vector_best_fit(needs: np.ndarray, capacities, weights, rule: str = "residual") -> tuple[np.ndarray, np.ndarray]:
    """(bin of each item, its position among the bin's items).

    ``needs`` has a row per item and a column per capacity. Items go largest first
    (by the first column, then by the weighted size); an item goes to the open bin
    that can hold it under every capacity and that has, with it placed, the least
    weighted residual norm ("residual"), or whose residual has the largest weighted
    dot product with the item ("dot"). If there is none it opens one. An item over a
    capacity by itself has a bin of its own.
    """
    capacities, weights = np.asarray(capacities, float), np.asarray(weights, float)
    share = needs / capacities
    order = np.lexsort((np.arange(len(needs)), -(share * weights).sum(1), -needs[:, 0]))
    least = needs.min(0) if len(needs) else capacities
    left = np.empty((len(capacities), 64))  # a row per capacity, a column per open bin
    number = np.empty(64, np.int64)
    opened = made = 0
    bins, places = np.empty(len(needs), np.int64), np.empty(len(needs), np.int64)
    held: list[int] = []
    scale = weights / capacities**2
    for i in order.tolist():
        need = needs[i]
        fit = left[0, :opened] >= need[0]
        for k in range(1, len(need)):
            fit &= left[k, :opened] >= need[k]
        fits = np.flatnonzero(fit)
        if len(fits):
            score = scale @ (left[:, fits] - need[:, None]) ** 2 if rule == "residual" else -((need * scale) @ left[:, fits])
            at = int(fits[np.argmin(score)])
        else:
            if opened == left.shape[1]:
                left = np.concatenate([left, np.empty_like(left)], axis=1)
                number = np.concatenate([number, np.empty_like(number)])
            at = opened
            left[:, at], number[at] = capacities, made
            held.append(0)
            opened, made = opened + 1, made + 1
        b = int(number[at])
        bins[i], places[i] = b, held[b]
        held[b] += 1
        left[:, at] -= need
        if (left[:, at] < least).any():  # nothing fits any more, nor beside an item over a capacity
            opened -= 1
            left[:, at], number[at] = left[:, opened], number[opened]
    return bins, places


def vector_pack(
    docs: DataFrame,
    tokenizer_path: str,
    size: int = 1024,
    end_id: int = 2,
    max_docs: int | None = None,
    max_attention: int | None = None,
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3),
    rule: str = "residual",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset), a row per piece.

    Capacities of a sequence: ``size`` tokens, ``max_docs`` pieces (default: size)
    and ``max_attention``, the sum of the squared piece lengths (default: size**2);
    the defaults of the last two never bind. A piece whose own square is over
    ``max_attention`` has a sequence to itself. ``weights`` order the bins that fit.
    A null text counts as empty and packs as the end id alone; texts of any length are
    read whole; an empty table gives no rows. Null or repeated ids are packed row by
    row; other columns are not read.
    """
    if min(x for x in (size, max_docs, max_attention) if x is not None) < 1:
        raise ValueError("every capacity must be 1 or more")
    capacities = (size, max_docs or size, max_attention or size * size)
    kind = dict(docs.dtypes)[id_col]
    ddl = f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def pack(group: pa.Table) -> pa.Table:
        length = group.column("length").to_numpy()
        row_order = np.lexsort((group.column("ids_crc32").to_numpy(), group.column("start").to_numpy(), group.column("seed").to_numpy()))
        group, length = group.take(pa.array(row_order)), length[row_order]
        bins, places = vector_best_fit(np.column_stack([length, np.ones_like(length), length**2]).astype(float), capacities, weights, rule)
        order = np.lexsort((places, bins))
        upto = np.cumsum(length[order])
        before = upto - length[order]
        first = np.searchsorted(bins[order], bins[order])
        offset = np.empty(len(length), np.int64)
        offset[order] = before - before[first]
        number = group.column("bin_group").to_numpy().astype(np.int64) * (1 << 32) + bins
        columns = [group.column("id"), group.column("piece").cast(pa.int32()), group.column("start"), group.column("length"), group.column("ids_crc32"), pa.array(number), pa.array(offset)]
        return pa.table(columns, names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    pieces = tokenised_pieces(docs, tokenizer_path, size, end_id, group_count(docs, text_col), 0, id_col, text_col)
    seeded = pieces.withColumn("seed", F.xxhash64("id"))
    return seeded.groupBy("bin_group").applyInArrow(pack, ddl).withColumnRenamed("id", id_col)


# --- best fit decreasing with a segment tree --------------------------------------


class CapacityTree:
    """A segment tree over the capacities 0..size: how many bins have each one left."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, number: int) -> None:
        self.bins[capacity].append(number)
        at = capacity + self.leaves
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (capacity, bin) of the least capacity that is at least ``need``."""
        at = need + self.leaves
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at *= 2
                at += not self.count[at]
        capacity = at - self.leaves
        while at:
            self.count[at] -= 1
            at >>= 1
        return capacity, self.bins[capacity].pop()


def best_fit_decreasing(lengths: list[int], size: int) -> list[int]:
    """The bin of each length, longest first, each into the fullest bin that has room."""
    tree, out, made = CapacityTree(size), [0] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.take(lengths[i])
        capacity, number = found if found else (size, made)
        made += found is None
        out[i] = number
        if capacity > lengths[i]:
            tree.add(capacity - lengths[i], number)
    return out


def pack_matrices(docs: DataFrame, tokenizer_path: str, size: int = 1024, end_id: int = 2, pad_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per sequence: (sequence_id, n_tokens, id_bytes, input_ids binary, cu_seqlens array<int>,
    position_resets array<int>, segments array<struct<id, piece, start>>).

    ``input_ids`` is the sequence's row of the id matrix: ``size`` little-endian
    unsigned numbers of ``id_bytes`` bytes (2 for vocabularies under 65,536 ids, else
    4), padded by ``pad_id``. ``cu_seqlens`` runs from 0 to n_tokens, for kernels of
    variable length; positions count from 0 again at each of ``position_resets``. A
    null text counts as empty and packs as the end id alone; texts of any length are
    read whole; null or repeated ids are packed row by row; an empty table gives no rows;
    other columns are not read.
    """
    vocabulary = json_vocabulary(tokenizer_path)
    width = 2 if vocabulary.plain and max([*vocabulary.ranks.values(), *vocabulary.special.values(), end_id, pad_id]) < 65536 else 4
    kind = dict(docs.dtypes)[id_col]
    ddl = f"sequence_id long, n_tokens int, id_bytes int, input_ids binary, cu_seqlens array<int>, position_resets array<int>, segments array<struct<id:{kind},piece:long,start:long>>"
    pad = pad_id.to_bytes(width, "little")

    def pack(group: pa.Table) -> pa.Table:
        order = np.lexsort((group.column("ids_crc32").to_numpy(), group.column("start").to_numpy(), group.column("seed").to_numpy()))
        group = group.take(pa.array(order))
        lengths = group.column("length").to_pylist()
        bins = best_fit_decreasing(lengths, size)
        members: list[list[int]] = [[] for _ in range(max(bins, default=-1) + 1)]
        for i, b in enumerate(bins):
            members[b].append(i)
        ids, rows = group.column("ids").to_pylist(), group.select(["id", "piece", "start"]).to_pylist()
        shard = group.column("bin_group")[0].as_py() << 32
        matrix, ends = [], []
        for own in members:
            ends.append([0, *np.cumsum([lengths[i] for i in own]).tolist()])
            matrix.append(b"".join(ids[i] for i in own) + pad * (size - ends[-1][-1]))
        columns = [
            pa.array(range(shard, shard + len(members)), pa.int64()),
            pa.array([e[-1] for e in ends], pa.int32()),
            pa.array([width] * len(members), pa.int32()),
            pa.array(matrix, pa.binary()),
            pa.array(ends, pa.list_(pa.int32())),
            pa.array([e[:-1] for e in ends], pa.list_(pa.int32())),
            pa.array([[rows[i] for i in own] for own in members], pa.list_(pa.struct([("id", group.schema.field("id").type), ("piece", pa.int64()), ("start", pa.int64())]))),
        ]
        return pa.table(columns, names=["sequence_id", "n_tokens", "id_bytes", "input_ids", "cu_seqlens", "position_resets", "segments"])

    pieces = tokenised_pieces(docs, tokenizer_path, size, end_id, group_count(docs, text_col), width, id_col, text_col)
    return pieces.withColumn("seed", F.xxhash64("id")).groupBy("bin_group").applyInArrow(pack, ddl)


def position_ids(cu_seqlens) -> list[int]:
    """The positions that a row's resets stand for."""
    return [i for a, b in zip(cu_seqlens, cu_seqlens[1:]) for i in range(b - a)]


def unpack_matrices(packed: DataFrame) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of packed matrices, from their bytes: the inverse of ``pack_matrices``."""
    kind = packed.schema["segments"].dataType.elementType["id"].dataType.simpleString()
    ddl = f"id {kind}, piece long, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                data = np.frombuffer(r["input_ids"], f"<u{r['id_bytes']}").astype("<u4")
                for seg, a, b in zip(r["segments"], r["cu_seqlens"], r["cu_seqlens"][1:]):
                    rows.append((seg["id"], seg["piece"], seg["start"], b - a, zlib.crc32(data[a:b].tobytes()), r["sequence_id"], a))
            types = [batch.schema.field("segments").type.value_type.field("id").type, *[pa.int64()] * 6]
            names = ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    return packed.mapInArrow(run, ddl)
