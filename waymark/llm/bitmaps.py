"""Bitmaps of hashed keys, built by the executors and broadcast: they rule rows out before a shuffle.

A bitmap may let a key through that isn't in it, never the reverse, so an exact join
on the keys follows wherever one is used. Its size follows the number of keys up to
``MOST_BITS`` (32 MB); beyond that more rows pass and results stay the same.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MOST_BITS, PARTS = 28, 32


def bits_for(keys: int, places: int = 32) -> int:
    """The logarithm of the bitmap's size in bits, ``places`` or more for each key up to the largest size."""
    return max(16, min(MOST_BITS, (places * keys).bit_length()))


def numbers_of(column: pa.Array) -> np.ndarray:
    """A 64-bit number per value: longs as they are, binaries by their first 8 bytes."""
    if pa.types.is_integer(column.type):
        return column.to_numpy(zero_copy_only=False).view(np.uint64)
    return np.frombuffer(b"".join(x[:8] for x in column.to_pylist()), np.uint64)


def is_in(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the 64-bit ``keys`` the bitmap may hold."""
    at = keys & np.uint64(8 * len(bitmap) - 1)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0


def collect_bitmap(keys: DataFrame, bits: int) -> bytes:
    """The bitmap of the only column of ``keys``, hashed longs or binaries: 2**bits bits, whatever their number."""
    size = 1 << bits - 3

    def mark(batches):
        own = np.zeros(size, np.uint8)
        for batch in batches:
            if batch.num_rows:
                at = numbers_of(batch.column(0)) & np.uint64((1 << bits) - 1)
                np.bitwise_or.at(own, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        used = [(k, zlib.compress(x.tobytes(), 1)) for k, x in enumerate(np.split(own, PARTS)) if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in used], pa.int32()), pa.array([x for _, x in used], pa.binary())], ["part", "marks"])

    def merge(batches):
        whole: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("marks").to_pylist(), strict=True):
                whole[part] = whole.get(part, np.uint8(0)) | np.frombuffer(zlib.decompress(data), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(list(whole), pa.int32()), pa.array([x.tobytes() for x in whole.values()], pa.binary())], ["part", "marks"])

    ddl = "part int, marks binary"
    by = {r.part: bytes(r.marks) for r in keys.mapInArrow(mark, ddl).repartition(PARTS, "part").mapInArrow(merge, ddl).collect()}
    return b"".join(by.get(k, bytes(size // PARTS)) for k in range(PARTS))
