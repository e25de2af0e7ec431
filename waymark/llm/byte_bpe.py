"""Operator 9: byte-level BPE encoding and decoding with a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: a pre-token that is a
token is found with one probe. Tier two merges the rest with a heap of candidate
pairs over a doubly linked list of bytes. Pre-tokens resolved before come from the
worker's table.
"""

from __future__ import annotations

import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import bounded_batches
from .textarrays import WordTable, look_up_texts
from .vocabulary import ranks_of


def _hashed(key: bytes, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(key, digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")


class PerfectHash:
    """Hash and displace: keys fall in buckets, and each bucket, largest first, gets the first
    displacement that sends its keys to free places; a bucket of one key names its place
    itself, as a negative number. n keys take n places."""

    def __init__(self, keys: list[bytes], load: int = 2):
        n = self.size = len(keys)
        self.buckets = max(1, n // load)
        own = [_hashed(k, 0) for k in keys]
        by: dict[int, list[int]] = {}
        for i, h in enumerate(own):
            by.setdefault(h % self.buckets, []).append(i)
        self.displacement = [0] * self.buckets
        self.key_at: list[bytes] = [b""] * n
        self.place_of: list[int] = [0] * n
        free = bytearray(b"\1") * n
        lowest = 0
        for bucket, members in sorted(by.items(), key=lambda x: (-len(x[1]), x[0])):
            d = 0
            while True:
                if len(members) == 1:
                    lowest = free.index(1, lowest)
                    d, places = -1 - lowest, [lowest]
                    break
                places = [self._place(own[i], d) for i in members]
                if len(set(places)) == len(places) and all(free[p] for p in places):
                    break
                d += 1
            self.displacement[bucket] = d
            for i, p in zip(members, places, strict=True):
                free[p], self.key_at[p], self.place_of[i] = 0, keys[i], p

    def _place(self, h: int, d: int) -> int:
        if d < 0:
            return -1 - d
        x = (h ^ (d * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
        x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF
        return (x ^ (x >> 32)) % self.size

    def find(self, key: bytes) -> int:
        """The key's place, or -1."""
        h = _hashed(key, 0)
        place = self._place(h, self.displacement[h % self.buckets])
        return place if self.key_at[place] == key else -1


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        keys = list(ranks)
        self.index = PerfectHash(keys)
        self.rank_at = [0] * len(keys)
        for key, place in zip(keys, self.index.place_of, strict=True):
            self.rank_at[place] = ranks[key]
        self.longest = max(map(len, keys))
        self.table = WordTable(lambda words: [self.word(w.encode("utf-8", "surrogatepass")) for w in words], limit=1_500_000)
        most = max(ranks.values()) + 1
        self.text_of, self.name_of = [b""] * most, [str(i) for i in range(most)]
        for key, i in ranks.items():
            self.text_of[i] = key

    def word(self, word: bytes) -> list[int]:
        if len(word) <= self.longest:
            place = self.index.find(word)
            if place >= 0:
                return [self.rank_at[place]]
        return self.merge(word)

    def merge(self, word: bytes) -> list[int]:
        """Merge the pair of lowest rank, leftmost first, until none is left; n log n for n bytes."""
        n = len(word)
        get, push, pop = self.ranks.get, heapq.heappush, heapq.heappop
        bits = max(10, n.bit_length())  # a heap entry is one number: rank, where the pair begins, where it ends
        low, high = (1 << bits) - 1, 2 * bits
        end = list(range(1, n + 1))  # where the part that begins here ends; 0 once it is merged away
        back = list(range(-1, n - 1))
        heap = [r << high | i << bits | i + 2 for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            x = pop(heap)
            upto, at = x & low, x >> bits & low
            mid = end[at]
            if not mid or mid >= n or end[mid] != upto:
                continue
            end[at], end[mid] = upto, 0
            if upto < n:
                back[upto] = at
                if (r := get(word[at : end[upto]])) is not None:
                    push(heap, r << high | at << bits | end[upto])
            before = back[at]
            if before >= 0 and (r := get(word[before:upto])) is not None:
                push(heap, r << high | before << bits | upto)
        out, at = [], 0
        while at < n:
            out.append(self.ranks[word[at : end[at]]])
            at = end[at]
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return look_up_texts(self.table, texts)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.text_of.__getitem__, ids))


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(ranks_of(path))


def encode_texts(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, with_digests: bool = False) -> DataFrame:
    """(id, n_tokens[, ids array<int>, decoded binary][, ids_sha256, decoded_sha256]), a row per row of ``docs``.

    The ids are decoded again in the same pass. A null text counts as empty: no
    ids, no bytes. Texts of any length are read whole; an empty table gives no rows.
    Ids may be null or repeat; other columns are not read.
    """
    kind = dict(docs.dtypes)[id_col]
    names = ["id", "n_tokens"] + ["ids", "decoded"] * with_ids + ["ids_sha256", "decoded_sha256"] * with_digests

    def run(batches):
        bpe = byte_bpe(ranks_path)
        name = bpe.name_of.__getitem__
        for batch in batches:
            found = bpe.encode(batch.column("text").to_pylist())
            columns = [batch.column("id"), pa.array(map(len, found), pa.int64())]
            ids = [x.tolist() for x in found]
            decoded = [bpe.decode(x) for x in ids]
            if with_ids:
                columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.binary())]
            if with_digests:
                columns += [pa.array([hashlib.sha256(" ".join(map(name, x)).encode()).hexdigest() for x in ids], pa.string())]
                columns += [pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names)

    ddl = f"id {kind}, n_tokens long" + ", ids array<int>, decoded binary" * with_ids + ", ids_sha256 string, decoded_sha256 string" * with_digests
    rows = bounded_batches(docs).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, ddl).withColumnRenamed("id", id_col)


def decode_ids(tokens: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded binary) of rows of token ids; null ids give null."""
    kind = dict(tokens.dtypes)[id_col]

    def run(batches):
        bpe = byte_bpe(ranks_path)
        for batch in batches:
            out = [None if x is None else bpe.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], ["id", "decoded"])

    rows = tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"id {kind}, decoded binary").withColumnRenamed("id", id_col)
