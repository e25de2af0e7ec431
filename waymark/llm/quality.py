"""Operator 7: quality scores by voting of the nearest labelled documents.

A document is a vector of hashed word, letter and shape counts over its whole
text. On a bounded sample of labelled rows the columns are weighted by how rare they are and a
truncated SVD gives the latent space. The labelled vectors of the sample are broadcast, every
document's cosine to each of them is computed exactly, block by block, and its score is the mean label of its
nearest ones, weighted by similarity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import bounded_batches
from .textarrays import Rolling, small_groups

#: Hash buckets for words, word beginnings and byte pairs.
WORDS, PAIRS = 2048, 2048
_SHAPES = 12
WIDTH = WORDS + PAIRS + _SHAPES

_KIND = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 white, 5 mark, 6 beyond ASCII
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 6
_KIND[[32, 9, 10, 11, 12, 13]] = 4
for _a, _b in ((33, 48), (58, 65), (91, 97), (123, 127)):
    _KIND[_a:_b] = 5
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def features(texts: list[str | None]) -> np.ndarray:
    """A row per text: damped counts of hashed words and byte pairs, each part scaled to length one, and shapes of the text."""
    out = np.zeros((len(texts), WIDTH), np.float32)
    texts = [t or "" for t in texts]
    for a, b in small_groups(texts):
        for c in range(a, b, 64):
            out[c : min(b, c + 64)] = _features(texts[c : min(b, c + 64)])
    return out


def _features(texts: list[str]) -> np.ndarray:
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    sizes = np.array([len(d) for d in data])
    owner = np.repeat(np.arange(len(data)), sizes + 1)
    kind = _KIND[raw]
    low = _LOWER[raw]
    white = kind == 4
    change = np.flatnonzero(np.diff(np.concatenate([[True], white]).astype(np.int8)))
    starts, ends = change[::2], change[1::2]
    h = (Rolling(low).spans(starts, ends) % np.uint64(WORDS)).astype(np.int64)
    who = owner[starts]
    n = len(data)
    words = np.bincount(who * WORDS + h, minlength=n * WORDS).reshape(n, WORDS)
    same = owner[1:] == owner[:-1]
    pair = (low[:-1].astype(np.int64) * 257 + low[1:] * 31 + kind[:-1] * 7 + kind[1:]) % PAIRS
    pairs = np.bincount((owner[:-1] * PAIRS + pair)[same], minlength=n * PAIRS).reshape(n, PAIRS)
    out = np.empty((n, WIDTH), np.float32)
    for at, part in ((0, words), (WORDS, pairs)):
        x = np.log1p(part)
        out[:, at : at + part.shape[1]] = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    total = np.maximum(sizes, 1)
    share = np.stack([np.bincount(owner[kind == k], minlength=n) / total for k in range(1, 7)], 1)
    count = np.bincount(who, minlength=n)
    many = np.maximum(count, 1)
    length = np.bincount(who, ends - starts, minlength=n)
    repeat = np.zeros(n)
    if len(h) > 1:
        again = (h[1:] == h[:-1]) & (who[1:] == who[:-1])
        repeat = np.bincount(who[1:][again], minlength=n)
    distinct = (words > 0).sum(1)
    lines = np.bincount(owner[raw == 10], minlength=n)
    shape = np.column_stack([np.sqrt(share), np.minimum(length / many / 20, 2), repeat / many, distinct / np.minimum(many, WORDS), words.max(1) / many, np.log1p(sizes) / 12, np.minimum(lines / many, 1)])
    out[:, -_SHAPES:] = shape
    return out


def nearest(cosine: np.ndarray, k: int) -> np.ndarray:
    """The columns of the k largest values of each row; of equal ones the first."""
    if k >= cosine.shape[1]:
        return np.tile(np.arange(cosine.shape[1]), (len(cosine), 1))
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    bar = np.take_along_axis(cosine, near, 1).min(1, keepdims=True)
    for i in np.flatnonzero((cosine >= bar).sum(1) > k).tolist():
        near[i] = np.argsort(-cosine[i], kind="stable")[:k]
    return near


@dataclass(frozen=True)
class Voters:
    """What is broadcast: scales and projection of the features, and the labelled vectors. Its size is fixed by ``rows`` and ``rank``."""

    mean: np.ndarray
    scale: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int

    def project(self, x: np.ndarray) -> np.ndarray:
        y = ((x - self.mean) * self.scale) @ self.basis
        return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9)

    def score(self, texts: list[str | None], block: int = 256) -> np.ndarray:
        out = np.empty(len(texts))
        k = min(self.neighbours, len(self.labels))
        for a in range(0, len(texts), block):
            cosine = self.project(features(texts[a : a + block])) @ self.vectors.T
            near = nearest(cosine, k)
            weight = np.exp(12 * (np.take_along_axis(cosine, near, 1) - 1)).astype(np.float64)
            out[a : a + block] = (weight * self.labels[near]).sum(1) / weight.sum(1)
        return np.clip(out, 0.0, 1.0)


def fit(x: np.ndarray, labels: list[int], rank: int = 48, neighbours: int = 25) -> Voters:
    """Column weights, a truncated SVD by subspace iteration, and the projected rows, from rows of ``features``."""
    y = np.array(labels, np.float64)
    mean = x.mean(0)
    seen = (x > 0).mean(0)
    scale = np.log1p(1 / np.maximum(seen, 1 / len(x))).astype(np.float32)
    scale[-_SHAPES:] = 0.6 / np.maximum(x[:, -_SHAPES:].std(0), 1e-3)
    z = (x - mean) * scale
    rank = min(rank, *z.shape)
    q = np.random.default_rng(7).standard_normal((z.shape[1], min(rank + 16, z.shape[1]))).astype(np.float32)
    for _ in range(5):
        q = np.linalg.qr(z.T @ (z @ q))[0]
    basis = (q @ np.linalg.svd(z @ q, full_matrices=False)[2].T)[:, :rank].astype(np.float32)
    made = Voters(mean, scale, basis, np.empty((0, rank), np.float32), y, neighbours)
    return Voters(mean, scale, basis, made.project(x), y, neighbours)


def held_out(id_col):
    """Rows that no label is learnt from: crc32 of the id as text, modulo 5, is 0."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0


def train(docs: DataFrame, labels: DataFrame, rows: int = 4000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Voters:
    """Fit on at most ``rows`` labelled rows, half of each label, chosen by a hash of the id.

    Held-out rows and null labels are left out; an id with several labels counts as
    its largest. Features are taken from whole texts by the executors, and their
    non-zero entries (a few KB a row) are what reaches the driver.
    """
    own = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~F.coalesce(held_out(id_col), F.lit(True)))
    own = own.groupBy(id_col).agg(F.max(label_col).alias("_label"))
    sample = None
    for value in (0, 1):
        part = own.filter(F.col("_label") == value).orderBy(F.xxhash64(id_col), id_col).limit(rows // 2)
        sample = part if sample is None else sample.union(part)
    texts = bounded_batches(docs).select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        for batch in batches:
            places, values = [], []
            for t in batch.column("text").to_pylist():
                x = features([t])[0]
                at = np.flatnonzero(x)
                places.append(at.astype(np.uint16).tobytes())
                values.append(x[at].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("label"), pa.array(places, pa.binary()), pa.array(values, pa.binary())], ["h", "label", "places", "values"])

    joined = texts.join(F.broadcast(sample), id_col).select(F.xxhash64(id_col, "text").alias("h"), F.col("_label").cast("int").alias("label"), "text")
    found = joined.mapInArrow(run, "h long, label int, places binary, values binary").orderBy("h").limit(rows).collect()
    if not found:
        return Voters(np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32), np.zeros((WIDTH, 1), np.float32), np.zeros((1, 1), np.float32), np.array([1.0]), 1)
    x = np.zeros((len(found), WIDTH), np.float32)
    for i, r in enumerate(found):
        x[i, np.frombuffer(r["places"], np.uint16)] = np.frombuffer(r["values"], np.float32)
    return fit(x, [r.label for r in found])


def score_documents(docs: DataFrame, voters: Voters, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted), a row per row of ``docs``; only the text is scored.

    Null and empty texts are scored like any other, by their (empty) counts, texts of
    any length by all their counts. Of labelled rows equally near the first in the order
    of ``train`` vote. Without any labelled row every score is 1. A null id counts as
    held out; rows that repeat get equal scores, an empty table gives no rows. Other
    columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(voters)
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        for batch in batches:
            scores = shared.value.score(batch.column("text").to_pylist()) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(scores, pa.float64())], ["id", "held_out", "score"])

    rows = bounded_batches(docs).select(F.col(id_col).alias("id"), F.coalesce(held_out(id_col), F.lit(True)).alias("held_out"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(run, f"id {kind}, held_out boolean, score double")
    return scored.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def quality_of(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_documents(docs, train(docs, labels))


def keep_good(docs: DataFrame, voters: Voters, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, unchanged, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(voters)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(shared.value.score(batch.column(text_col).to_pylist()) >= threshold))

    return bounded_batches(docs).mapInArrow(run, docs.schema)
