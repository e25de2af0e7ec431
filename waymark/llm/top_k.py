"""Operator 8: exact top-k by integer inner product, term at a time.

Vectors become integers and are packed, where they are read, into blocks of bounded
size. With n blocks of candidates the work is a square of sqrt(n) by sqrt(n) cells: a
candidate block goes to the cells of one row, a query block to those of one column, so
every query meets every candidate and a block is copied sqrt(n) times. In a cell a
block's postings are made once, by dimension; every query scatters its weighted
postings into a dense score array, the best k are selected by partition and merged
with the query's best so far, and at last the cells' lists are merged.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK, BLOCK = 256, 8192


def packed(vectors: np.ndarray) -> tuple[int, bytes]:
    """Bytes a number, and the integers in the narrowest type that holds them."""
    top = int(np.abs(vectors).max(initial=0))
    width = 2 if top < 1 << 15 else 4 if top < 1 << 31 else 8
    return width, vectors.astype(f"<i{width}").tobytes()


def _pack(size: int):
    def run(batches):
        held: dict[int, list] = {}

        def emit(width, rows):
            number, data = packed(np.array([r[1] for r in rows], np.int64).reshape(len(rows), width))
            return pa.RecordBatch.from_pydict({"width": pa.array([width], pa.int32()), "number": pa.array([number], pa.int32()), "ids": pa.array([np.array([r[0] for r in rows], np.int64).tobytes()], pa.binary()), "vectors": pa.array([data], pa.binary())})

        for batch in batches:
            for own, vector in zip(batch.column("id").to_pylist(), batch.column("vector").to_pylist(), strict=True):
                rows = held.setdefault(len(vector), [])
                rows.append((own, vector))
                if len(rows) == size:
                    yield emit(len(vector), rows)
                    rows.clear()
        for width, rows in held.items():
            if rows:
                yield emit(width, rows)

    return run


class Postings:
    """The inverted lists of a block: for each dimension the rows that have it and their values; a list of most rows is kept as a whole column."""

    def __init__(self, block: np.ndarray):
        self.rows, self.lists = len(block), []
        for column in np.ascontiguousarray(block.T):
            at = np.flatnonzero(column)
            self.lists.append((None, column) if 2 * len(at) > len(column) else (at, column[at]))

    def scores(self, query: np.ndarray) -> np.ndarray:
        """The query's score with every row of the block, accumulated term by term."""
        total, part = np.zeros(self.rows, np.int64), np.empty(self.rows, np.int64)
        for t in np.flatnonzero(query).tolist():
            at, values = self.lists[t]
            if at is None:
                np.multiply(values, query[t], out=part)
                total += part
            elif len(at):
                total[at] += values * query[t]
        return total


def select_top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        bar = np.partition(scores, len(scores) - k)[len(scores) - k]
        over = np.flatnonzero(scores > bar)
        tied = np.flatnonzero(scores == bar)
        if len(over) + len(tied) > k:
            tied = tied[np.argpartition(ids[tied], k - len(over) - 1)[: k - len(over)]]
        at = np.concatenate([over, tied])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))]


def _search(k: int, most_held: int = 200_000):
    """A cell's pairs of blocks; each query's best k so far are held, and sent when there are ``most_held`` queries and at the end."""

    def sent(best):
        at = [np.full(len(ids), q) for q, (ids, _) in best.items()]
        columns = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (at, [b[0] for b in best.values()], [b[1] for b in best.values()])]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    def run(batches):
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        seen = postings = None
        for batch in batches:
            for j in range(batch.num_rows):
                r = {c: batch.column(c)[j].as_py() for c in batch.schema.names}
                ids = np.frombuffer(r["ids"], np.int64)
                if seen != r["ids"]:
                    seen, postings = r["ids"], Postings(np.frombuffer(r["vectors"], f"<i{r['number']}").reshape(len(ids), r["width"]).astype(np.int64))
                q_ids = np.frombuffer(r["q_ids"], np.int64)
                queries = np.frombuffer(r["q_vectors"], f"<i{r['q_number']}").reshape(len(q_ids), r["width"]).astype(np.int64)
                for q, query in zip(q_ids.tolist(), queries, strict=True):
                    scores = postings.scores(query)
                    other = np.flatnonzero(ids != q) if (ids == q).any() else slice(None)
                    own, points = ids[other], scores[other]
                    at = select_top(points, own, k)
                    own, points = own[at], points[at]
                    if q in best:
                        own, points = np.concatenate([best[q][0], own]), np.concatenate([best[q][1], points])
                        at = select_top(points, own, k)
                        own, points = own[at], points[at]
                    best[q] = own, points
                if len(best) >= most_held:
                    yield sent(best)
                    best = {}
        yield sent(best)

    return run


def exact_top_k(vectors: DataFrame, query_filter, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank from 1, vec_id, score): each query row's k best other rows; fewer if there are fewer.

    Components are floor(scale * x). Rows whose vector is null or holds a null, NaN or
    infinite component, and rows without an id, take no part; vectors are compared
    with those of their own length, empty ones score 0. Ties go to the smaller id. A query
    meets every row but those of its own id; rows that repeat an id are candidates each by
    itself, and as queries give one list of k places that their rows share. Scores are to
    fit in 64 bits. An empty table
    gives no rows. Other columns are not read.
    """
    v = F.col(vector_col)
    number = F.transform(v, lambda x: F.floor(scale * x.cast("double")).cast("long"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.filter(F.col(id_col).isNotNull() & v.isNotNull()).filter(~bad).select(F.col(id_col).cast("long").alias("id"), number.alias("vector"), F.coalesce(query_filter, F.lit(False)).alias("asked"))
    ddl = "width int, number int, ids binary, vectors binary"
    side = math.ceil(math.sqrt(max(1, math.ceil(vectors.count() / BLOCK))))
    every = F.explode(F.sequence(F.lit(0), F.lit(side - 1)).cast("array<long>"))
    blocks = rows.select("id", "vector").mapInArrow(_pack(BLOCK), ddl).withColumn("r", F.pmod(F.xxhash64("ids"), F.lit(side))).withColumn("c", every)
    asked = rows.filter("asked").dropDuplicates(["id", "vector"]).select("id", "vector").mapInArrow(_pack(QUERY_BLOCK), ddl).toDF("width", "q_number", "q_ids", "q_vectors")
    asked = asked.withColumn("c", F.pmod(F.xxhash64("q_ids"), F.lit(side))).withColumn("r", every)
    found = blocks.join(asked, ["r", "c", "width"]).select("width", "number", "ids", "vectors", "q_number", "q_ids", "q_vectors").mapInArrow(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
