"""Operator 13: draws documents so that their features look like those of a target set.

1. Word runs of one and two words are counted into ``BUCKETS`` buckets by crc32, once
   over all documents and once over the target; a task sends its sums only.
2. The logarithms of the two sets' rates make an array of gains, one for each bucket. A
   second reading scores every document: the floored mean of its features' gains, plus
   noise (Gumbel) that follows from its id. These scores are written to the shared folder.
3. The score down to which documents are drawn is found by bisection: jobs count the
   written rows from a score up, ``CUTS`` scores a job, until one score is left. Of the
   rows that have just this score, ids are bisected alike.
4. The drawn rows are dealt by ranges of score and id and sorted within; a row's rank is
   its place there plus the sizes of the ranges before.

The driver holds the two arrays, the counts of a job and the size of each range.

Defined results: null and empty texts and those without a word have no features, weight
0 and are not drawn. Texts are read in slices, so their length isn't bounded. A null id
has the noise of the empty string and comes last among equal scores. Rows that repeat an
id are scored and drawn apart; where the limit falls between such rows those with the
larger weight, then fewer features, come first. An empty target makes every gain speak
against frequent buckets; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import bounded_batches, materialise

BUCKETS = 10_000
#: Scores or ids that one job of the bisection counts from: four halvings at a time.
CUTS = 15
#: Bytes of a text that are held as words at a time.
SLICE = 1 << 20

#: A-Z become a-z; 0-9, a-z and all bytes of other characters stay; the rest parts words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def feature_buckets(text: str | None) -> Iterator[np.ndarray]:
    """The buckets of a text's features, an array for each slice of it."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)
    at, last = 0, None
    while at < len(data):
        end = data.find(b" ", at + SLICE)
        words = data[at : end if end >= 0 else len(data)].split()
        at = end if end >= 0 else len(data)
        if not words:
            continue
        single = list(map(crc32, words))
        pairs = map(crc32, map(b" ".__add__, words[1:]), single)
        joint = () if last is None else (crc32(b" " + words[0], last),)
        yield np.fromiter(chain(single, joint, pairs), np.int64, 2 * len(words) - 1 + len(joint)) % BUCKETS
        last = single[-1]


def bucket_counts(texts: DataFrame, text_col: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def count(batches):
        own = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for buckets in feature_buckets(text.as_py()):
                    own += np.bincount(buckets, minlength=BUCKETS)
        used = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(own[used])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in bounded_batches(texts.select(text_col)).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains_of(counts: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket floor(1000 ln(rate in the target / rate in all)), with one added to every count."""
    all_s, all_t = float(counts.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (all_s + BUCKETS) / ((s + 1.0) * (all_t + BUCKETS)))) for s, t in zip(counts.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_features, weight) of every document."""

    def each(batches):
        for batch in batches:
            sizes, weights = [], []
            for text in batch.column(1):
                n = total = 0
                for buckets in feature_buckets(text.as_py()):
                    n += len(buckets)
                    total += int(gains[buckets].sum())
                sizes.append(n)
                weights.append(total // n if n else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(weights, pa.int64())], [id_col, "n_features", "weight"])

    kind = docs.schema[id_col].dataType.simpleString()
    return bounded_batches(docs.select(id_col, text_col)).mapInArrow(each, f"`{id_col}` {kind}, n_features long, weight long")


def noise(id_: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the id and the seed alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def least_reaching(rows: DataFrame, value: Column, wanted: int, low: int, high: int) -> int:
    """The least v in low..high for which at least ``wanted`` rows have ``value`` <= v (all of them do at ``high``)."""
    while low < high:
        cuts = sorted({low + (high - low) * k // (CUTS + 1) for k in range(CUTS + 1)})
        counts = rows.agg(*(F.count(F.when(value <= F.lit(v).cast("long"), 1)) for v in cuts)).first()
        reached = [v for v, n in zip(cuts, counts, strict=True) if n >= wanted]
        high = reached[0] if reached else high
        low = max([low, *(v + 1 for v, n in zip(cuts, counts, strict=True) if n < wanted)])
    return high


def draw(scored: DataFrame, may: Column, percent: int, id_col: str = "doc_id") -> DataFrame:
    """``scored`` (a written table with id, n_features, weight, score) with the rank of drawn rows.

    Of the rows for which ``may`` holds floor(percent * their number / 100) are drawn,
    by score downwards, then id.
    """
    spark, id_ = scored.sparkSession, F.col(id_col)
    pool = scored.filter(may)
    n, low, high = pool.agg(F.count("*"), F.min(-F.col("score")), F.max(-F.col("score"))).first()
    wanted = percent * n // 100
    if not wanted:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    cutoff = -least_reaching(pool, -F.col("score"), wanted, low, high)
    ties = pool.filter(F.col("score") == cutoff)
    above, named, least, most = pool.agg(F.count(F.when(F.col("score") > cutoff, 1)), F.count(F.when(F.col("score") == cutoff, id_)), F.min(F.when(F.col("score") == cutoff, id_)), F.max(F.when(F.col("score") == cutoff, id_))).first()
    tied = F.col("score") == cutoff
    if wanted - above <= named:
        tied &= id_ <= least_reaching(ties, id_, wanted - above, least, most)
    drawn = F.coalesce(may & ((F.col("score") > cutoff) | tied), F.lit(False))
    order = [F.col("score").desc(), id_.asc_nulls_last(), F.col("weight").desc(), F.col("n_features")]
    placed = materialise(scored.filter(drawn).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "drawn")
    sizes = sorted(placed.groupBy(F.shiftright("place", 33).cast("int").alias("range")).count().collect())
    starts, total = [], 0
    for number, size in sizes:
        starts.append((number, total))
        total += size
    ranked = placed.withColumn("range", F.shiftright("place", 33).cast("int")).join(spark.createDataFrame(starts, "range int, start long"), "range")
    rank = F.col("start") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    ranked = ranked.select(*scored.columns, F.when(rank <= wanted, rank).alias("rank"))
    return ranked.unionByName(scored.filter(~drawn).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's id, n_features, weight, score and rank (null: not drawn)."""
    gains = gains_of(bucket_counts(docs, text_col), bucket_counts(target))
    scored = weigh(docs, gains, id_col, text_col).withColumn("score", F.col("weight") + noise(F.col(id_col), seed))
    scored = materialise(scored, "scored")
    return draw(scored, F.col("n_features") >= 2 * min_words - 1, percent, id_col)
