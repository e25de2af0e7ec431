"""Operator 12: what each of five filters removes, in every order of the five.

A document's failures are a mask of five bits, so all that the orders need of a part is
how many documents have each mask. In an order the document goes at the first filter
that its mask holds. The orders that begin with the same filters have neighbouring
lexicographic ranks (their Lehmer codes share their first digits), so for each mask the
ranks at which it goes in step k are a few intervals: the counts are added at an
interval's start, taken off at its end, and a prefix sum over the 120 ranks gives every
order's removals. The table of intervals is fixed and knows no data.

Only DataFrame functions are used. Copies are counted by digest, part, mask and label
before they meet, so a text that many rows repeat costs a row for each of these.

Defined results: a null text is empty; it fails A and, if a smaller id has an empty text,
E. Rows without an id never fail E and make none fail; rows that repeat an id and a text
are no copies of one another. Null and empty parts are one part, named by the empty
string. A document is good or toxic if any row of ``labels`` with its id says so. Very
long texts are counted whole. An empty table has no parts and gives no rows. Columns of
``docs`` other than the three named are not read, whatever their names.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
RANKS = factorial(len(FILTERS))


def lehmer_rank(prefix: str) -> int:
    """The lexicographic rank of the first order of the filters that begins with ``prefix``."""
    left, rank = list(FILTERS), 0
    for letter in prefix:
        rank += left.index(letter) * factorial(len(left) - 1)
        left.remove(letter)
    return rank


def removal_intervals(mask: int) -> list[tuple[int, int, int]]:
    """(step, first rank, rank after the last): the orders in which a document of this mask goes in that step."""
    passed = [x for k, x in enumerate(FILTERS) if not mask >> k & 1]
    failed = [x for k, x in enumerate(FILTERS) if mask >> k & 1]
    out: list[tuple[int, int, int]] = []
    for step in range(1, min(len(passed) + 1, len(FILTERS)) + 1):
        starts = sorted(lehmer_rank("".join(before) + x) for before in permutations(passed, step - 1) for x in failed)
        width = factorial(len(FILTERS) - step)
        for at in starts:
            if out and out[-1][0] == step and out[-1][2] == at:
                out[-1] = (step, out[-1][1], at + width)
            else:
                out.append((step, at, at + width))
    return out


def failures(text: Column) -> Column:
    """Bits 0 to 3 of the mask: the filters that look at one text alone.

    A under 200 words; B less than half of the words distinct; C over 2 % of the
    characters in A-Z; D any of # $ % & * |.
    """
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words)
    return (
        F.when(n < 200, 1).otherwise(0)
        + F.when(100 * F.size(F.array_distinct(words)) < 50 * n, 2).otherwise(0)
        + F.when(100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 2 * F.length(text).cast("long"), 4).otherwise(0)
        + F.when(text.rlike("[#$%&*|]"), 8).otherwise(0)
    )


def mask_counts(docs: DataFrame, labels: DataFrame, part: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each mask, of them labelled good and toxic.

    E, a text that a smaller id has too, is decided on groups: of one digest, part, mask
    and label all rows fail it but those with the least id of the whole table.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    marked = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        failures(text).alias("own"),
    )
    told = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    marked = marked.join(told, "id", "left").na.fill(False, ["good", "toxic"])
    kind = ["digest", "part", "own", "good", "toxic"]
    by_id = marked.groupBy("id", *kind).agg(F.count("*").alias("n"))
    groups = by_id.groupBy(kind).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNotNull(), F.col("n")).otherwise(0)).alias("named"), F.min("id").alias("least"), F.min_by("n", "id").alias("at_least"))
    first = F.min("least").over(Window.partitionBy("digest"))
    groups = groups.withColumn("first", first).withColumn("copies", F.col("named") - F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0))
    split = groups.select("part", "own", "good", "toxic", F.explode(F.array(F.struct(F.lit(0).alias("copy"), (F.col("n") - F.col("copies")).alias("n")), F.struct(F.lit(16).alias("copy"), F.col("copies").alias("n")))).alias("x"))
    n = F.col("x.n")
    return split.groupBy("part", (F.col("own") + F.col("x.copy")).alias("mask")).agg(F.sum(n).alias("n"), F.sum(F.when(F.col("good"), n).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic")).filter("n > 0")


def audit(counts: DataFrame) -> DataFrame:
    """A row per part, order and step from the counts of ``mask_counts``.

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley (the sum of the filter's removals over all orders).
    """
    spark = counts.sparkSession
    intervals = spark.createDataFrame([(m, *x) for m in range(1, 1 << len(FILTERS)) for x in removal_intervals(m)], "mask int, step int, lo int, hi int")
    orders = spark.createDataFrame([(k, "".join(x)) for k, x in enumerate(permutations(FILTERS))], "rank int, filter_order string")
    has = [F.col("mask").bitwiseAND(1 << k) > 0 for k in range(len(FILTERS))]
    totals = counts.groupBy("part").agg(
        F.sum("n").alias("total"),
        F.array(*(F.sum(F.when(x, F.col("n")).otherwise(0)) for x in has)).alias("fails"),
        F.array(*(F.sum(F.when(F.col("mask") == 1 << k, F.col("n")).otherwise(0)) for k in range(len(FILTERS)))).alias("only"),
    )
    measures = ["n", "good", "toxic"]
    ends = counts.join(intervals, "mask").select("part", "step", *measures, F.explode(F.array(F.struct(F.col("lo").alias("rank"), F.lit(1).alias("sign")), F.struct(F.col("hi").alias("rank"), F.lit(-1).alias("sign")))).alias("at"))
    ends = ends.select("part", "step", F.col("at.rank").alias("rank"), *((F.col("at.sign") * F.col(m)).alias(m) for m in measures)).filter(F.col("rank") < RANKS)
    grid = totals.select("part", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step")).select("part", "step", F.explode(F.sequence(F.lit(0), F.lit(RANKS - 1))).alias("rank"), *(F.lit(0).cast("long").alias(m) for m in measures))
    differences = ends.unionByName(grid).groupBy("part", "step", "rank").agg(*(F.sum(m).alias(m) for m in measures)).join(totals, "part").join(orders, "rank").repartition("part")
    over_ranks = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    gone = differences.select("part", "step", "rank", "filter_order", "total", "fails", "only", F.sum("n").over(over_ranks).alias("removed"), F.sum("good").over(over_ranks).alias("good_lost"), F.sum("toxic").over(over_ranks).alias("toxic_lost"))
    letter = F.ascii(F.substring("filter_order", F.col("step"), F.lit(1))) - ord("A")
    gone = gone.withColumn("letter", letter)
    over_steps = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return gone.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - F.sum("removed").over(over_steps)).alias("kept"),
        "removed",
        (F.get("fails", F.col("letter")) - F.col("removed")).alias("redundant"),
        F.get("only", F.col("letter")).alias("unique_fails"),
        "good_lost",
        "toxic_lost",
        F.sum("removed").over(Window.partitionBy("part", "letter")).alias("shapley"),
    )
