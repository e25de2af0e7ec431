"""Operator 6: removes lines that repeat an earlier line, exactly or within one edit.

Lines are cut at line feeds and compared as code points. A line of ``min_chars`` or
more is removed if any earlier one so long, in the order of (document id, line number),
is within one insertion, deletion or replacement of it, be that line itself removed or
not; so the rule does not hang on the order of work. A shorter one of ``exact_chars`` or
more that isn't blank is removed if an earlier line is equal; without ``exact_chars``
short lines are never removed.

Two lines within one edit agree in their first or their last h characters, h being
half the shorter one's length (pigeonhole). The halves of distinct lines are counted and
a bitmap tells those that occur twice; only lines with such a half are sent as texts and
go on to the deletion neighbourhood, where each emits hashed keys: one for
every (variant, place of deletion), equal for lines with a replaced character, and
one for every variant and for the line as it is, equal for lines with an inserted
one. Equal keys are grouped and only their earliest members kept, so a group of m
lines costs m rows. The distance to the earliest line is then verified on the texts.
"""

from __future__ import annotations

from hashlib import blake2b
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bitmaps import bits_for, collect_bitmap, is_in
from .scratch import bounded_batches, materialise
from .textarrays import Rolling, codes_of, mix, small_groups

MIN_CHARS = 20


#: Code points of which a blank line consists.
BLANK = np.array([9, 11, 12, 13, 32])


def _hashed(texts: list[str], min_chars: int, exact_chars: int):
    """(owner, number, lines, n, h1, h2, long, halves) of the lines that count, over the joined texts; h1 and h2 are a digest's halves, ``halves`` the hashes of the first and last halves of the long ones."""
    joined = "\n".join(texts)
    codes = codes_of(joined + "\n")
    ends = np.flatnonzero(codes == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    edges = np.cumsum([0, *(len(t) + 1 for t in texts)])
    first = np.searchsorted(starts, edges)
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    number = np.arange(len(starts)) - first[owner]
    solid = np.concatenate([[0], np.cumsum(~np.isin(codes, BLANK))])
    long = ends - starts >= min_chars
    keep = long | ((ends - starts >= exact_chars) & (solid[ends] > solid[starts]))
    lines = list(compress(joined.split("\n"), keep.tolist()))
    digests = b"".join(blake2b(x.encode("utf-8", "surrogatepass"), digest_size=16).digest() for x in lines)
    names = np.frombuffer(digests, "<i8").reshape(-1, 2)
    n, halves, roll = (ends - starts)[keep], [], Rolling(codes)
    x0, y0 = starts[long], ends[long]
    for shorter in (y0 - x0, y0 - x0 - 1):
        h, tag = shorter // 2, shorter.astype(np.uint64) << np.uint64(1)
        for side, (x, y) in enumerate(((x0, x0 + h), (y0 - h, y0))):
            halves.append(roll.spans(x, y) ^ (tag + np.uint64(side)))
    return owner[keep], number[keep], lines, n, names[:, 0].copy(), names[:, 1].copy(), long[keep], np.column_stack(halves)


def _hash_lines(batches, min_chars: int, exact_chars: int):
    """(row, line, n, h1, h2, halves) of every line that is long enough; no halves for a line under ``min_chars``."""
    for batch in batches:
        ids, texts = batch.column("row"), batch.column("text").to_pylist()
        for a, b in small_groups(texts):
            owner, number, _, n, h1, h2, long, halves = _hashed(texts[a:b], min_chars, exact_chars)
            edges = np.concatenate([[0], np.cumsum(long * 4)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(halves.view(np.int64).reshape(-1)))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(owner + a)), pa.array(number, pa.int64()), pa.array(n, pa.int64()), pa.array(h1), pa.array(h2), lists], ["row", "line", "n", "h1", "h2", "halves"])


def _candidates(batches, min_chars: int, bitmap: np.ndarray):
    """(h1, h2, text) of the long lines that have a half in the bitmap. A task sends a line once."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        texts, out = batch.column("text").to_pylist(), []
        for a, b in small_groups(texts):
            _, _, lines, _, h1, h2, long, halves = _hashed(texts[a:b], min_chars, min_chars)
            held = np.flatnonzero(long)[is_in(bitmap, halves).any(axis=1)] if len(halves) else ()
            for i in held:
                name = int(h1[i]), int(h2[i])
                if name not in seen:
                    out.append((*name, lines[i]))
                    if len(seen) < 1_000_000:
                        seen.add(name)
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["h1", "h2", "text"])


def neighbourhood(line: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Keys of a line's code points: (variant and place) for each deletion, variant alone for each, and the line as it is."""
    n = len(line)
    roll = Rolling(line)
    alone = roll.without_one()
    with np.errstate(over="ignore"):
        placed = mix(alone + np.uint64(0x9E3779B97F4A7C15) * np.arange(1, n + 1, dtype=np.uint64))
    return placed, alone, int(roll.spans(np.array([0]), np.array([n]))[0])


def _variants(batches):
    """(key, kind, row, line): kind 0 keys make lines with one replacement meet; 1 is the line as it is, 2 a line with one character taken out."""
    for batch in batches:
        keys, kinds, rows = [], [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            placed, alone, own = neighbourhood(codes_of(text))
            alone = np.unique(alone)
            keys += [placed, alone, np.array([own], np.uint64)]
            kinds += [np.zeros(len(placed), np.int32), np.full(len(alone), 2, np.int32), np.ones(1, np.int32)]
            rows.append(np.full(len(placed) + len(alone) + 1, i))
            if sum(map(len, rows)) > 200_000:
                yield _variant_batch(batch, keys, kinds, rows)
                keys, kinds, rows = [], [], []
        if rows:
            yield _variant_batch(batch, keys, kinds, rows)


def _variant_batch(batch, keys, kinds, rows):
    take = pa.array(np.concatenate(rows))
    columns = [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(kinds)), *(batch.column(c).take(take) for c in ("row", "line"))]
    return pa.RecordBatch.from_arrays(columns, ["key", "kind", "row", "line"])


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", exact_chars: int | None = None) -> DataFrame:
    """(row, line) of every line to remove, lines counted from 0. A distinct line goes by its first place."""
    base = bounded_batches(docs).select(F.col(id_col).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = base.schema["row"].dataType
    least = min_chars if exact_chars is None else exact_chars
    lines = base.mapInArrow(lambda it: _hash_lines(it, min_chars, least), f"row {kind.simpleString()}, line long, n long, h1 long, h2 long, halves array<long>")
    distinct = lines.groupBy("h1", "h2").agg(F.min(F.struct("row", "line")).alias("place"), F.count("*").alias("copies"), F.first("halves").alias("halves"))
    distinct = materialise(distinct.select("h1", "h2", "place.row", "place.line", "copies", "halves"), "distinct")
    # texts of the lines that share a half with another
    halves = distinct.select(F.explode(F.array_distinct("halves")).alias("half")).groupBy("half").agg(F.count("*").alias("members")).filter("members > 1").select("half")
    bitmap = docs.sparkSession.sparkContext.broadcast(collect_bitmap(halves, bits_for(distinct.count(), 8)))
    sent = base.select("text").mapInArrow(lambda it: _candidates(it, min_chars, np.frombuffer(bitmap.value, np.uint8)), "h1 long, h2 long, text string").dropDuplicates(["h1", "h2"])
    texts = materialise(sent.join(distinct, ["h1", "h2"]).select("row", "line", "text"), "candidates")
    # each line with the earliest line it meets
    variants = texts.mapInArrow(_variants, f"key long, kind int, row {kind.simpleString()}, line long").withColumn("family", F.when(F.col("kind") == 0, 0).otherwise(1))
    place = F.struct("row", "line")
    # a group holds distinct lines one insertion away from its key, so it is small however often a line repeats
    group = Window.partitionBy("key", "family")
    whole, cut = (F.min(F.when(F.col("kind") == k, place)).over(group) for k in (1, 2))
    partner = F.when(F.col("kind") == 0, F.min(place).over(group)).when(F.col("kind") == 1, cut).otherwise(whole)
    met = variants.withColumn("p", partner).filter(F.col("p") < place)
    pairs = met.groupBy("row", "line").agg(F.min("p").alias("p")).select(place.alias("at"), "p")
    mine, theirs = texts.select(place.alias("at"), F.col("text").alias("mine")), texts.select(place.alias("of"), F.col("text").alias("theirs"))
    both = pairs.join(mine, pairs["at"].eqNullSafe(mine["at"])).drop(mine["at"]).join(theirs, F.col("p").eqNullSafe(F.col("of")))
    proven = both.filter(F.levenshtein("mine", "theirs", 1) >= 0).select(F.col("at").alias("place"), F.lit(True).alias("near")).distinct()
    all_lines = distinct.select("h1", "h2", place.alias("first"), "copies")
    verdict = all_lines.join(proven, all_lines["first"].eqNullSafe(proven["place"]), "left").select("h1", "h2", F.col("first").alias("place"), "copies", F.coalesce("near", F.lit(False)).alias("near")).filter("copies > 1 or near")
    return lines.select("row", "line", "h1", "h2").join(verdict, ["h1", "h2"]).filter(F.col("near") | (place != F.col("place"))).select("row", "line")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", exact_chars: int | None = None) -> DataFrame:
    """``docs`` with (n_lines, n_removed) added and the repeated lines taken out of the text; a row per row.

    A null text stays null with no lines; an empty one has one empty line; an empty table
    gives no rows; texts of any length are read whole. Of equal lines the first place
    stays, by document id and line number. Ids are taken to name documents: rows that
    repeat an id lose the lines that any of them loses. Rows without an id count as one
    nameless document before all others: it loses no line, others lose lines that repeat
    its lines. Columns of ``docs`` other than the text pass unchanged, whatever their
    names; ones named n_lines or n_removed are replaced.
    """
    row, gone = _unused("row", docs.columns), _unused("gone", docs.columns)
    out = repeated_lines(docs, min_chars, id_col, text_col, exact_chars).groupBy(F.col("row").alias(row)).agg(F.sort_array(F.collect_set("line")).alias(gone))
    lines = _unused("lines", docs.columns)
    kept = docs.join(out, docs[id_col] == out[row], "left").withColumn(lines, F.split(F.col(text_col), "\n"))
    numbers = F.array_except(F.sequence(F.lit(0).cast("long"), F.size(lines).cast("long") - 1), F.col(gone))
    rest = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(numbers, lambda i: F.get(F.col(lines), i.cast("int"))), "\n"))
    n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines))
    return kept.select(
        *[(rest.alias(c) if c == text_col else F.col(c)) for c in docs.columns if c not in ("n_lines", "n_removed")],
        n_lines.cast("long").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"),
    )


def _unused(name: str, columns: list[str]) -> str:
    while name.lower() in {c.lower() for c in columns}:
        name = f"_{name}"
    return name
