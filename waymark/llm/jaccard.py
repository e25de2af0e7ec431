"""Operator 4: documents whose word n-gram sets have a high Jaccard similarity.

1. A document's set of shingle hashes is named by its digest; equal sets are one
   class, so copies cost one row each and no pairs.
2. Shingles are ordered by how often their hash bucket occurs in the whole corpus
   (a table of fixed size), rare ones first. Sets as similar as asked share one of
   their first n - ceil(t n) + 1 shingles (prefix filter). Of these only the bare
   keys are counted; those that occur once in the corpus are ruled out by a bitmap
   before rows are shuffled.
3. Lists of up to ``SMALL`` sets give their pairs, less those whose sizes or whose
   remaining overlap rule a link out. In a larger list every set is paired with one
   member, drawn anew for each shingle; m sets make m pairs, and a large group of
   near copies is joined up by them.
4. What is left are larger lists with sets of different components: there every set
   is paired with those of other components whose size, remaining overlap and parities
   allow it.
5. A pair is ruled out where the parities of its sets over 256 bins put their difference
   above the one allowed, or their counts over a few bins (a sketch of a byte for some
   three shingles) bound their overlap below the one required.
6. Pairs are decided by T-occurrence search: the sets paired with a query are kept
   as inverted lists, the short lists are merged by a heap, the long ones probed by
   binary search (DivideSkip), and sets that reach the required overlap are kept.

A set's 64-bit shingle hashes stand for its shingles, and 128 bits for the set. Counts
of a key are formed before its rows meet and joined back to them, so that Spark can
split a key that is in very many sets.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .bitmaps import bits_for, collect_bitmap, is_in, numbers_of
from .components import connected_components
from .scratch import bounded_batches, materialise, release
from .textarrays import Rolling, mix, small_groups

#: Hash buckets of the corpus counts, and parts they are shuffled in.
BUCKETS, PARTS = 1 << 21, 32
#: Members up to which all pairs of a list are looked at at once.
SMALL = 8
#: Sets that one T-occurrence search holds as inverted lists.
CELL = 256
#: DivideSkip's tuning constant: how much dearer a probe is than a heap step.
MU = 0.01

PARITIES = ["q0", "q1", "q2", "q3"]

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    Words are maximal runs without ASCII white space, A-Z lower-cased. A text with
    fewer words than a shingle has its whole sequence as one; one without words, or
    null, has none.
    """
    out: list[np.ndarray] = []
    texts = [t or "" for t in texts]
    for a, b in small_groups(texts):
        out += _sets(texts[a:b], words)
    return out


def _sets(texts: list[str], words: int) -> list[np.ndarray]:
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    codes = _LOWER[np.frombuffer(b" ".join(data) + b" ", np.uint8)]
    edges = np.cumsum([0, *(len(d) + 1 for d in data)])
    blank = _BLANK[codes]
    change = np.flatnonzero(np.diff(np.concatenate([[True], blank]).astype(np.int8)))
    starts, ends = change[::2], change[1::2]
    h = Rolling(codes).spans(starts, ends)
    first = np.searchsorted(starts, edges)
    grams = _gram(h, words)
    out = []
    for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if j - i >= words:
            out.append(_distinct(grams[i : j - words + 1]))
        else:
            out.append(_gram(h[i:j], j - i) if j > i else np.empty(0, np.uint64))
    return out


def _gram(h: np.ndarray, words: int) -> np.ndarray:
    if len(h) < words:
        return np.empty(0, np.uint64)
    n = len(h) - words + 1
    with np.errstate(over="ignore"):
        g = mix(h[:n] + np.uint64(words))
        for k in range(1, words):
            g = mix(g * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return g


def _distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def required(n: int, m: int, percent: int) -> int:
    """The least overlap at which sets of n and m elements are similar enough."""
    return -(-percent * (n + m) // (100 + percent))


# --- sketches -----------------------------------------------------------------------


def sketch(hashes: np.ndarray) -> bytes:
    """How many of the hashes fall in each of 2**k bins, two to four a bin; empty where a count is over a byte, which bounds nothing."""
    bins = 1 << max(4, (max(len(hashes), 1) - 1).bit_length() - 2)
    counts = np.bincount((hashes & np.uint64(bins - 1)).astype(np.int64), minlength=bins)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """Four 64-bit words a set: for each of 256 bins, whether an odd number of its shingles falls in it. Two sets differ in as many shingles as bits, at least."""
    flat = np.concatenate([np.empty(0, np.uint64), *sets])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    odd = np.bincount(owner * 256 + ((flat >> np.uint64(40)) & np.uint64(255)).astype(np.int64), minlength=256 * len(sets)) & 1
    return np.packbits(odd.astype(np.uint8).reshape(len(sets), 256), axis=1, bitorder="little").view(np.int64)


def most_common(x: bytes, y: bytes) -> int | None:
    """The most elements that the sets of two sketches can share, if the sketches bound it."""
    if not x or not y:
        return None
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    bins = min(len(a), len(b))
    a, b = (v.reshape(-1, bins).sum(0, dtype=np.int64) for v in (a, b))
    return int(np.minimum(a, b).sum())


# --- T-occurrence search ----------------------------------------------------------


def t_occurrence(query: np.ndarray, sets: list[np.ndarray], percent: int) -> list[int]:
    """The indexes of ``sets`` with 100 * intersection >= percent * union against ``query``; arrays sorted, without repeats."""
    if not len(query) or not sets:
        return []
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    needs = np.array([required(len(query), int(n), percent) for n in sizes])
    fit = [i for i in range(len(sets)) if sizes[i] and needs[i] <= min(len(query), sizes[i])]
    if not fit:
        return []
    if len(fit) == 1:
        at = np.searchsorted(query, sets[fit[0]])
        at[at == len(query)] = 0
        return fit if int((query[at] == sets[fit[0]]).sum()) >= needs[fit[0]] else []
    least = int(needs[fit].min())
    flat = np.concatenate([sets[i] for i in fit])
    owner = np.repeat(np.array(fit), sizes[fit])
    at = np.searchsorted(query, flat)
    at[at == len(query)] = 0
    hit = query[at] == flat
    at, owner = at[hit], owner[hit]
    order = np.lexsort((owner, at))
    at, owner = at[order], owner[order]
    cuts = np.flatnonzero(np.diff(at)) + 1
    lists = sorted((x for x in np.split(owner, cuts) if len(x)), key=len)
    if not lists:
        return []
    long = min(least - 1, int(least / (MU * math.log2(len(lists[-1]) + 1) + 1)), len(lists))
    short, probed = lists[: len(lists) - long], lists[len(lists) - long :]
    found, last = {}, -1
    for i in heapq.merge(*(x.tolist() for x in short)):
        if i == last:
            found[i] += 1
        else:
            found[i], last = 1, i
    candidates = np.array([i for i, n in found.items() if n >= needs[i] - long], np.int64)
    if not len(candidates):
        return []
    counts = np.array([found[i] for i in candidates.tolist()])
    for x in probed:
        where = np.searchsorted(x, candidates)
        where[where == len(x)] = 0
        counts += x[where] == candidates
    return candidates[counts >= needs[candidates]].tolist()


# --- Spark stages -----------------------------------------------------------------


def _sets_and_counts(docs: DataFrame, words: int) -> DataFrame:
    """Rows (row, n, set, sketch, q0..q3) for documents, and rows (part, counts) with each task's bucket counts. Of equal sets in a task one has the sketch and the parities."""

    def run(batches):
        total = np.zeros(BUCKETS, np.uint32)
        seen: set[bytes] = set()
        for batch in batches:
            sets = shingle_sets(batch.column("text").to_pylist(), words)
            for a in range(0, len(sets), 1000):
                total += np.bincount((np.concatenate(sets[a : a + 1000]) & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS).astype(np.uint32)
            n, digests = len(sets), list(map(digest, sets))
            sketches = [None if d in seen or not len(s) else sketch(s) for d, s in zip(digests, sets, strict=True)]
            if len(seen) < 200_000:
                seen.update(digests)
            odd, none = parities(sets), np.array([x is None for x in sketches], bool)
            words_of = [pa.array(odd[:, k], mask=none) for k in range(4)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(map(len, sets), pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary()), *words_of, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names
            )
        used = [k for k, x in enumerate(np.split(total, PARTS)) if x.any()]
        blobs = [zlib.compress(total[k * BUCKETS // PARTS : (k + 1) * BUCKETS // PARTS].tobytes(), 1) for k in used]
        n = len(used)
        empty = [pa.nulls(n, t) for t in (id_type, pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * 4)]
        yield pa.RecordBatch.from_arrays([*empty, pa.array(used, pa.int32()), pa.array(blobs, pa.binary())], names)

    names = ["row", "n", "set", "sketch", *PARITIES, "part", "counts"]
    id_type = to_arrow_type(docs.schema["row"].dataType)
    return docs.mapInArrow(run, f"row {docs.schema['row'].dataType.simpleString()}, n long, set binary, sketch binary, {', '.join(f'{q} long' for q in PARITIES)}, part int, counts binary")


def _levels(rows: DataFrame) -> bytes:
    """One byte for each bucket: the bit length of its count in the corpus. Two MB, however large the corpus is."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(zlib.decompress(blob), np.uint32).astype(np.uint64)
        done = [(k, np.ceil(np.log2(v.astype(np.float64) + 1)).astype(np.uint8).tobytes()) for k, v in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.int32()), pa.array([v for _, v in done], pa.binary())], ["part", "levels"])

    found = rows.filter("part is not null").select("part", "counts").repartition(PARTS, "part").mapInArrow(run, "part int, levels binary")
    by = {r.part: bytes(r.levels) for r in found.collect()}
    return b"".join(by.get(k, bytes(BUCKETS // PARTS)) for k in range(PARTS))


def prefix(n: int, percent: int) -> tuple[int, int, int]:
    """(p, q, shared) of a set of n: it has a shingle of every partner among its first p, and at least ``shared`` among its first q.

    With L shingles more than needed to have one, two sets share the first L that they
    have in common; L grows with the size, so the smallest partner allowed counts.
    """

    def more(m: int) -> int:
        return min(1 + (m - -(-percent * m // 100) + 1) // 2, -(-percent * m // 100))

    p = n - -(-percent * n // 100) + 1
    return p, p + more(n) - 1, more(-(-percent * n // 100))


def _prefixes(docs: DataFrame, words: int, percent: int, levels, bitmap=None) -> DataFrame:
    """(key): the longer prefix of each set; with a bitmap of keys, (key, set, n, place) of those of the prefix that it may hold. A task emits a set once."""

    def run(batches):
        level = np.frombuffer(levels.value, np.uint8)
        held = None if bitmap is None else np.frombuffer(bitmap.value, np.uint8)
        seen: set[bytes] = set()
        for batch in batches:
            keys, names, sizes, places = [np.empty(0, np.int64)], [], [], []
            for s in shingle_sets(batch.column("text").to_pylist(), words):
                name = digest(s)
                if not len(s) or name in seen:
                    continue
                if len(seen) < 200_000:
                    seen.add(name)
                order = np.argsort(level[(s & np.uint64(BUCKETS - 1)).astype(np.int64)], kind="stable")
                p, q, shared = prefix(len(s), percent)
                own = s[order[:q]]
                if held is None:
                    keys.append(own.view(np.int64))
                    continue
                at = np.flatnonzero(is_in(held, own))
                if len(at) < shared:
                    continue
                at = at[at < p]
                keys.append(own[at].view(np.int64))
                names += [name] * len(at)
                sizes += [len(s)] * len(at)
                places += at.tolist()
            keys = pa.array(np.concatenate(keys))
            if held is None:
                yield pa.RecordBatch.from_arrays([keys], ["key"])
            else:
                yield pa.RecordBatch.from_arrays([keys, pa.array(names, pa.binary()), pa.array(sizes, pa.int64()), pa.array(places, pa.int32())], ["key", "set", "n", "place"])

    return docs.select("text").mapInArrow(run, "key long" if bitmap is None else "key long, set binary, n long, place int")


def _lists(docs: DataFrame, sets: DataFrame, words: int, percent: int, levels: bytes) -> DataFrame:
    """Prefix rows (key, set, n, place) whose shingle is in two sets or more, with the list's size m."""
    context = docs.sparkSession.sparkContext
    n = F.col("n")
    made = sets.filter("n > 0").agg(F.sum(1.5 * (n - F.ceil(percent * n / 100) + 1))).first()[0] or 0
    levels = context.broadcast(levels)
    repeated = _prefixes(docs, words, percent, levels).groupBy("key").agg(F.count("*").alias("m")).filter("m > 1").select("key")
    bitmap = context.broadcast(collect_bitmap(repeated, bits_for(int(made), 4)))
    rows = materialise(_prefixes(docs, words, percent, levels, bitmap).distinct(), "prefixes")
    lists = materialise(rows.join(rows.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"), "key"), "lists")
    release(rows)
    return lists


def _may_link(n, place, other_n, other_place, percent: int):
    """The sizes allow it, and so does what is left of both sets from a common shingle on."""
    need = F.ceil(percent * (n + other_n) / (100 + percent))
    return (100 * F.least(n, other_n) >= percent * F.greatest(n, other_n)) & (F.least(n - place, other_n - other_place) >= need)


def _first_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """All pairs of small lists that can still link, and every member of a larger list with the one drawn.

    Of a pair's common shingles up to the last one in small lists, ``c`` are known and
    at most as many as either has in larger lists are not; the rest of the overlap
    must come from behind it.
    """
    hidden = lists.filter(F.col("m") > SMALL).groupBy("set").agg(F.count("*").alias("hidden"))
    rows = lists.filter(F.col("m") <= SMALL).select("key", "set", "n", "place").join(hidden, "set", "left").fillna(0, ["hidden"])
    x, y = rows.alias("x"), rows.alias("y")
    sized = 100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")
    # what both can share before this shingle, and from it on
    room = F.least("x.place", "y.place") + F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    met = (
        x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.set") < F.col("y.set")) & sized & (room >= F.ceil(percent * (F.col("x.n") + F.col("y.n")) / (100 + percent))))
        .groupBy(F.col("x.set").alias("a"), F.col("y.set").alias("b"))
        .agg(
            F.count("*").alias("c"),
            F.min(F.least("x.hidden", "y.hidden")).alias("hidden"),
            F.min("x.n").alias("n"),
            F.min("y.n").alias("other_n"),
            F.max("x.place").alias("last"),
            F.max("y.place").alias("other_last"),
        )
    )
    behind = F.least(F.col("n") - 1 - F.col("last"), F.col("other_n") - 1 - F.col("other_last"))
    need = F.ceil(percent * (F.col("n") + F.col("other_n")) / (100 + percent))
    near = met.filter(F.col("c") + F.col("hidden") + behind >= need).select("a", "b")
    big = lists.filter(F.col("m") > SMALL)
    draw = F.min(F.struct(F.xxhash64("key", "set").alias("h"), F.col("set").alias("hub"), F.col("n").alias("hub_n"), F.col("place").alias("hub_place")))
    hubs = big.groupBy("key").agg(draw.alias("drawn")).select("key", "drawn.hub", "drawn.hub_n", "drawn.hub_place")
    drawn = big.join(hubs, "key").filter(F.col("set") != F.col("hub")).filter(_may_link(F.col("n"), F.col("place"), F.col("hub_n"), F.col("hub_place"), percent))
    return near.union(drawn.select(F.least("set", "hub"), F.greatest("set", "hub"))).distinct()


def _open_rows(big: DataFrame, parts: DataFrame) -> DataFrame:
    """The rows of larger lists that hold several components, with their component."""
    rows = big.join(parts, big["set"] == parts["node"], "left").select("key", "set", "n", "place", *PARITIES, F.coalesce("root", "set").alias("part"))
    several = rows.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low <> high").select("key")
    return materialise(rows.join(several, "key"), "open")


def _near_parities(x: str, y: str, percent: int):
    """The parities of both rows allow a link."""
    odd = reduce(lambda a, b: a + b, [F.bit_count(F.col(f"{x}.{q}").bitwiseXOR(F.col(f"{y}.{q}"))) for q in PARITIES])
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    return F.coalesce(odd <= n + m - 2 * F.ceil(percent * (n + m) / (100 + percent)), F.lit(True))


def _open_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """The pairs across components that the open lists still allow."""
    # a pair is made where it first meets, as far back as 16 lists tell
    rows = materialise(rows.withColumn("prior", F.collect_list("key").over(Window.partitionBy("set").orderBy("place").rowsBetween(-16, -1))), "open")
    x, y = rows.alias("x"), rows.alias("y")
    fits = (F.col("x.part") != F.col("y.part")) & _may_link(F.col("x.n"), F.col("x.place"), F.col("y.n"), F.col("y.place"), percent) & _near_parities("x", "y", percent) & ~F.arrays_overlap("x.prior", "y.prior")
    return x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.set") < F.col("y.set")) & fits).select(F.col("x.set").alias("a"), F.col("y.set").alias("b")).distinct()


def _sketched(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches allow the overlap that they need."""
    known = sets.filter("sketch is not null").select("set", "n", "sketch").dropDuplicates(["set"])

    def run(batches):
        for batch in batches:
            keep = []
            for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("a_n", "b_n", "a_sketch", "b_sketch")), strict=True):
                most = most_common(x, y)
                keep.append(most is None or most >= required(n, m, percent))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], ["a", "b"])

    both = pairs.join(known.toDF("a", "a_n", "a_sketch"), "a").join(known.toDF("b", "b_n", "b_sketch"), "b")
    return both.mapInArrow(run, "a binary, b binary")


def _hashes_of(docs: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """(set, hashes) of the sets in ``pairs``, from the texts. A bitmap of the sets says which texts' hashes are sent."""
    wanted = pairs.select(F.col("a").alias("set")).union(pairs.select("b")).distinct()
    bitmap = docs.sparkSession.sparkContext.broadcast(collect_bitmap(wanted, bits_for(wanted.count())))

    def run(batches):
        held, seen = np.frombuffer(bitmap.value, np.uint8), set()
        for batch in batches:
            sets = shingle_sets(batch.column("text").to_pylist(), words)
            names = pa.array(map(digest, sets), pa.binary())
            out = []
            for i in np.flatnonzero(is_in(held, numbers_of(names))).tolist() if sets else ():
                name = names[i].as_py()
                if len(sets[i]) and name not in seen:
                    out.append((name, sets[i].tobytes()))
                    if len(seen) < 200_000:
                        seen.add(name)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())], ["set", "hashes"])

    return docs.select("text").mapInArrow(run, "set binary, hashes binary").join(wanted, "set", "left_semi").dropDuplicates(["set"])


def _verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar enough, by one search for each query and at most ``CELL`` of its partners.

    A set without hashes would lose links in silence, so it fails the job.
    """
    hashes = materialise(_hashes_of(docs, pairs, words), "hashes")
    slot = F.row_number().over(Window.partitionBy("a").orderBy("b"))
    cells = pairs.withColumn("slot", slot - 1).withColumn("cell", F.floor(F.col("slot") / CELL).cast("int"))
    queries = cells.filter(F.col("slot") % CELL == 0).select("a", "cell", F.col("a").alias("set"))
    members = cells.select("a", "cell", F.col("b").alias("set")).union(queries)

    def run(batches):
        now, query, names, sets = None, None, [], []

        def finish():
            return [] if now is None else [(now[0], names[i]) for i in t_occurrence(query, sets, percent)]

        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())], ["u", "v"])

        for batch in batches:
            out = []
            for a, cell, name, data in zip(*(batch.column(c).to_pylist() for c in ("a", "cell", "set", "hashes")), strict=True):
                if (a, cell) != now:
                    out += finish()
                    now, query, names, sets = (a, cell), None, [], []
                if name == a:
                    query = np.frombuffer(data, np.uint64)
                else:
                    names.append(name)
                    sets.append(np.frombuffer(data, np.uint64))
            yield batch_of(out)
        yield batch_of(finish())

    found = F.coalesce("hashes", F.raise_error(F.lit("a set that was paired has no hashes: the texts have changed")).cast("binary"))
    joined = members.join(hashes, "set", "left").withColumn("hashes", found).repartition("a", "cell").sortWithinPartitions("a", "cell")
    links = materialise(joined.select("a", "cell", "set", "hashes").mapInArrow(run, "u binary, v binary"), "links")
    release(hashes)
    return links


def similar_components(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id), a row per row of ``docs``.

    Two documents link when 100 * intersection >= percent * union of their shingle
    sets; a component is closed under links, and its id is its smallest document id,
    nulls aside. Null and empty texts have no shingles and stand alone, each under its
    own id. Documents with null ids take part and link others, and get the smallest id
    of their component, null if it has none. Rows that repeat are linked with each
    other. Texts of any length are read whole; an empty table gives no rows. Other
    columns are not read. The id may be a struct, which orders by its fields.
    """
    if not 50 <= percent <= 100 or words < 1:
        raise ValueError("percent from 50 to 100, one word or more")
    base = bounded_batches(docs).select(F.col(id_col).alias("row"), F.col(text_col).alias("text"))
    first = materialise(_sets_and_counts(base, words), "sets")
    sets = first.filter("part is null")
    lists = _lists(base, sets, words, percent, _levels(first))
    pairs = materialise(_sketched(_first_pairs(lists, percent), sets, percent), "pairs")
    links = _verified(pairs, base, words, percent)
    parts = connected_components(links, "components")
    known = sets.filter("q0 is not null").select("set", *PARITIES).dropDuplicates(["set"])
    open_rows = _open_rows(lists.filter(F.col("m") > SMALL).join(known, "set"), parts)
    rest = materialise(_sketched(_open_pairs(open_rows, percent).join(pairs, ["a", "b"], "left_anti"), sets, percent), "pairs")
    release(lists, pairs, open_rows)
    if not rest.isEmpty():
        more = _verified(rest, base, words, percent)
        parts = connected_components(parts.select(F.col("node").alias("u"), F.col("root").alias("v")).union(more), "components")
    classes = sets.filter("n > 0").groupBy("set").agg(F.min("row").alias("rep"))
    named = classes.join(parts, classes["set"] == parts["node"], "left").select("set", "rep", F.coalesce("root", "set").alias("root"))
    table = named.join(named.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("set", "component_id")
    return sets.join(table, "set", "left").select(
        F.col("row").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("row")).otherwise(F.col("component_id")).alias("component_id")
    )
