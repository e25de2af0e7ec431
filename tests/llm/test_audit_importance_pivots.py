"""Filter audit, importance resampling and the pivot index against brute force, on edge cases and small tables."""

import hashlib
import math
import re
from collections import Counter
from itertools import pairwise, permutations
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.llm import filter_audit, importance, pivots, queries

SMALL = "/root/testdata/sf0.001"
ODD = [None, "", "", " \t", "Ab CD $", "word " * 250, "word " * 250, "long text é " * 40_000, "A B C", "same & same", "same & same", "x" * 30_000]


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty and very long texts, ties, repeated rows, rows without id or part, and columns with clashing names."""
    rows = [(i, t, ["web", None, ""][i % 3], "x", 1, i) for i, t in enumerate(ODD)] + [(10, "same & same", "web", "x", 1, 0), (None, "same & same", "web", "x", 1, 0), (None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, mask string, n long, score long")


@pytest.fixture(scope="module")
def marks(spark):
    return spark.createDataFrame([(0, 1, 0), (0, 0, 1), (4, 1, None), (10, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")


def audited(docs, labels):
    """Every document walked through every order."""
    first = {}
    for d in docs:
        if d.doc_id is not None:
            first[d.text or ""] = min(d.doc_id, first.get(d.text or "", d.doc_id))
    good = {r.doc_id for r in labels if r.quality == 1 and r.doc_id is not None}
    toxic = {r.doc_id for r in labels if r.toxic == 1 and r.doc_id is not None}
    out = {}
    for d in docs:
        text, part = d.text or "", d.source or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": d.doc_id is not None and d.doc_id > first[text],
        }
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for step, x in enumerate(order, 1):
                row = out.setdefault((part, order, step), Counter())
                row["removed"] += fails[x] and not gone
                row["redundant"] += fails[x] and gone
                row["unique_fails"] += fails[x] and sum(fails.values()) == 1
                row["good_lost"] += fails[x] and not gone and d.doc_id in good
                row["toxic_lost"] += fails[x] and not gone and d.doc_id in toxic
                gone = gone or fails[x]
                row["kept"] += not gone
    shapley = Counter()
    for (part, order, step), row in out.items():
        shapley[part, order[step - 1]] += row["removed"]
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return {(part, order, step, *(row[n] for n in names), shapley[part, order[step - 1]]) for (part, order, step), row in out.items()}


def rows_of(frame):
    return [(r.part, r.filter_order, r.step, r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in frame.collect()]


def test_audit_walks_every_order(spark, odd, marks):
    got = rows_of(filter_audit.audit(filter_audit.mask_counts(odd, marks)))
    assert len(got) == 2 * 600 and set(got) == audited(odd.collect(), marks.collect())
    assert filter_audit.audit(filter_audit.mask_counts(odd.limit(0), marks)).count() == 0
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    assert set(rows_of(queries.op12_filter_audit(spark, SMALL))) == audited(docs.collect(), labels.collect())


def test_intervals_hold_every_order_once():
    for mask in range(32):
        held = Counter((rank, step) for step, lo, hi in filter_audit.removal_intervals(mask) for rank in range(lo, hi))
        want = Counter()
        for rank, order in enumerate(permutations(range(5))):
            step = next((k for k, x in enumerate(order, 1) if mask >> x & 1), None)
            if step:
                want[rank, step] += 1
        assert held == want


def resampled(docs, target, percent=25, least=20):
    """Features by a pattern, sums in dictionaries, one sort."""

    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return [crc32(f.encode()) % 10000 for f in [*words, *map(" ".join, pairwise(words))]]

    own = [(d.doc_id, features(d.text)) for d in docs]
    s, t = Counter(b for _, f in own for b in f), Counter(b for r in target for b in features(r.text))
    all_s, all_t = s.total(), t.total()
    out = []
    for i, f in own:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    may = sorted((r for r in out if r[1] >= 2 * least - 1), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[2], r[1]))
    drawn = may[: percent * len(may) // 100]
    ranks = {id(r): k for k, r in enumerate(drawn, 1)}
    return Counter((*r, ranks.get(id(r))) for r in out)


def seen(frame):
    return Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in frame.collect())


def test_importance_against_one_sort(spark, odd, monkeypatch):
    docs, target = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    assert seen(queries.op13_importance_resampling(spark, SMALL)) == resampled(docs.collect(), target.collect())
    monkeypatch.setattr(importance, "SLICE", 700)
    for percent, least in ((25, 1), (60, 20), (100, 0), (1, 20)):
        assert seen(importance.resample(odd, target, percent, least)) == resampled(odd.collect(), target.collect(), percent, least)
    assert seen(importance.resample(odd, target.limit(0))) == resampled(odd.collect(), [])
    assert importance.resample(odd.limit(0), target).count() == 0


def test_bisection_inside_ties(spark):
    """Equal scores at the limit: ids are bisected, null ids come last, repeated ids share the limit."""
    rows = [(i % 40, 50, i // 40, 7) for i in range(80)] + [(None, 50, 1, 7), (100, 50, 9, 8), (-5, 50, 2, 6), (-(2**62), 50, 3, 7)]
    scored = spark.createDataFrame(rows, "doc_id long, n_features long, weight long, score long")
    for percent in (1, 2, 10, 47, 97, 99, 100):
        got = importance.draw(scored, F.col("n_features") > 0, percent).collect()
        want = sorted(rows, key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[2]))[: percent * len(rows) // 100]
        assert [tuple(r)[:4] for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == want and len(got) == len(rows)


def linked(vectors, least=0.9):
    """(n_links, component, links found) by all pairs, among valid vectors of one length."""
    ids, x = [i for i, v in vectors], [np.array(v, np.float64) if v and None not in v else np.zeros(1) for _, v in vectors]
    valid = [bool(len(v) and np.isfinite(v).all() and v.any()) for v in x]
    pairs = set()
    for size in {len(v) for v, ok in zip(x, valid) if ok}:
        at = [k for k, v in enumerate(x) if valid[k] and len(v) == size]
        m = np.array([x[k] / np.abs(x[k]).max() for k in at])
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        a, b = np.nonzero(np.triu(m @ m.T >= least, 1))
        pairs |= {(at[i], at[j]) for i, j in zip(a.tolist(), b.tolist())}
    root = list(range(len(x)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in pairs:
        root[find(a)] = find(b)
    links = Counter(k for p in pairs for k in p)
    members = {}
    for k in range(len(x)):
        members.setdefault(find(k), []).append(ids[k])
    return [(ids[k], links[k], min((i for i in members[find(k)] if i is not None), default=None) if valid[k] else ids[k]) for k in range(len(x))], pairs


def answers(frame):
    return Counter((r.vec_id, r.n_links, r.component_id) for r in frame.collect())


def near_copies(rng, centre, count, close):
    noise = rng.normal(size=(count, len(centre)))
    noise -= (noise @ centre)[:, None] * centre / (centre @ centre)
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    unit = centre / np.linalg.norm(centre)
    return close * unit + math.sqrt(1 - close * close) * noise


def test_pivots_on_odd_vectors(spark):
    bad = [None, [], [0.0, 0.0], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0]]
    rows = [(i, v) for i, v in enumerate(bad)] + [(20, [1.0, 0.0]), (10, [1.0, 0.0]), (10, [1.0, 0.0]), (11, [5e200, 1e199]), (12, [0.0, -1.0]), (13, [-0.0, -1.0]), (None, [1.0, 0.01]), (None, None), (30, [1.0, 0.0, 0.0]), (31, [2.0, 0.0, 0.0]), (32, [9.0])]
    frame = spark.createDataFrame([(*r, "c", 7) for r in rows], "vec_id long, embedding array<double>, class string, n int")
    want = Counter(x if x[2] is not None else (None, 0, None) for x in linked(rows)[0])
    got = pivots.near_duplicates(frame)
    assert answers(got) == want
    assert {(r.vec_id, r.kept) for r in got.collect() if r.vec_id in (10, 11, 20, 32)} == {(10, True), (11, False), (20, False), (32, True)}
    assert pivots.near_duplicates(frame.limit(0)).count() == 0


def test_pivot_recall_at_the_limit(spark):
    """Pairs planted just above the limit, chains of them, and pairs just below: recall of links 0.9 at least, no link below."""
    rng = np.random.default_rng(11)
    base = rng.normal(size=(3000, 64))
    rows = list(base)
    for k in range(400):
        rows += list(near_copies(rng, base[k], 1 + k % 3, (0.905, 0.93, 0.97, 0.89)[k % 4]))
    vectors = [(k, [float(x) for x in v]) for k, v in enumerate(rows)]
    got = pivots.near_duplicates(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect()
    want, pairs = linked(vectors)
    links = {i: n for i, n, _ in want}
    assert all(r.n_links <= links[r.vec_id] for r in got)
    assert sum(r.n_links for r in got) >= 0.97 * 2 * len(pairs)


def test_pivot_lists_may_be_parted_anywhere(spark, monkeypatch):
    """A third of all vectors in one group of near copies, and exact copies, with small lists and blocks."""
    rng = np.random.default_rng(4)
    rows = [*rng.normal(size=(200, 32)), *near_copies(rng, rng.normal(size=32), 150, 0.975), *[np.ones(32)] * 60]
    vectors = [(k * 3 % 410, [float(x) for x in v]) for k, v in enumerate(rows)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    want = Counter(linked(vectors)[0])
    assert answers(pivots.near_duplicates(frame)) == want
    monkeypatch.setattr(pivots, "LIST", 40)
    monkeypatch.setattr(pivots, "BLOCK", 40)
    assert answers(pivots.near_duplicates(frame)) == want
