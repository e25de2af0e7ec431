"""The ten operators against brute force, libraries and round trips, on edge cases and a small table."""

import hashlib
import math
import random
import re
import struct
import zipfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from waymark.llm import byte_bpe, exact_dedup, jaccard, line_dedup, packing, quality, queries, textarrays, token_counts, top_k, vocabulary, warc

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
SMALL = "/root/testdata/sf0.001"
CASES = [None, "", " ", "a", "It's  we'll\n\n they've 'tis ''s", "naïve 中文 １２   x", "<|endoftext|> a<|endoftext|>", "z" * 5000, " word" * 40000, "x'sabc 's\t'll", "same", "same"]


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty and very long texts, ties and repeated rows, and columns with clashing names."""
    rows = [(i, t, "row", i) for i, t in enumerate(CASES)] + [(11, "same", "row", 0), (None, "same", "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, n long")


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_token_counts(odd, none, docs):
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(odd, JSON).collect())
    texts = [r.text for r in odd.collect()]
    ids = [r.doc_id for r in odd.collect()]
    assert got == Counter((i, len((t or "").encode()), len(x), len(x) > 1024) for i, t, x in zip(ids, texts, library(texts)))
    assert token_counts.count_tokens(none, JSON).count() == 0
    rows = docs.collect()
    want = {r.doc_id: len(x) for r, x in zip(rows, library([r.text for r in rows]))}
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, JSON).collect()} == want


def test_chunk_maps_compose_at_any_cut():
    random.seed(5)
    text = "".join(random.choice(["a", "'s", " ", "  ", "\n", "12", "!", "é", "<|endoftext|>" * 0, "word"]) for _ in range(4000)) + "q" * 500
    own = token_counts.counter(JSON)
    texts = [text, "中文" * 700 + "，" + "字" * 300, "QUJD12zz+/x9" * 200, "can't " * 300 + "'" * 50 + "s'll" * 40, "a<|endoftext|>" * 90, "x" * 3000, "9" * 500 + "'s" * 100]
    for t, ids in zip(texts, library(texts)):
        for size in (3, 17, 64, 1000):
            assert token_counts.total(token_counts.block_maps([(t, True, True)], own, size)[0], own.counts) == len(ids), (t[:20], size)


def test_long_texts_are_counted_by_blocks(spark):
    rows = [(1, "word, and more words 123 " * 90_000), (1, "QUJD12zz+/x9" * 100_000), (None, "z" * 100_000), (2, "short"), (3, None)]
    assert max(len(t or "") for _, t in rows) > 2 * token_counts.BLOCK_CHARS
    got = sorted(((r.doc_id, r.n_tokens) for r in token_counts.count_tokens(spark.createDataFrame(rows, "doc_id int, text string"), JSON).collect()), key=str)
    assert got == sorted(((i, len(x)) for (i, _), x in zip(rows, library([t for _, t in rows]))), key=str)


def test_byte_bpe_against_tiktoken(odd, none):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks_of(RANKS), special_tokens={})
    rows = byte_bpe.encode_texts(odd.filter("doc_id is not null"), RANKS, with_digests=True).collect()
    for r in rows:
        text = (CASES[r.doc_id] or "") if r.doc_id < len(CASES) else "same"
        ids = own.encode_ordinary(text)
        assert r.ids == ids and bytes(r.decoded) == text.encode()
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert byte_bpe.encode_texts(none, RANKS).count() == 0
    decoded = byte_bpe.decode_ids(byte_bpe.encode_texts(odd, RANKS), RANKS)
    assert decoded.count() == odd.count()


def test_perfect_hash_is_minimal():
    keys = [b"k%d" % i for i in range(2000)]
    h = byte_bpe.PerfectHash(keys)
    assert sorted(h.find(k) for k in keys) == list(range(2000)) and h.find(b"other") == -1


def packed_well(rows, texts, size=1024):
    """Lossless, gapless, within capacity."""
    want = library(texts)
    pieces = defaultdict(list)
    for r in rows:
        pieces[r[0]].append(r[1:])
    bins = defaultdict(list)
    for i, (text, ids) in enumerate(zip(texts, want)):
        ids = ids + [2]
        for piece, start, length, crc, seq, offset in pieces[i]:
            assert crc == zlib.crc32(struct.pack(f"<{length}I", *ids[start : start + length]))
            bins[seq].append((offset, length))
        assert sum(p[2] for p in pieces[i]) == len(ids)
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    return len(bins)


def test_packing(spark, odd, none, docs):
    rows = [r.text for r in docs.orderBy("doc_id").collect()]
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    v = packing.vector_pack(frame, JSON)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    n = packed_well([tuple(r[c] for c in names) for r in v.collect()], rows)
    total = sum(len(x) + 1 for x in library(rows))
    assert n <= total / 1024 * 1.02 + 1
    m = packing.unpack_matrices(packing.pack_matrices(frame, JSON)).withColumnRenamed("id", "doc_id")
    assert packed_well([tuple(r[c] for c in names) for r in m.collect()], rows) <= total / 1024 * 1.02 + 1
    for f in (packing.vector_pack, packing.pack_matrices):
        assert f(none, JSON).count() == 0
    pieces = {"vector": packing.vector_pack(odd, JSON), "matrices": packing.unpack_matrices(packing.pack_matrices(odd, JSON)).withColumnRenamed("id", "doc_id")}
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    want = Counter((i, k, start, length, zlib.crc32(struct.pack(f"<{length}I", *ids[start : start + length]))) for (i, _), x in zip(texts, library([t for _, t in texts])) for ids in [[*x, 2]] for k, (start, length) in enumerate(packing.cut_points(len(ids), 1024)))
    for found in pieces.values():
        rows = found.collect()
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
        bins = defaultdict(list)
        for r in rows:
            bins[r.sequence_id].append((r.offset, r.length))
        for own in bins.values():
            ends = [0, *np.cumsum([n for _, n in sorted(own)]).tolist()]
            assert [a for a, _ in sorted(own)] == ends[:-1] and ends[-1] <= 1024


def test_long_documents_make_more_groups(spark):
    few = spark.createDataFrame([(k, "word " * 40_000) for k in range(6)] + [(9, None)], "doc_id int, text string")
    assert packing.group_count(few, group_pieces=100) == 3 and packing.group_count(few.limit(0)) == 1


def test_vector_best_fit_holds_every_capacity():
    rng = np.random.default_rng(3)
    needs = np.column_stack([rng.integers(1, 60, 300), np.ones(300), rng.integers(1, 900, 300)]).astype(float)
    for rule in ("residual", "dot"):
        bins, places = packing.vector_best_fit(needs, (100, 4, 1500), (1, 1, 1), rule)
        for b in set(bins.tolist()):
            own = needs[bins == b]
            assert (own.sum(0) <= (100, 4, 1500)).all() and sorted(places[bins == b]) == list(range(len(own)))


def test_capacity_tree_finds_the_tightest():
    tree = packing.CapacityTree(16)
    for i, c in enumerate((3, 9, 5, 16)):
        tree.add(c, i)
    assert [tree.take(n) for n in (4, 4, 10, 4, 1)] == [(5, 2), (9, 1), (16, 3), None, (3, 0)]


def brute_components(rows, k, percent):
    words = re.compile(r"[^\x20\x09-\x0D]+")
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    sets = []
    for _, t in rows:
        w = words.findall((t or "").translate(low))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    seen = defaultdict(list)
    for i, s in enumerate(sets):
        common = Counter(j for g in s for j in seen[g])
        for g in s:
            seen[g].append(i)
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)), key=lambda x: rows[x][0])
                root[b] = a
    return {r[0]: (len(s), rows[find(i)][0]) for i, (r, s) in enumerate(zip(rows, sets))}


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_jaccard_components(spark, docs, odd, k, percent):
    rng = random.Random(1)
    rows = [(r.doc_id, r.text) for r in docs.limit(60).collect()] + [(900 + i, t) for i, t in enumerate(CASES[:9])]
    base = [f"w{i}" for i in range(60)]
    for i in range(40):  # a large group of near copies
        own = list(base)
        own[rng.randrange(60)] = f"u{i}"
        rows.append((1000 + i, " ".join(own)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_components(frame, k, percent).collect()}
    assert got == brute_components(rows, k, percent)


def test_jaccard_odd_rows(odd, none):
    assert jaccard.similar_components(none).count() == 0
    rows = jaccard.similar_components(odd).collect()
    assert len(rows) == odd.count()
    assert {r.component_id for r in rows if r.doc_id in (10, 11, None)} == {10}


def test_t_occurrence_matches_set_intersection():
    rng = np.random.default_rng(0)
    query = np.unique(rng.integers(0, 400, 200).astype(np.uint64))
    sets = [np.unique(np.concatenate([rng.choice(query, len(query) - d), rng.integers(500, 600, d).astype(np.uint64)])) for d in range(0, 60)] + [query, np.empty(0, np.uint64)]
    for percent in (60, 80, 90):
        want = [i for i, s in enumerate(sets) if len(s) and 100 * len(np.intersect1d(query, s)) >= percent * len(np.union1d(query, s))]
        assert sorted(jaccard.t_occurrence(query, sets, percent)) == want


def test_exact_dedup(spark, tmp_path, odd):
    path = str(tmp_path / "documents.parquet")
    odd.select("doc_id", "text", "id").repartition(3).write.parquet(path)
    rows = exact_dedup.exact_duplicates(spark, path).collect()
    assert len(rows) == odd.count() and sum(r.kept for r in rows) == len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for t in CASES})
    same = [r for r in rows if r.keep_id == 10]
    assert len(same) == 4 and all(r.group_size == 4 for r in same) and sum(r.kept for r in same) == 1
    assert {r.doc_id: r.keep_id for r in rows}[0] == 2  # null, empty and one space: the longest stays


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def test_line_dedup(spark, odd, none):
    line = "the quick brown fox jumps over it"
    texts = [f"{line}\nshort\n{line}", line.replace("quick", "quack") + "\nshort", line[:-1], "x" + line, line.replace("fox", "cat"), "", None]
    rows = list(enumerate(texts))
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    seen, want = [], {}
    for i, t in rows:
        keep = []
        for x in (t or "").split("\n"):
            drop = len(x) >= 20 and any(within_one(x, y) for y in seen)
            seen += [x] * (len(x) >= 20)
            keep += [x] * (not drop)
        want[i] = None if t is None else "\n".join(keep)
    assert got == want
    assert line_dedup.dedup_lines(none).count() == 0 and line_dedup.dedup_lines(odd).count() == odd.count()


def plain_line_dedup(rows, min_chars=20, exact_chars=1):
    """(id, text, removed) by the rule as it is stated, with all earlier long lines in buckets by their first and last halves."""
    seen, shorts, out = defaultdict(set), set(), {}
    for i, t in sorted(rows):
        keep = []
        for x in (t or "").split("\n"):
            if len(x) >= min_chars:
                near = {y for k in (len(x) - 1, len(x)) for p in ((0, x[: k // 2]), (1, x[len(x) - k // 2 :])) for y in seen[(k, *p)]}
                near |= {y for p in ((0, x[: len(x) // 2]), (1, x[len(x) - len(x) // 2 :])) for y in seen[(len(x), *p)]}
                drop = any(within_one(x, y) for y in near)
                for k in (len(x) - 1, len(x)):
                    for p in ((0, x[: k // 2]), (1, x[len(x) - k // 2 :])):
                        seen[(k, *p)].add(x)
            else:
                drop = len(x) >= exact_chars and x.strip(" \t\x0b\x0c\r") != "" and x in shorts
                shorts.add(x)
            keep += [x] * (not drop)
        out[i] = (None if t is None else "\n".join(keep), len((t or "").split("\n")) - len(keep))
    return out


def test_line_dedup_on_the_table(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup_lines(docs, exact_chars=1).collect()}
    assert got == plain_line_dedup(rows) and sum(n for _, n in got.values())


def test_line_dedup_names_and_rows_without_ids(spark):
    line = "a line that is long enough to count"
    rows = [(None, line, 1, 2, 3), (None, "x" + line, 1, 2, 3), (4, line[1:] + "\nother text of its own here", 1, 2, 3), (4, line, 1, 2, 3), (5, line + "s", 1, 2, 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _row int, row int, gone int")
    got = line_dedup.dedup_lines(frame).collect()
    assert sorted((r.text, r.n_removed) for r in got) == sorted([(line, 0), ("x" + line, 0), ("other text of its own here", 1), ("", 1), ("", 1)])
    assert got[0]._row == 1 and got[0].gone == 3


def test_short_lines_repeat_exactly(spark):
    line = "the quick brown fox jumps over it"
    texts = [f"Menu\n{line}\n\nMenu\n  ", f"Menv\n  \n{line[:-1]}\n\nMenu", None, f"{line[:19]}\n{line[:20]}\na\nMenv", "a\n\ta\n\t\n\t\n\u00e9\n\u00e9"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup_lines(rows, exact_chars=1).collect()}
    assert got == {0: (f"Menu\n{line}\n\n  ", 1), 1: ("Menv\n  \n", 2), 2: (None, 0), 3: (f"{line[:19]}\n{line[:20]}\na", 1), 4: ("\ta\n\t\n\t\n\u00e9", 2)}


def test_op6_removes_every_exact_repeat(spark):
    folder = "/root/testdata/sf0.001"
    seen, least = set(), {}
    for r in spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect():
        least[r.doc_id] = 0
        for x in (r.text or "").split("\n"):
            least[r.doc_id] += x in seen and x.strip() != ""
            seen.add(x)
    got = {r.doc_id: r.n_removed for r in queries.QUERIES["op6_line_dedup"](spark, folder).collect()}
    assert sum(least.values()) and all(got[k] >= n for k, n in least.items())


def test_quality(spark, docs, odd, none):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    voters = quality.train(big, labels)
    scored = quality.score_documents(big, voters).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in scored) >= 0.95 * len(scored) > 0
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scored)
    rows = quality.score_documents(odd, voters).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.score_documents(none, voters).count() == 0 and quality.train(big, labels.limit(0)).neighbours == 1


def test_top_k(spark):
    rng = random.Random(2)
    rows = [(i, [round(rng.uniform(-1, 1), 3) for _ in range(4)]) for i in range(60)] + [(60, None), (80, [1.0, None, 0.0, 0.0]), (81, [float("nan")] * 4), (100, [0.5, 0.5, 0.5, 0.5])]
    got = top_k.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, 5).collect()
    whole = {i: [int(np.floor(64 * np.float64(np.float32(x)))) for x in v] for i, v in rows if v and None not in v and v[0] == v[0]}
    want = set()
    for q in (0, 20, 40, 100):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:5]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == want


def test_top_k_ties_widths_sparse_and_empty(spark):
    rng = random.Random(9)
    sparse = [(i, [rng.choice((0.0, 0.0, 0.0, 0.0, 1.0, -0.5)) for _ in range(12)], "x") for i in range(300)]
    rows = sparse + [(1000 + i, [float(i % 2)] * 3, "y") for i in range(30)] + [(20, [0.25] * 12, "again"), (None, [0.0] * 12, "z"), (2000, [1e7] * 2, "w"), (2001, [-1e7, 5.0], "w")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, ids string")
    got = defaultdict(list)
    for r in top_k.exact_top_k(frame, F.col("vec_id") % 20 == 0, 7).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    whole = [(i, [math.floor(64 * x) for x in v]) for i, v, _ in rows if i is not None]
    for q in {i for i, _ in whole if i % 20 == 0}:
        mine = [v for i, v in whole if i == q]
        best = sorted((-sum(a * b for a, b in zip(m, v)), i) for m in mine for i, v in whole if i != q and len(v) == len(m))[:7]
        assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)], q
    assert top_k.exact_top_k(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_warc_round_trip(spark):
    rows = [(1, "http://a", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u v", None), (4, "b", ""), (5, "c", "é" * 3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.id: r for r in warc.archive_pages(spark, pages).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None)}
    for i, _, html in rows:
        data = (html or "").encode()
        assert got[i].payload_bytes == len(data) and got[i].payload_digest == warc.base32_sha1(data)
        assert got[i].url == rows[i - 1][1]
    assert warc.archive_pages(spark, pages.limit(0)).count() == 0


def test_warc_repeated_rows_and_other_ids(spark):
    rows = [("7", "a  b", "x", 1), ("7", "a  b", "x", 2), ("7", "c", "y", 3), (None, None, "x", 4), ("ü:<1>", "d", "y", 5), (None, "e", "z", 6), (None, "e", "z", 7), ("8", "f", "long " * 400_000, 8)]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string, n int").withColumn("key", F.lit("k"))
    got = sorted(((r.id, r.url, r.record_type, r.refers_to, r.payload_bytes) for r in warc.archive_pages(spark, pages).collect()), key=str)
    want = [("7", "a  b", "response", None, 1), ("7", "a  b", "revisit", "7", 1), ("7", "c", "revisit", "ü:<1>", 1), (None, None, "revisit", "7", 1), ("ü:<1>", "d", "response", None, 1)]
    want += [(None, "e", "response", None, 1), (None, "e", "revisit", None, 1), ("8", "f", "response", None, 2_000_000)]
    assert got == sorted(want, key=str)
    least = {r.url: r.record_type for r in warc.archive_pages(spark, pages.filter("page_id is not null").dropDuplicates(["url"]), least=2).collect()}
    assert set(least.values()) == {"response"}


def test_warc_query_on_the_table(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    groups = defaultdict(list)
    for r in pages:
        groups[(r.html or "").encode()].append(r.page_id)
    want = set()
    for data, ids in groups.items():
        for i in ids:
            want.add((i, len(data), warc.base32_sha1(data), "response" if i == max(ids) else "revisit", None if i == max(ids) else max(ids)))
    got = queries.QUERIES["op10_warc"](spark, SMALL).collect()
    assert len(got) == len(pages) and {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == want


def test_zip64_directory(tmp_path, monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        for name in ("one", "two"):
            z.writestr(name, name * 50)
        z.comment = b"PK\x05\x06 not the end"
    package = warc.Package(f"file://{path}")
    assert package.read(*package.range_of("two")) == b"two" * 50 and b"".join(package.lines("one", 7)) == b"one" * 50


def test_jaccard_rows_without_ids_bridge(spark):
    words = [f"w{i}" for i in range(40)]
    a, b = list(words), list(words)
    a[0], b[39] = "first", "last"
    rows = [(1, " ".join(a)), (None, " ".join(words)), (2, " ".join(b)), (None, "alone it stands here today")]
    for percent in (80, 60):
        got = [(r.doc_id, r.component_id) for r in jaccard.similar_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, percent).collect()]
        assert sorted(got, key=str) == [(1, 1), (2, 1), (None, 1), (None, None)]


def test_jaccard_prefixes_share_enough():
    """Any two sets that reach the threshold share the promised number of shingles in their longer prefixes, in any common order."""
    rng = random.Random(4)
    for percent in (50, 80, 90, 100):
        for _ in range(300):
            n = rng.randrange(1, 80)
            a = set(rng.sample(range(200), n))
            b = set(a)
            for _ in range(rng.randrange(0, 12)):
                b.discard(rng.choice(sorted(b))) if rng.random() < 0.5 and len(b) > 1 else b.add(rng.randrange(200, 400))
            if 100 * len(a & b) < percent * len(a | b):
                continue
            order = {x: rng.random() for x in a | b}
            (p, q, need), (p2, q2, need2) = jaccard.prefix(len(a), percent), jaccard.prefix(len(b), percent)
            x, y = sorted(a, key=order.get), sorted(b, key=order.get)
            assert len(set(x[:q]) & set(y[:q2])) >= max(need, need2) and set(x[:p]) & set(y[:p2])


def test_parities_bound_the_difference():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64)) for n in (0, 3, 40, 41)]
    sets.append(np.unique(np.concatenate([sets[2][5:], sets[1]])))
    odd = jaccard.parities(sets).view(np.uint64)
    for i, a in enumerate(sets):
        for k, b in enumerate(sets):
            assert sum(int(x).bit_count() for x in odd[i] ^ odd[k]) <= len(np.setxor1d(a, b))


def test_sketches_bound_the_overlap():
    rng = np.random.default_rng(2)
    for n, m, common in ((10, 900, 7), (300, 350, 250), (5000, 300, 0), (40, 40, 40)):
        base = rng.integers(0, 1 << 63, n + m - common, dtype=np.uint64)
        a, b = base[:n], base[n - common :]
        assert jaccard.most_common(jaccard.sketch(a), jaccard.sketch(b)) >= common
    assert jaccard.sketch(np.full(300, 5, np.uint64)) == b"" and jaccard.most_common(b"", b"\x01" * 16) is None


def thue_morse(n, letters="ab"):
    word = [0]
    while len(word) < n:
        word += [1 - x for x in word]
    return "".join(letters[x] for x in word[:n])


def test_strings_that_defeat_a_hash_modulo_a_power_of_two(spark):
    """A long line and its complement collide under every odd base modulo 2**64; neither operator may take them for one."""
    for size in (1024, 2048, 4096):
        a, b = thue_morse(size), thue_morse(size, "ba")
        rows = [(1, a), (2, b), (3, a), (4, a[:-1]), (5, b[1:])]
        frame = spark.createDataFrame(rows, "doc_id long, text string")
        left = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame, exact_chars=1).collect()}
        assert left == {1: a, 2: b, 3: "", 4: "", 5: ""}
        words = spark.createDataFrame([(1, f"x {a} y"), (2, f"x {b} y"), (3, f"X {a} Y"), (4, a), (5, b)], "doc_id long, text string")
        assert {r.doc_id: r.component_id for r in jaccard.similar_components(words, words=3, percent=90).collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


def test_rolling_hashes_follow_the_characters():
    rng = random.Random(2)
    text = "".join(rng.choice("ab") for _ in range(3000)) + "é中😀" * 20
    codes = textarrays.codes_of(text)
    spans = [(i, j) for i in rng.sample(range(3000), 60) for j in (i, i + 1, i + 2, i + 9)]
    got = textarrays.Rolling(codes).spans(*np.array(spans).T)
    by = defaultdict(set)
    for (i, j), h in zip(spans, got.tolist()):
        by[text[i:j]].add(h)
    assert all(len(x) == 1 for x in by.values()) and len({h for x in by.values() for h in x}) == len(by)
    small = codes[-70:]
    without = textarrays.Rolling(small).without_one().tolist()
    assert without == [int(textarrays.Rolling(np.delete(small, k)).spans(np.array([0]), np.array([69]))[0]) for k in range(70)]


def test_exact_dedup_of_an_empty_table(spark, none, tmp_path):
    none.write.parquet(str(tmp_path / "none"))
    out = exact_dedup.exact_duplicates(spark, str(tmp_path / "none"))
    assert out.count() == 0 and set(out.columns) >= {"doc_id", "keep_id", "group_size", "kept", "text_sha256"}


def test_bytes_of_a_row_without_an_id(odd):
    got = byte_bpe.encode_texts(odd.filter("doc_id is null"), RANKS, with_digests=True).collect()
    assert [(r.doc_id, bytes(r.decoded), r.decoded_sha256) for r in got] == [(None, b"same", hashlib.sha256(b"same").hexdigest())]
