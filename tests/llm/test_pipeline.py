"""The pipeline's stages and ``run`` against plain Python, and on odd rows."""

import corpus_pipeline as p
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import brute_components, packed_well, plain_line_dedup
from waymark.llm import quality

SMALL = "/root/testdata/sf0.001"
NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The small table with a line, a near copy and short lines planted, and its labels."""
    path = str(tmp_path_factory.mktemp("sf"))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = docs.collect()
    planted = [(9004, None, "en", "x", 0), (9005, "", "en", "x", 0)]
    for k, r in enumerate([r for r in rows if 80 <= len((r.text or "").split()) <= 400][:12]):
        words = r.text.split()
        for j, own in enumerate((["first", *words[1:]], [*words[:-1], "last"])):
            planted.append((9100 + 2 * k + j, "Menu\n" + " ".join(own) + "\nMenu", r.lang, "x", 1))
    docs.union(spark.createDataFrame(planted, docs.schema)).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{SMALL}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return path


def plain_scores(voters, texts):
    """Every cosine, one text at a time, and the vote of the nearest."""
    out = []
    for t in texts:
        cosine = (voters.project(quality.features([t])) @ voters.vectors.T)[0]
        near = np.argsort(-cosine, kind="stable")[: voters.neighbours]
        weight = np.exp(12 * (cosine[near].astype(float) - 1))
        out.append(float((weight * voters.labels[near]).sum() / weight.sum()))
    return out


def test_votes_are_those_of_all_pairs(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    voters = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    rows = docs.collect()
    got = {r.doc_id: r.score for r in quality.score_documents(docs, voters).collect()}
    assert all(abs(got[r.doc_id] - s) < 1e-4 for r, s in zip(rows, plain_scores(voters, [r.text for r in rows])))
    assert quality.nearest(np.array([[0.5, 0.9, 0.9, 0.9, 0.1]], np.float32), 2).tolist() == [[1, 2]]


def test_stages_and_run_against_plain_python(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    voters = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    rows = docs.collect()
    left = [(r.doc_id, r.text) for r, s in zip(rows, plain_scores(voters, [r.text for r in rows])) if s >= 0.3]
    stages = [left]
    cleaned = plain_line_dedup(left)
    left = [(i, t) for i, _ in left for t, n in [cleaned[i]] if n == 0 or t.strip(" \n\r\t")]
    stages.append(left)
    found = brute_components(left, 5, 80)
    left = [(i, t) for i, t in left if found[i][1] == i]
    stages.append(left)
    assert len(stages[0]) < len(rows) and len(stages[1]) < len(stages[0]) and len(stages[2]) < len(stages[1])
    now = docs
    for (name, stage), want in zip(p.STAGES, stages):
        now = stage(spark, now, folder).cache()
        assert now.columns == NAMES
        assert sorted(((r.doc_id, r.text) for r in now.collect()), key=str) == sorted(want, key=str), name
    packed = p.run(spark, folder).collect()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    order = {i: k for k, (i, _) in enumerate(left)}
    packed_well([(order[r.doc_id], *(r[c] for c in names[1:])) for r in packed], [t for _, t in left])
    for own in {r.sequence_id for r in packed}:
        lengths = [r.length for r in packed if r.sequence_id == own]
        assert len(lengths) <= 64 and (len(lengths) == 1 or sum(x * x for x in lengths) <= 1024 * 1024 * 15 // 16)


def test_stages_on_odd_rows(spark, folder):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base, "a"), (1, base, "a"), (None, base + " x", "b"), (None, "a text of its own, unlike the others", "c"), (2, base + " y", "d"), (3, None, "e"), (3, "", "f"), (4, "line " * 30_000, "g")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, row_key string").withColumns({"n_lines": F.lit(1), "_row": F.lit(2)})
    for name, stage in p.STAGES[1:3]:
        out = stage(spark, frame, folder)
        assert set(out.columns) >= {"doc_id", "text", "row_key", "_row"}, name
        assert stage(spark, frame.limit(0), folder).count() == 0
    kept = p.near_duplicate_filter(spark, frame, folder).collect()
    assert sorted((r.row_key for r in kept)) == ["a", "c", "e", "f", "g"]
    assert sorted({r.doc_id for r in p.packer(spark, frame, folder).collect()}, key=str) == [1, 2, 3, 4, None]
    assert p.quality_filter(spark, frame, folder).columns == frame.columns and p.packer(spark, frame.limit(0), folder).count() == 0
