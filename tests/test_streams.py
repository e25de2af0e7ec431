"""The two streams on files that arrive, bad ones among them, and on edits whose evaluation fails."""

from pyspark.sql import functions as F

from waymark.streaming import tracks as T

GPX = '<gpx version="1.1" creator="tester" xmlns="http://www.topografix.com/GPX/1/1"><trk><name>N</name><trkseg>{}</trkseg></trk></gpx>'


def points(n):
    return "".join(f'<trkpt lat="{47 + k / 1000}" lon="8.5"><ele>{400 + 3 * k}</ele><time>2024-05-01T10:{k:02d}:00Z</time></trkpt>' for k in range(n))


def test_files_arrive_and_bad_ones_are_put_aside(spark, tmp_path):
    source, out, bad, mark = (str(tmp_path / n) for n in ("in", "out", "bad", "mark"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.gpx").write_text(GPX.format(points(5)))
    (tmp_path / "in" / "b.gpx").write_text("<html>no track</html>")
    T.ingest_tracks_stream(spark, source, out, bad, mark).awaitTermination()
    (tmp_path / "in" / "c.gpx").write_text(GPX.format(points(1)))
    (tmp_path / "in" / "d.gpx").write_text(GPX.format(points(9)))
    T.ingest_tracks_stream(spark, source, out, bad, mark).awaitTermination()
    assert sorted(r.track_id[-5:] for r in spark.read.parquet(out).collect()) == ["a.gpx", "d.gpx"]
    assert sorted((r.file[-5:], r.reason) for r in spark.read.parquet(bad).collect()) == [("b.gpx", "not GPX"), ("c.gpx", "too few points")]


def test_files_of_a_batch_are_read_once(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    for k in range(4):
        (tmp_path / "in" / f"{k}.gpx").write_text(GPX.format(points(k)))
    read, parse = spark.sparkContext.accumulator(0), T.parse_gpx

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(T, "parse_gpx", lambda files: parse(files.mapInArrow(counted, files.schema)))
    T.ingest_tracks_stream(spark, *(str(tmp_path / n) for n in ("in", "out", "bad", "mark"))).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == spark.read.parquet(str(tmp_path / "bad")).count() == 2
    assert read.value == 4


def test_the_latest_edit_wins_and_failures_are_kept(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("edits", "out", "mark"))
    schema = "alignment_id long, seq long, metres double"

    def arrive(rows, evaluate):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        T.reevaluate_on_edit(spark.readStream.schema(schema).parquet(source), evaluate, out, mark).awaitTermination()

    def double(edits):
        return edits.filter("metres > 0").select("alignment_id", "seq", (2 * F.col("metres")).alias("twice"))

    def broken(edits):
        return edits.select("alignment_id", "seq", F.raise_error(F.lit("no terrain here")).cast("double").alias("twice"))

    arrive([(1, 1, 5.0), (1, 2, 7.0), (2, 3, -1.0)], double)
    arrive([(3, 4, 1.0)], broken)
    arrive([(2, 5, 4.0)], double)
    rows = {(r.alignment_id, r.seq): r for r in spark.read.option("mergeSchema", True).parquet(out).collect()}
    assert {k: r.status for k, r in rows.items()} == {(1, 2): "done", (2, 3): "failed", (3, 4): "failed", (2, 5): "done"}
    assert rows[1, 2].twice == 14 and rows[2, 3].error == "no result" and "no terrain here" in rows[3, 4].error
    now = {r.alignment_id: r.status for r in T.current_results(spark.read.option("mergeSchema", True).parquet(out)).collect()}
    assert now == {1: "done", 2: "done", 3: "failed"}


def test_one_bad_edit_does_not_fail_its_batch(spark, tmp_path):
    """Of forty alignments two can't be evaluated; the others are done, and a batch that runs again leaves no older part."""
    rows = [(k, 100 + k, float(k)) for k in range(40)]
    edits = spark.createDataFrame(rows, "alignment_id long, seq long, metres double")

    def picky(e):
        bad = F.col("alignment_id").isin(7, 23)
        return e.select("alignment_id", "seq", F.when(bad, F.raise_error(F.concat(F.lit("no terrain at "), F.col("alignment_id").cast("string"))).cast("double")).otherwise(2 * F.col("metres")).alias("twice"))

    T.half_by_half(edits, picky, str(tmp_path / "out"))
    got = {r.alignment_id: r for r in spark.read.option("mergeSchema", True).parquet(str(tmp_path / "out")).collect()}
    assert len(got) == 40 and {k for k, r in got.items() if r.status == "failed"} == {7, 23}
    assert got[9].twice == 18 and "no terrain at 7" in got[7].error and "no terrain at 23" in got[23].error


def test_errors_told_in_rows_take_no_halving(spark, tmp_path):
    edits = spark.createDataFrame([(k, 100 + k, float(k)) for k in range(40)], "alignment_id long, seq long, metres double")
    asked = []

    def picky(e):
        asked.append(1)
        bad = F.col("alignment_id") % 2 == 1
        return e.select("alignment_id", "seq", F.when(~bad, 2 * F.col("metres")).alias("twice"), F.when(bad, "no terrain").alias("error"))

    T.half_by_half(edits, picky, str(tmp_path / "out"))
    got = {r.alignment_id: r for r in spark.read.option("mergeSchema", True).parquet(str(tmp_path / "out")).collect()}
    assert len(asked) == 1 and {k for k, r in got.items() if r.status == "failed" and r.error == "no terrain"} == set(range(1, 40, 2))
    assert all(got[k].status == "done" and got[k].error is None and got[k].twice == 2 * k for k in range(0, 40, 2))
