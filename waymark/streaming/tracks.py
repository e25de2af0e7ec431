"""Arriving GPX files and leg edits as streams; the batch functions do the work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rounds import removed, settled
from ..operators.tracks import track_summary
from ..sources.gpx import parse_gpx, split_gpx


def ingest_tracks_stream(spark: SparkSession, source: str, tracks: str, rejects: str, checkpoint: str):
    """Every new file in ``source`` becomes a summary row under ``tracks`` or a reason under ``rejects``; a batch that runs again replaces its own rows."""
    files = spark.readStream.format("text").option("wholetext", "true").load(source).select(F.col("_metadata.file_path").alias("file"), "value")

    def add(batch: DataFrame, n: int) -> None:
        parsed = parse_gpx(batch).persist()  # both tables come from one reading of the files
        try:
            points, bad = split_gpx(parsed)
            track_summary(points).write.mode("overwrite").parquet(f"{tracks}/batch={n}")
            bad.write.mode("overwrite").parquet(f"{rejects}/batch={n}")
        finally:
            parsed.unpersist()

    return files.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(add).start()


def latest_edits(edits: DataFrame, key: str = "alignment_id") -> DataFrame:
    """The edit with the highest ``seq`` of every alignment."""
    rest = [c for c in edits.columns if c != key]
    return edits.groupBy(key).agg(F.max_by(F.struct(*rest), "seq").alias("e")).select(key, "e.*")


def reevaluate_on_edit(edits: DataFrame, evaluate, results: str, checkpoint: str):
    """Evaluate the latest edit of every alignment in a batch; rows are keyed by (alignment_id, seq), so doing it twice changes nothing.

    ``evaluate`` maps edits to results with alignment_id and seq, and may have a text ``error``:
    rows with one are kept as "failed" and cost no more than others. Where it raises, the edits
    are halved by a hash of the alignment and each half is tried again, down to the edits
    that fail by themselves: those are kept as "failed" with the error, as are edits that
    it leaves out, and all others are done. A batch that runs again replaces its folder.
    """

    def apply(batch: DataFrame, n: int) -> None:
        path = f"{results}/batch={n}"
        removed(batch.sparkSession, path)
        half_by_half(settled(latest_edits(batch)), evaluate, path)

    return edits.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(apply).start()


def half_by_half(edits: DataFrame, evaluate, path: str, bits: str = "") -> None:
    """Write the results of ``edits`` under ``path``, a part for each share that ``evaluate`` could take; ``bits`` are the hash bits that the share's edits have in common."""
    kept, part = edits.select("alignment_id", "seq"), f"{path}/part={bits or 'all'}"
    failed = lambda rows, why: rows.withColumns({"status": F.lit("failed"), "error": F.lit(why[:500])})
    try:
        found = evaluate(edits)
        error = F.substring("error", 1, 500) if "error" in found.columns else F.lit(None).cast("string")
        done = settled(found.withColumns({"status": F.when(error.isNull(), "done").otherwise("failed"), "error": error}))
        missing = failed(kept.join(done.select("alignment_id", "seq"), ["alignment_id", "seq"], "left_anti"), "no result")
        done.unionByName(missing, allowMissingColumns=True).write.mode("overwrite").parquet(part)
    except Exception as e:  # the edit is not lost; a later one may mend it
        if len(bits) >= 60 or len(kept.take(2)) < 2:
            failed(kept, str(e)).write.mode("overwrite").parquet(part)
            return
        bit = F.shiftright(F.xxhash64("alignment_id"), len(bits)).bitwiseAND(1)
        for side in (0, 1):
            share = edits.filter(bit == side)
            if not share.isEmpty():
                half_by_half(share, evaluate, path, f"{bits}{side}")


def current_results(results: DataFrame, key: str = "alignment_id") -> DataFrame:
    return latest_edits(results, key)
