"""Operator 5: exact deduplication as a stream with disk-backed state.

Documents stream in; a stateful aggregation keyed by the SHA-256 of the normalised
text holds, without expiry and in RocksDB, the digest, how many rows have it, the
best row's length and stable identifier, and where its content lies (file and row).
Each micro-batch writes the keys it changed, so the state can be read as a table and
a stopped stream goes on where it was. Rows whose digest was seen before are hits:
their full bytes are compared with those of the row that the state points to, and a
row that differs forms a group of its own text.

Only DataFrame operations are used; rows of a key are reduced before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import materialise, scratch_dir

#: The white space that does not count: space and the range from tab to carriage return.
_BLANK = " \t\n\x0b\x0c\r"
_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each small store sets aside megabytes of disk
}


def normalised(text):
    """The text without ASCII white space; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    for c in _BLANK:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, digest, size, place): place is the file and the row in it, and tells equal rows apart."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return docs.select(F.col(id_col).alias("id"), place.alias("place"), F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest"), F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("size"))


def _best():
    """Longest first, then smallest id (nulls last), then place: as a struct whose minimum is the row to keep."""
    return F.min(F.struct((-F.col("size")).alias("size"), F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("place").alias("place")))


def stream_state(spark: SparkSession, path: str, schema, state_path: str, checkpoint: str, id_col: str = "doc_id", text_col: str = "text", pattern: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """Run the stream over all that is in ``path`` and return its state: (digest, copies, best).

    Call again with the same folders when files have been added: only those are read.
    """
    if not any(c in path for c in "*?[{"):
        path = f"{path[:-1]}[{path[-1]}]"  # as a pattern, one file will do as well as a folder
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    seen = _identified(reader.parquet(path), id_col, text_col).groupBy("digest").agg(F.count("*").alias("copies"), _best().alias("best"))
    before = {k: spark.conf.get(k, None) for k in _STORE}
    for k, v in _STORE.items():
        spark.conf.set(k, v)
    try:
        query = (
            seen.writeStream.outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .foreachBatch(lambda changed, n: changed.write.mode("overwrite").parquet(f"{state_path}/batch={n}"))
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    kind = schema[id_col].dataType.simpleString()
    changes = spark.read.schema(f"digest binary, copies long, best struct<size:long,no_id:boolean,id:{kind},place:struct<file:string,row:long>>, batch long").parquet(state_path)
    last = F.max_by(F.struct("copies", "best"), "batch")
    return changes.groupBy("digest").agg(last.alias("s")).select("digest", "s.copies", "s.best")


def exact_duplicates(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", pattern: str | None = None) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256), a row per row of the Parquet files in ``path``.

    Texts are equal when their code points without ASCII white space are; null counts
    as empty. The row with the most code points before that stays, then the one with
    the smallest id, null ids last, then the one that comes first in its file. So of
    rows that repeat an id and a text one is kept. Texts of any length are compared
    whole; an empty table gives no rows. Other columns are not read.
    """
    docs = spark.read.parquet(path) if pattern is None else spark.read.option("pathGlobFilter", pattern).parquet(path)
    schema = docs.select(id_col, text_col).schema
    state = stream_state(spark, path, schema, scratch_dir(spark, "state"), scratch_dir(spark, "stream"), id_col, text_col, pattern)
    state = materialise(state, "groups")
    rows = materialise(_identified(docs, id_col, text_col), "digests")
    table = rows.join(state, "digest")
    # hits: compare full bytes with the text that the state points to
    hit = table.filter("copies > 1").select("place", F.col("best.place").alias("at"))
    texts = docs.select(F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("place"), normalised(F.col(text_col)).alias("text"))
    keeper = state.filter("copies > 1").select(F.col("best.place").alias("at"))
    kept_text = texts.join(keeper, texts["place"] == keeper["at"], "left_semi").select(F.col("place").alias("at"), F.col("text").alias("kept_text"))
    other = hit.filter("place <> at").join(texts, "place").join(kept_text, "at").filter(F.col("text") != F.col("kept_text")).select("place", "text")
    other = materialise(other, "collisions")
    split = table.join(other, "place", "left")
    # a group is a digest, and the text where it is not the one kept under that digest; rows that differ are counted out of their digest's group
    own = split.filter("text is not null").groupBy("digest", "text").agg(F.count("*").alias("n"), _best().alias("own"))
    out_of = own.groupBy("digest").agg(F.sum("n").alias("gone"))
    joined = split.join(own, ["digest", "text"], "left").join(out_of, "digest", "left")
    apart = F.col("text").isNotNull()
    best = F.when(apart, F.col("own")).otherwise(F.col("best"))
    return joined.select(
        F.col("id").alias(id_col),
        best["id"].alias("keep_id"),
        F.when(apart, F.col("n")).otherwise(F.col("copies") - F.coalesce("gone", F.lit(0))).cast("long").alias("group_size"),
        (best["place"] == F.col("place")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
