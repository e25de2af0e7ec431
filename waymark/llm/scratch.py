"""Tables kept for the length of a job, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The folder of a local session without ``spark.checkpoint.dir``, made once.
_local: list[str] = []


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new path under ``spark.checkpoint.dir``.

    Where that setting is absent a temporary folder serves, in local mode only:
    on a cluster no executor would see it. The session's settings stay as they are.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _local:
            _local.append("file://" + tempfile.mkdtemp(prefix="spark-"))
        base = _local[0]
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back: lineage ends here and lost executors cost nothing."""
    path = scratch_dir(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more."""
    for table in tables:
        jvm, path = table.sparkSession._jvm, table.__dict__.get("_scratch")
        if path:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def bounded_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """``df``, with Arrow batches of its session held to ``rows`` rows from now on, so that long texts do not fill a task; the setting is read when a job runs, so it can't be put back here."""
    conf = df.sparkSession.conf
    now = int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if now <= 0 or now > rows:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    return df
