"""A training corpus from raw documents: quality filter, line dedup, near-duplicate removal, packing.

Each stage gets what the one before kept, with the columns of ``documents``; the
last returns packed pieces. ``run`` writes every stage's result to the shared folder
and reads it again, so a lost executor repeats one stage's tasks at most.

Null and empty texts are scored, hold no line that could repeat and are near to nothing;
they stay if the classifier keeps them, each packed as one end id. Rows that repeat an id
and a text are copies: their lines stay (they are one document's), and of the rows one
is kept. Null ids come last where the smallest id stays. An empty table gives no pieces.
Columns of ``docs`` other than doc_id, text and n_chars pass unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import jaccard, line_dedup, packing, quality
from waymark.llm.scratch import materialise
from waymark.llm.vocabulary import default_path


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; all others stay as they are."""
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go (within one edit from 20 characters on, exactly below), and documents of which nothing else is left; ``n_chars`` follows the text."""
    plain = docs.drop("n_lines", "n_removed") if {"n_lines", "n_removed"} & set(docs.columns) else docs
    out = line_dedup.dedup_lines(plain, exact_chars=1)
    out = out.filter((F.col("n_removed") == 0) | (F.length(F.trim(F.translate("text", "\n\r\t", "   "))) > 0))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(plain.columns)


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by sets of five-word shingles that are 0.8 alike or more, the one with the smallest id stays, and of rows that repeat its id and text one.

    Rows are told apart by a key of id and text, which orders by id, nulls last.
    """
    key = "row_key"
    while key in docs.columns:
        key = f"_{key}"
    keyed = docs.withColumn(key, F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text")))
    found = jaccard.similar_components(keyed, words=5, percent=80, id_col=key).groupBy(key).agg(F.count("*").alias("n"), F.first("component_id").alias("first"))
    marked = materialise(found.filter((F.col("n") > 1) | (F.col("first") != F.col(key))).select(key, (F.col("first") == F.col(key)).alias("stays")), "marked")
    alone = keyed.join(marked, key, "left_anti")
    repeats = marked.filter("stays").select(key)
    if not repeats.isEmpty():
        alone = alone.unionByName(keyed.join(repeats, key).select(keyed.columns).dropDuplicates([key]))
    return alone.select(docs.columns)


def packer(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens, in sequences of at most 64 pieces and 15/16 of the attention cost of a full piece, by vector best fit."""
    return packing.vector_pack(docs, default_path("byte_bpe_50k.json"), max_docs=64, max_attention=1024 * 1024 * 15 // 16)


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", line_filter),
    ("n-gram Jaccard join", near_duplicate_filter),
    ("best-fit packing", packer),
]

#: The classifier and the tokenizer can't be said in SQL; tests/llm/test_pipeline.py holds every stage and ``run`` against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
