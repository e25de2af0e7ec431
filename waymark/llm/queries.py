"""The queries of the thirteen operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, exact_dedup, filter_audit, importance, jaccard, line_dedup, packing, pivots, quality, token_counts, top_k, warc
from .scratch import materialise
from .vocabulary import default_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), default_path("byte_bpe_50k.json"))


def op2_packed_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per piece, read back from the written matrices."""
    packed = packing.pack_matrices(_table(spark, sf_dir, "documents"), default_path("byte_bpe_50k.json"))
    return packing.unpack_matrices(materialise(packed, "matrices")).withColumnRenamed("id", "doc_id")


def op3_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.vector_pack(_table(spark, sf_dir, "documents"), default_path("byte_bpe_50k.json"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard.similar_components(_table(spark, sf_dir, "documents"), words=3, percent=90)
    return out.select("doc_id", "n_shingles", "component_id")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(spark, f"{sf_dir}/documents.parquet")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: lines, lines removed, and the digest of what is left."""
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), exact_chars=1)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_of(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.exact_top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_texts(_table(spark, sf_dir, "documents"), default_path("byte_bpe_50k.tiktoken"), with_ids=False, with_digests=True)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archive_pages(spark, _table(spark, sf_dir, "pages"))
    return out.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_pivot_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(materialise(filter_audit.mask_counts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")), "masks"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_packed_matrices,
        op3_vector_packing,
        op4_ngram_jaccard,
        op5_exact_dedup,
        op6_line_dedup,
        op7_quality_classifier,
        op8_exact_top_k,
        op9_byte_bpe,
        op10_warc,
        op11_pivot_near_duplicates,
        op12_filter_audit,
        op13_importance_resampling,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op4_ngram_jaccard": r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
shingles as (
  select doc_id, unnest(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from words),
sets as (select distinct doc_id, s from shingles),
sizes as (select doc_id, count(*) as n from sets group by doc_id),
pairs as (select a.doc_id as x, b.doc_id as y, count(*) as common from sets a join sets b on a.s = b.s and a.doc_id < b.doc_id group by all),
links as (select x, y from pairs join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * common >= 90 * (p.n + q.n - common)),
ways as (select x as a, y as b from links union all select y, x from links),
reach(a, b) as (select a, a from ways union select r.a, w.b from reach r join ways w on r.b = w.a),
least as (select a, min(b) as component_id from reach group by a),
degree as (select a, count(*) as n from ways group by a)
select w.doc_id, coalesce(s.n, 0) as n_shingles, coalesce(l.component_id, w.doc_id) as component_id
from words w left join sizes s using (doc_id) left join least l on l.a = w.doc_id""",
    "op5_exact_dedup": r"""
with t as (select doc_id, length(coalesce(text, '')) as size, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256 from documents),
r as (select *, first_value(doc_id) over (partition by text_sha256 order by size desc, doc_id) as keep_id, count(*) over (partition by text_sha256) as group_size from t)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from r""",
    "op8_exact_top_k": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as e from embeddings),
p as (select a.vec_id as query_id, b.vec_id, cast(list_inner_product(a.e, b.e) as bigint) as score from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from p)
select query_id, rank, vec_id, score from r where rank <= 20""",
    "op12_filter_audit": r"""
with t as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
e as (select text, min(doc_id) as first from t group by text),
f as (select part, coalesce(quality = 1, false) as good, coalesce(toxic = 1, false) as toxic,
  (case when len(w) < 200 then 'A' else '' end) || (case when 100 * len(list_distinct(w)) < 50 * len(w) then 'B' else '' end)
  || (case when 100 * length(regexp_replace(t.text, '[^A-Z]', '', 'g')) > 2 * length(t.text) then 'C' else '' end)
  || (case when regexp_matches(t.text, '[#$%&*|]') then 'D' else '' end) || (case when doc_id > e.first then 'E' else '' end) as fails
  from t join e on e.text = t.text left join labels using (doc_id)),
m as (select part, fails, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from f group by all),
l as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
o as (select a.x || b.x || c.x || d.x || e.x as filter_order from l a, l b, l c, l d, l e where a.x not in (b.x, c.x, d.x, e.x) and b.x not in (c.x, d.x, e.x) and c.x not in (d.x, e.x) and d.x <> e.x),
s as (select filter_order, step, filter_order[step] as x, filter_order[1:step - 1] as before from o, (select cast(unnest(range(1, 6)) as int) as step)),
r as (select part, filter_order, step, s.x,
  sum(n) filter (len(fails) = 0 or not regexp_matches(fails, '[' || before || s.x || ']')) as kept,
  sum(n) filter (contains(fails, s.x) and (before = '' or not regexp_matches(fails, '[' || before || '_]'))) as removed,
  sum(n) filter (contains(fails, s.x) and before <> '' and regexp_matches(fails, '[' || before || '_]')) as redundant,
  sum(n) filter (fails = s.x) as unique_fails,
  sum(good) filter (contains(fails, s.x) and (before = '' or not regexp_matches(fails, '[' || before || '_]'))) as good_lost,
  sum(toxic) filter (contains(fails, s.x) and (before = '' or not regexp_matches(fails, '[' || before || '_]'))) as toxic_lost
  from m, s group by all)
select part, filter_order, step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant, coalesce(unique_fails, 0)::bigint as unique_fails,
  coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost, coalesce(sum(removed) over (partition by part, x), 0)::bigint as shapley from r""",
}
