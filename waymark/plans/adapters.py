"""The driver's tables in the shape of trail tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TRACK_POINTS = """
select user_id as track_id, cast(row_number() over (partition by user_id order by ts, event_id) as int) as seq, ts,
       case when event_type = 'error' then null else value end as ele,
       -151.19e0 + sum((event_id * 37) % 41 - 20) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) / 56000e0 as lon,
       59.62e0 + sum((event_id * 53) % 43 - 21) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) / 111000e0 as lat
from events"""

SAMPLES = """
select line_id, cast(leg as int) as leg, cast(i as int) as i, case when i = 0 then 0e0 else q end as w,
       sum(case when i = 0 then 0e0 else q end) over (partition by line_id order by i rows between unbounded preceding and current row) as d,
       z, gx, gy, heading, src
from (select l_suppkey as line_id, l_linenumber - 1 as leg,
             row_number() over (partition by l_suppkey order by l_linenumber, l_shipdate, l_orderkey, l_partkey, l_extendedprice, l_quantity, l_discount, l_tax) - 1 as i,
             l_quantity as q, case when l_returnflag = 'R' then null else l_extendedprice / 100e0 end as z,
             (l_discount - 0.05e0) * 8 as gx, (l_tax - 0.04e0) * 8 as gy, radians(l_partkey % 360) as heading,
             case when l_linestatus = 'F' then 0 else 1 end as src
      from lineitem) o"""

ALIGNMENTS = """
select o_orderkey as alignment_id, c_nationkey as project_id, concat('A', cast(o_orderkey % 7 as varchar(10))) as name,
       case o_orderpriority when '1-URGENT' then 'Preferred' when '2-HIGH' then ' alternate ' when '3-MEDIUM' then 'Future'
            when '4-NOT SPECIFIED' then '2' else 'some option' end as priority_text,
       case o_orderkey % 3 when 0 then 'public' when 1 then 'gated' else 'private' end as visibility,
       o_custkey as owner_id, o_totalprice as price, o_orderdate as taken_at,
       case when o_orderkey % 5 = 0 or o_orderkey < 5 then null else cast(floor(o_orderkey / 5) as bigint) end as parent_id
from orders join customer on o_custkey = c_custkey"""

_READS = {"track_points": ("events", TRACK_POINTS), "alignments": ("orders customer", ALIGNMENTS)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _samples(lineitem: DataFrame) -> DataFrame:
    """The rows of ``SAMPLES``, dealt by line once: numbered by the table's own columns before others are made of them."""
    order = ["l_linenumber", "l_shipdate", "l_orderkey", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]
    numbered = lineitem.withColumnRenamed("l_suppkey", "line_id").withColumn("i", F.row_number().over(Window.partitionBy("line_id").orderBy(*order)) - 1)
    w = F.when(F.col("i") == 0, 0.0).otherwise(F.col("l_quantity"))
    d = F.sum("w").over(Window.partitionBy("line_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return numbered.withColumn("w", w).select(
        "line_id", (F.col("l_linenumber") - 1).cast("int").alias("leg"), "i", "w", d.alias("d"),
        F.when(F.col("l_returnflag").eqNullSafe("R"), None).otherwise(F.col("l_extendedprice") / 100.0).alias("z"),
        ((F.col("l_discount") - 0.05) * 8).alias("gx"), ((F.col("l_tax") - 0.04) * 8).alias("gy"), F.radians(F.col("l_partkey") % 360).alias("heading"),
        F.when(F.col("l_linestatus") == "F", 0).otherwise(1).alias("src"),
    )


def adapted(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of track_points, samples, alignments over the tables in ``sf_dir``."""
    if name == "samples":
        return _samples(table(spark, sf_dir, "lineitem"))
    needs, sql = _READS[name]
    return spark.sql(_named(sql, needs), **{n: table(spark, sf_dir, n) for n in needs.split()})


def _named(sql: str, needs: str) -> str:
    for n in needs.split():
        sql = sql.replace(f"from {n}", f"from {{{n}}}").replace(f"join {n} ", f"join {{{n}}} ")
    return sql
