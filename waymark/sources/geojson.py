"""GeoJSON lines in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.network import merge_parts

_FEATURES = "struct<features:array<struct<id:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>>"


def read_geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    """(stem, fid, props, parts array<array<struct<lon,lat>>>): a row per line feature; features without a line are skipped.

    The parts of a multi-line that touch end to end, where just two ends meet, are one
    part; of the others those of two points and more stay.
    """
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.\w+$", 1).alias("stem"), F.from_json("value", _FEATURES).alias("g"))
    f = files.select("stem", F.posexplode("g.features").alias("fid", "f"))
    one = F.array(F.from_json("f.geometry.coordinates", "array<array<double>>"))
    many = F.from_json("f.geometry.coordinates", "array<array<array<double>>>")
    parts = F.when(F.col("f.geometry.type") == "LineString", one).when(F.col("f.geometry.type") == "MultiLineString", many)
    plain = F.transform(parts, lambda p: F.transform(p, lambda c: F.struct(F.get(c, F.lit(0)).alias("lon"), F.get(c, F.lit(1)).alias("lat"))))
    out = f.select("stem", F.col("fid").alias("row"), F.coalesce("f.id", F.col("fid").cast("string")).alias("fid"), F.col("f.properties").alias("props"), F.filter(plain, lambda p: F.size(p) >= 2).alias("parts"))
    out = out.filter(F.size("parts") > 0)
    several = out.filter(F.size("parts") > 1).select(F.struct("stem", "row").alias("line_id"), F.posexplode("parts").alias("part", "p"))
    points = several.select("line_id", "part", F.posexplode("p").alias("seq", "c")).select("line_id", "part", "seq", F.col("c.lon").alias("x"), F.col("c.lat").alias("y"))
    joined = merge_parts(points, 9).groupBy("line_id", "part").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("p"))
    whole = joined.groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("part", "p"))).alias("ps"))
    whole = whole.select("line_id.stem", "line_id.row", F.transform("ps", lambda q: F.transform(q["p"], lambda c: F.struct(c["x"].alias("lon"), c["y"].alias("lat")))).alias("merged"))
    return out.join(whole, ["stem", "row"], "left").select("stem", "fid", "props", F.coalesce("merged", "parts").alias("parts"))


def geojson_legs(legs: DataFrame) -> DataFrame:
    """(project_id, value): a FeatureCollection of legs (project_id, alignment_id, leg, name, kind, length_m, coords), coordinates at 7 decimals."""
    coords = F.transform("coords", lambda p: F.array(F.round(p["lon"], 7), F.round(p["lat"], 7)))
    props = F.struct("name", "kind", F.round("length_m").cast("long").alias("length_m"), "alignment_id", "leg")
    feature = F.struct(F.lit("Feature").alias("type"), props.alias("properties"), F.struct(F.lit("LineString").alias("type"), coords.alias("coordinates")).alias("geometry"))
    rows = legs.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("alignment_id", "leg", feature.alias("f")))).alias("fs"))
    return rows.select("project_id", F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.transform("fs", lambda x: x["f"]).alias("features"))).alias("value"))


def write_profile(profile: DataFrame, path: str) -> None:
    """Profile rows by project, in line order within files."""
    profile.repartition("project_id").sortWithinPartitions("line_id", "i").write.partitionBy("project_id").parquet(path)
