"""Catalogues of elevation sources in GeoJSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Properties that are copied, by type; names of the text ones; the two rows that are always there.
TEXTS = ["title", "region", "product", "source", "source_url", "horizontal_crs", "vertical_datum", "cog_url", "pmtiles_url", "tiles_url", "slope_url", "slope_tiles_url", "fill_mode", "notes"]
NUMBERS = {"year": "int", "native_res_m": "double", "min_zoom": "int", "max_zoom": "int", "coverage_km2": "double", "z_min": "double", "z_max": "double", "slope_step": "double"}
CONTEXT = [
    {
        "slug": "terrarium",
        "title": "AWS Terrain Tiles (Terrarium)",
        "kind": "context",
        "encoding": "terrarium",
        "tiles_url": "https://s3.amazonaws.com/elevation-tiles-prod/terrarium/{z}/{x}/{y}.png",
        "min_zoom": "0",
        "max_zoom": "15",
        "region": "Global",
        "product": "Regional DEM (USGS NED 2 arc-second in Alaska; includes bathymetry)",
        "source": "Mapzen / AWS Open Data Terrain Tiles",
        "source_url": "https://registry.opendata.aws/terrain-tiles/",
        "notes": "Public, no key, CORS open. The map's terrain outside lidar footprints.",
        "enabled": "true",
    },
    {
        "slug": "usgs3dep",
        "title": "USGS 3DEP elevation (ImageServer)",
        "kind": "context",
        "encoding": "imageserver",
        "tiles_url": "https://elevation.nationalmap.gov/arcgis/rest/services/3DEPElevation/ImageServer",
        "min_zoom": "0",
        "max_zoom": "14",
        "region": "United States",
        "product": "Regional DEM (5 m IfSAR in Alaska)",
        "source": "USGS 3D Elevation Program",
        "source_url": "https://www.usgs.gov/3d-elevation-program",
        "notes": "Live float32 exports per tile; slower than Terrarium. Off by default.",
        "enabled": "false",
    },
]
# Texts of a catalogue's own context.
BAKED = {"region": "Around every hosted survey", "product": "Regional DEM (USGS 3DEP 1/3 arc-second, baked)", "source": "USGS 3D Elevation Program, baked", "source_url": "https://www.usgs.gov/3d-elevation-program"}
_FEATURE = "struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"
_CATALOGUE = f"struct<features:array<{_FEATURE}>,context:map<string,string>>"


def _columns(p: Column) -> list[Column]:
    text = [F.coalesce(F.try_element_at(p, F.lit(n)), F.lit("")).alias(n) for n in TEXTS]
    return [*text, *[F.try_element_at(p, F.lit(n)).try_cast(t).alias(n) for n, t in NUMBERS.items()]]


def source_rows(features: DataFrame) -> DataFrame:
    """(slug, kind, encoding, footprint, enabled, properties ...) of catalogue features (properties, geometry).

    A feature without an id is left out; absent texts are empty; a polygon becomes a
    multipolygon of one, any other geometry none.
    """
    p, g = F.col("properties"), F.col("geometry")
    many = F.when(g["type"] == "Polygon", F.concat(F.lit("["), g["coordinates"], F.lit("]"))).when(g["type"] == "MultiPolygon", g["coordinates"])
    slug = F.nullif(F.try_element_at(p, F.lit("id")), F.lit(""))
    rows = features.select(slug.alias("slug"), F.lit("lidar").alias("kind"), F.lit("mapbox").alias("encoding"), many.alias("footprint"), F.lit(True).alias("enabled"), *_columns(p))
    return rows.filter("slug is not null")


def context_rows(contexts: DataFrame, source: str = BAKED["source"]) -> DataFrame:
    """The row of a catalogue's own context (a map), if it has an id and tiles: zooms 0 to 13 and ten metres unless it says so. ``source`` says who made it."""
    p = F.col("context")
    at = lambda n: F.nullif(F.try_element_at(p, F.lit(n)), F.lit(""))
    zero = lambda n, t, other: F.when(F.coalesce(at(n).try_cast(t), F.lit(0)) == 0, F.lit(other)).otherwise(at(n).try_cast(t))
    made = {
        "title": F.coalesce(at("title"), at("id")), "pmtiles_url": at("pmtiles_url"), "tiles_url": F.coalesce(at("tiles_url"), F.lit("")),
        "min_zoom": zero("min_zoom", "int", 0), "max_zoom": zero("max_zoom", "int", 13), "native_res_m": zero("native_res_m", "double", 10.0),
    }
    made |= {n: F.lit(v) for n, v in {**BAKED, "source": source}.items()}
    rest = [(made[n] if n in made else F.lit("")).alias(n) for n in TEXTS] + [(made[n] if n in made else F.lit(None)).cast(t).alias(n) for n, t in NUMBERS.items()]
    rows = contexts.select(at("id").alias("slug"), F.lit("context").alias("kind"), F.lit("mapbox").alias("encoding"), F.lit(None).cast("string").alias("footprint"), F.lit(True).alias("enabled"), *rest)
    return rows.filter("slug is not null and pmtiles_url is not null")


def fixed_context(spark: SparkSession) -> DataFrame:
    """The two rows that every catalogue has."""
    made = spark.createDataFrame([(r,) for r in CONTEXT], "p map<string,string>")
    p = F.col("p")
    at = lambda n: F.try_element_at(p, F.lit(n))
    return made.select(at("slug").alias("slug"), at("kind").alias("kind"), at("encoding").alias("encoding"), F.lit(None).cast("string").alias("footprint"), at("enabled").cast("boolean").alias("enabled"), *_columns(p))


def read_dem_catalog(spark: SparkSession, path: str) -> DataFrame:
    """All sources of the catalogues in ``path``; rows for a slug that two catalogues have differ only in what they say."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", _CATALOGUE).alias("g"))
    features = text.select(F.explode("g.features").alias("f")).select("f.properties", "f.geometry")
    return source_rows(features).unionByName(context_rows(text.select("g.context").filter("context is not null"))).unionByName(fixed_context(spark))
