"""Queries by name, each with the SQL it is held against where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .adapters import ALIGNMENTS, SAMPLES, TRACK_POINTS

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its own name; track_points, samples and alignments are views in ``sql``."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            views = [f"{n} as ({q})" for n, q in (("track_points", TRACK_POINTS), ("samples", SAMPLES), ("alignments", ALIGNMENTS)) if n in sql]
            text = sql.strip()
            if text.startswith("with recursive "):
                text = "with recursive " + ", ".join([*views, text[15:]])
            elif text.startswith("with "):
                text = "with " + ", ".join([*views, text[5:]])
            elif views:
                text = "with " + ", ".join(views) + " " + text
            ORACLES[f.__name__] = text
        return f

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles at so many places, without negative zero."""
    return df.select(*[(F.round(F.col(c), places) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
