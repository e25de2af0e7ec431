"""The library's queries over the driver's tables."""

from . import catalogue_queries, evaluation_queries, export_queries, profile_queries, refine_queries, scoring_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
