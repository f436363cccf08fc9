"""Queries on the test tables, each with its SQL check."""

from lossgauge.catalog import analyses, associations, cleaning, intake, joining, models, panels, profiles, summaries  # noqa: F401
from lossgauge.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
