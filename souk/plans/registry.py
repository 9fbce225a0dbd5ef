"""All registered queries of the market operators and their SQL."""

from __future__ import annotations

from . import feeds, forecasts, reports, valuations  # noqa: F401  (they register their queries)
from .market import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
