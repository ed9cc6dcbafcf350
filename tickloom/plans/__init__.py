"""All registered queries."""

from tickloom.plans import (  # noqa: F401
    book_queries, grid_queries, report_queries, signal_queries, source_queries, strategy_queries,
    study_queries, time_queries)
from tickloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
