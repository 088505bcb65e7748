"""Importing this package registers every query."""

from querysentry.workload import lexical, metrics, models, reports, traces  # noqa: F401
from querysentry.workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
