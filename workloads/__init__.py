"""Queries over the sample tables, each with the SQL that it must agree with."""

from workloads import casts, combining, files, filters, grids, mappings, sinks, summaries  # noqa: F401
from workloads.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
