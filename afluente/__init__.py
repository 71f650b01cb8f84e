"""Consolidate messy delimited files, workbooks and tables with Spark."""

from afluente.operators.combine import DuplicateRule
from afluente.operators.filters import FilterRule
from afluente.operators.summary import Aggregation, SummaryRule
from afluente.plans.analyze import analyze_headers, refresh_headers
from afluente.plans.consolidate import Outputs, consolidate, consolidate_tables, write_outputs, write_run
from afluente.plans.preview import preview
from afluente.sources.folder import open_folder

__all__ = [
    "Aggregation",
    "DuplicateRule",
    "FilterRule",
    "Outputs",
    "SummaryRule",
    "analyze_headers",
    "consolidate",
    "consolidate_tables",
    "open_folder",
    "preview",
    "refresh_headers",
    "write_outputs",
    "write_run",
]
