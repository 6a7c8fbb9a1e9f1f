"""The library's queries over the driver's tables, and their SQL."""

from __future__ import annotations

from .plans import codebook_queries, formula_queries, layout_queries, lint_queries, run_queries, text_queries
from .plans.registry import ORACLES, QUERIES

page_triage = text_queries.page_triage
__all__ = ["ORACLES", "QUERIES", "codebook_queries", "formula_queries", "layout_queries", "page_triage", "lint_queries", "run_queries"]
