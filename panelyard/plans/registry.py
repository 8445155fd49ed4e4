"""All queries of the panel engine by name, and their SQL."""

from __future__ import annotations

from panelyard.plans import diagnostic_queries, feature_queries, formula_queries, panel_queries, proved_queries, research_queries, source_queries, study_queries, timing_queries

_MODULES = (formula_queries, panel_queries, research_queries, feature_queries, study_queries, proved_queries, diagnostic_queries, timing_queries, source_queries)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
