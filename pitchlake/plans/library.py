"""Registers all queries: importing it is enough."""

from . import queries_analysis, queries_assembly, queries_events, queries_features, queries_joins, queries_platform, queries_text  # noqa: F401
