"""Registered queries: each operator applied to the proxy panel, with the SQL that checks it."""

from __future__ import annotations

from crossgrain.queries import calendar, context, contracts, cross_section, factor_stats, factors, labels, ledger, ranking, streaming  # noqa: F401  each registers its queries
from crossgrain.queries.registry import QUERIES, oracle_sql

__all__ = ["QUERIES", "oracle_sql"]
