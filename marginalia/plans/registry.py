"""Registered queries and their SQL oracles."""

from __future__ import annotations

from . import audit_queries, evaluations, more_queries, search, state_queries, tables

_PARTS = (search, tables, evaluations, audit_queries, more_queries, state_queries)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
