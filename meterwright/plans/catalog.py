"""Registered queries and their DuckDB twins."""

from __future__ import annotations

from . import ledger_queries, more_queries, record_queries, report_queries, sequence_queries, session_queries, text_queries

MODULES = [ledger_queries, text_queries, report_queries, session_queries, more_queries, record_queries, sequence_queries]


def queries():
    return {name: query for module in MODULES for name, (query, _) in module.QUERIES.items()}


def oracle_sql():
    return {name: twin for module in MODULES for name, (_, twin) in module.QUERIES.items() if twin}
