"""All core queries and their SQL; modules add theirs to MODULES."""

from __future__ import annotations

from folioloom.plans import core_queries, nested_queries, optin_queries

MODULES = (nested_queries, core_queries, optin_queries)


def queries() -> dict:
    return {k: q for m in MODULES for k, q in m.QUERIES.items()}


def sql() -> dict:
    return {k: q for m in MODULES for k, q in m.SQL.items()}
