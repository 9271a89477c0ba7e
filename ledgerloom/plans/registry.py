"""Registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from . import analytics, ingest, records

MODULES = (analytics, ingest, records)


def queries() -> dict[str, Callable]:
    return {k: v for m in MODULES for k, v in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.oracle_sql().items()}
