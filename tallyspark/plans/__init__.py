"""Registered queries: each plan module maps names to (spark, sf_dir) -> DataFrame and to SQL."""

from __future__ import annotations

from collections.abc import Callable

from . import audit, ledger, reconcile, routing, stream, text

MODULES: list = [reconcile, routing, text, ledger, audit, stream]


def queries() -> dict[str, Callable]:
    return {name: fn for module in MODULES for name, fn in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
