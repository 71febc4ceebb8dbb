"""All registered queries and their checking SQL, one module per area."""

from __future__ import annotations

import functools
import importlib

from leafmart.session import small_methods

AREAS = ["offers", "visitors", "audits", "runs", "upkeep", "texts", "window", "selection"]


def _areas():
    return [importlib.import_module(f"leafmart.registry.{a}") for a in AREAS]


def _tuned(fn):
    @functools.wraps(fn)
    def run(spark, sf_dir):
        small_methods(spark)
        return fn(spark, sf_dir)

    return run


def queries() -> dict:
    return {name: _tuned(fn) for area in _areas() for name, fn in area.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for area in _areas() for name, sql in area.ORACLES.items()}
