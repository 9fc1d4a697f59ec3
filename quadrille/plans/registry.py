"""Names of the queries and of the SQL that checks them."""

from __future__ import annotations

import inspect
from types import ModuleType

from quadrille.plans import datasets, maps, scoring

_MODULES: tuple[ModuleType, ...] = (scoring, maps, datasets)


def queries() -> dict:
    """Every function of the query modules that takes (spark, sf)."""
    out = {}
    for module in _MODULES:
        for name, f in inspect.getmembers(module, inspect.isfunction):
            if f.__module__ == module.__name__ and not name.startswith("_") and list(inspect.signature(f).parameters) == ["spark", "sf"]:
                out[name] = f
    return out


def oracle_sql() -> dict:
    return {name: sql for module in _MODULES for name, sql in module.SQL.items()}
