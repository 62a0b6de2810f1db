"""All registered queries and their SQL counterparts, gathered from the plan modules."""

from __future__ import annotations

from importlib import import_module

from .common import ORACLE_SQL, QUERIES

MODULES = ("basics", "entities", "roads", "places", "search", "surfaces", "operations", "stored")

for _name in MODULES:
    import_module(f"{__package__}.{_name}")

__all__ = ["ORACLE_SQL", "QUERIES"]
