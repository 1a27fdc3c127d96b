"""Registry of the named queries and their SQL oracles."""

from __future__ import annotations

from .plans import drainage, rivers, terrain, tools

MODULES = (terrain, rivers, drainage, tools)


def queries():
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracle_sql():
    return {name: text for module in MODULES for name, text in module.ORACLES.items()}
