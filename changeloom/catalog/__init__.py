"""Registered queries: each binds one operator to the given tables and carries the SQL that must agree with it."""

from __future__ import annotations

import importlib
import pkgutil


def load():
    """Import every catalog module; returns the queries and their oracle SQL."""
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
    from changeloom.catalog.registry import ORACLES, QUERIES

    return dict(QUERIES), dict(ORACLES)
