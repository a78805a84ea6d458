"""Queries over the test tables, one per operator, with SQL that gives the same rows."""

from __future__ import annotations

import importlib

MODULES = ("scalar", "relational", "denials", "models")


def load_all():
    """Import every query module and return the registry."""
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return importlib.import_module(f"{__name__}.registry")
