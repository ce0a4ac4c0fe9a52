"""Registered queries: each reads the given tables and has a SQL text to compare with."""

import importlib

MODULES = ("traffic", "monitoring", "vulnerability", "ingest", "streams", "storage")


def load_all() -> None:
    """Import every query module so that its queries register."""
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
