"""Queries over the given tables, one per operator, each with equivalent SQL where SQL can say it."""

from importlib import import_module

MODULES = ("cleaning", "checks", "anomalies", "quality", "runs", "storage", "streams")


def load_all():
    """Import every query module and return the registry."""
    for name in MODULES:
        import_module(f"sievework.suite.{name}")
    return import_module("sievework.suite.registry")
