"""Registered queries with their plain-SQL twins."""

from importlib import import_module

MODULES = ["tables", "metrics", "forms", "learning"]


def load_all():
    """All queries and all SQL texts, in registration order."""
    from wardtable.registry.base import ORACLE, QUERIES

    for name in MODULES:
        import_module(f"wardtable.registry.{name}")
    return QUERIES, ORACLE
