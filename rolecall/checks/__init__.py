"""Queries over the given test tables, each with the SQL it is compared with."""

from importlib import import_module

MODULES = ("relational", "parsing", "writes", "vectors", "resumes", "models", "facets")


def load_all() -> None:
    for name in MODULES:
        import_module(f"rolecall.checks.{name}")
