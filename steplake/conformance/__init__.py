"""Queries over the driver tables that exercise every operator."""

from importlib import import_module

from steplake.conformance.registry import ORACLE, QUERIES

MODULES = ["steps", "quality", "relational", "tables", "streams", "functions"]


def load_all():
    """Import every query module; returns the queries and their SQL twins by name."""
    for name in MODULES:
        import_module(f"steplake.conformance.{name}")
    return QUERIES, ORACLE
