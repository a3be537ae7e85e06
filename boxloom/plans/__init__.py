"""Registered queries and the SQL each is checked against."""

from __future__ import annotations

from importlib import import_module

GROUPS = ("diffs", "review", "lifecycle", "transfer", "training", "tiles", "clips", "scoring", "files")


def load_all():
    """Import every group of queries and return ``(queries, oracles)``."""
    from boxloom.plans import registry

    for group in GROUPS:
        import_module(f"boxloom.plans.{group}")
    return registry.QUERIES, registry.ORACLES
