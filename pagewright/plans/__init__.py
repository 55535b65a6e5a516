"""Named queries over the tables."""

from __future__ import annotations

from importlib import import_module

MODULES = ("integrity", "scalar_queries", "relational_queries", "retrieval_queries", "training_queries", "io_queries")


def registries() -> list:
    """The registries of all query modules of the core."""
    return [import_module(f"pagewright.plans.{m}").REGISTRY for m in MODULES]
