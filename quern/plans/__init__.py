"""Registered queries by area."""

from importlib import import_module
from types import ModuleType

AREAS = ("results", "history", "catalog", "access", "retrieval", "workflow", "sqlpass", "sources", "streams")


def load_all() -> ModuleType:
    """Import every area once and return the registry."""
    for area in AREAS:
        import_module(f"quern.plans.{area}_queries")
    return import_module("quern.plans.registry")
