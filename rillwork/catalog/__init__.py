"""Queries of every operator over the star-schema test tables, each next to its SQL twin."""

from importlib import import_module

MODULES = ["scans", "clean", "joins", "rollups", "windows", "entities", "statistics", "lists", "views", "streams"]


def load():
    """Import all query modules and return the registry."""
    for m in MODULES:
        import_module(f"rillwork.catalog.{m}")
    return import_module("rillwork.catalog.base")
