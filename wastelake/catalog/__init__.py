"""Registered queries and their SQL twins, one module per part of the library."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("filtering", "registry", "joining", "calendar", "geography", "adequacy", "area", "browsing", "planning", "modeling", "files", "streams")

Query = Callable[[SparkSession, str], DataFrame]


def load() -> tuple[dict[str, Query], dict[str, str]]:
    queries: dict[str, Query] = {}
    oracles: dict[str, str] = {}
    for name in MODULES:
        module = import_module(f"wastelake.catalog.{name}")
        queries.update(module.BOOK.queries)
        oracles.update(module.BOOK.oracles)
    return queries, oracles
