"""Queries of this package, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_MODULES = (
    "warc", "secrets", "dac", "near_dedup", "line_dedup", "lattice", "outliers", "packing", "decontaminate", "url_rules",
    "merkle", "pii", "alignment",
)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def load() -> None:
    """Import every operator module, which registers its query."""
    for name in _MODULES:
        import_module(f"tidemark.llm.{name}")
