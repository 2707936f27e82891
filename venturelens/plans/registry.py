"""Registered queries: one Spark plan per operator key, with its DuckDB oracle.

Each query takes ``(spark, sf_dir)``, reads the driver tables of ``sf_dir``
through the shared bindings and returns a lazy DataFrame.  The oracle text is
the same computation written as brute-force DuckDB SQL; keys without an oracle
get a rows-only check and invariant tests of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from venturelens.plans import quality_queries, queries, search_queries  # noqa: F401
