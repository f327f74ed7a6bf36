"""All queries of the core and the SQL that gives the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("ranking_queries", "event_queries", "evaluation_queries", "text_queries", "passage_queries", "trace_queries", "selection_queries", "judging_queries", "ledger_queries", "cleaning_queries", "span_queries", "preparation_queries", "source_queries")


def _all(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        part = getattr(importlib.import_module(f"evifold.plans.{module}"), name)
        if clash := out.keys() & part.keys():
            raise ValueError(f"two queries are called {clash}")
        out |= part
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("SQL")
