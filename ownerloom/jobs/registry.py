"""All registered queries of the library (without the llm subpackage)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: Modules that each offer QUERIES (name -> callable) and SQL (name -> text).
MODULES: tuple[str, ...] = ("revisions", "texts", "evaluation", "documents", "comments", "acceptance", "layout")


def _gather(what: str) -> dict:
    import importlib

    out: dict = {}
    for name in MODULES:
        found = getattr(importlib.import_module(f"ownerloom.jobs.{name}"), what)
        if clash := out.keys() & found.keys():
            raise ValueError(f"registered twice: {sorted(clash)}")
        out |= found
    return out


def queries() -> dict[str, Query]:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("SQL")
