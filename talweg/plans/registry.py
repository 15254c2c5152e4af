"""Every query by name, with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import answers, catalog, detection, evaluation, indexing, library, planning, reliability, retrieval, textual, timeseries

_FAMILIES = (catalog, retrieval, answers, timeseries, reliability, textual, detection, evaluation, indexing, library, planning)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for family in _FAMILIES for name, (f, _) in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in _FAMILIES for name, (_, sql) in family.QUERIES.items() if sql}
