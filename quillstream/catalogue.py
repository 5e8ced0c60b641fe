"""All queries of the engine by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillstream.plans import queries as plans


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(plans.ALL)


def oracle_sql() -> dict[str, str]:
    return dict(plans.SQL)
