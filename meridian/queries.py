"""All queries over the relational tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meridian.plans import campaigns, checks, estimation, networks, scalars, surveys
from meridian.plans.registry import QUERIES, SQL

__all__ = ["campaigns", "checks", "entry", "estimation", "networks", "oracle_sql", "queries", "scalars", "surveys"]


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: a network of height differences, adjusted."""
    return QUERIES["network_adjustment"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
