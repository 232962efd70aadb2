"""All registered queries of the engine proper."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evidentia.plans import analytics, authorship, collection, dashboards, extra, graphs, quality, relational, search, temporal  # noqa: F401  they register their queries
from evidentia.plans.registry import ORACLES, QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
