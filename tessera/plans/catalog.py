"""All registered queries of the library with their equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import assembly, bundles, clinical, dates, documents, governance, identifiers, observations, relational, relations, reports  # noqa: F401  they register their queries
from tessera.plans.registry import ORACLES, QUERIES

FLAGSHIP = "lab_trend"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
