"""Every query of the library by name, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import accuracy, association, checks, coverage, fleet, identity, reports, scores, solving, verification


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return accuracy.QUERIES | association.QUERIES | checks.QUERIES | coverage.QUERIES | fleet.QUERIES | identity.QUERIES | reports.QUERIES | scores.QUERIES | solving.QUERIES | verification.QUERIES


def oracle_sql() -> dict[str, str]:
    return accuracy.SQL | association.SQL | checks.SQL | coverage.SQL | fleet.SQL | identity.SQL | reports.SQL | scores.SQL | solving.SQL | verification.SQL
