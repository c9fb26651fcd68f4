"""The registered queries by name, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register the decorated function under ``name``."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def over(*ctes: str, select: str) -> str:
    """One statement of common table expressions and a final select."""
    return f"WITH {', '.join(c.strip() for c in ctes)}\n{select}"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footprints of the event cubes with their peaks, centroids and fluxes."""
    return QUERIES["flagship"](spark, sf_dir)
