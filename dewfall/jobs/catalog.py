"""All registered queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dewfall.jobs import accumulation, alignment, climatology, diagnostics, distributions, montecarlo, oracles, pooling, products, validation

ORACLE_SQL: dict[str, str] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
for _module, _sql in ((climatology, oracles.SQL), (products, products.SQL), (validation, validation.SQL), (alignment, alignment.SQL), (diagnostics, diagnostics.SQL), (distributions, distributions.SQL), (montecarlo, montecarlo.SQL), (pooling, pooling.SQL), (accumulation, accumulation.SQL)):
    ORACLE_SQL |= _sql
    QUERIES |= {name: getattr(_module, name) for name in (*_sql, *getattr(_module, "UNCHECKED", ()))}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["moments_l1"](spark, sf_dir)
