"""The hourly observation view, projected from lineitem: one column list that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Columns of the view: date, hour, grid cell, temperature and dew point (°C), pressure (hPa).
OBS_COLUMNS = """CAST(l_shipdate AS DATE) AS d,
  CAST((l_orderkey * 7 + l_linenumber * 5 + l_partkey) % 24 AS INT) AS h,
  CAST(l_suppkey % 3 AS INT) AS cy, CAST(l_partkey % 4 AS INT) AS cx, l_linenumber AS code,
  CAST(-15 AS DOUBLE) + CAST(0.9 AS DOUBLE) * l_quantity AS t,
  CASE WHEN l_tax = CAST(0.08 AS DOUBLE) THEN NULL
       ELSE CAST(-14 AS DOUBLE) + CAST(0.9 AS DOUBLE) * l_quantity - CAST(150 AS DOUBLE) * l_discount END AS td,
  CASE WHEN l_tax = CAST(0.07 AS DOUBLE) THEN NULL WHEN l_tax = 0 AND l_linenumber = 7 THEN CAST(5 AS DOUBLE)
       ELSE CAST(600 AS DOUBLE) + (l_extendedprice % CAST(45000 AS DOUBLE)) / CAST(100 AS DOUBLE) END AS p"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*_split(OBS_COLUMNS))


def _split(columns: str) -> list[str]:
    """The column list at its top-level commas."""
    out, depth, start = [], 0, 0
    for k, ch in enumerate(columns):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(columns[start:k])
            start = k + 1
    return [*out, columns[start:]]
