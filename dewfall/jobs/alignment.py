"""Jobs over the three stored inputs: axes against the reference's, strict alignment of bucketed tables, and a report of what does not align."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dewfall.jobs.oracles import MOIST
from dewfall.sources import triplets
from dewfall.sources.observations import observations
from dewfall.sources.states import delete_folder, scratch

INPUTS = ("t2m", "d2m", "sp")


def axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axes along x of the three inputs over the cells that observations have: the second runs backwards, the third is a hundred-millionth off."""
    rows = observations(spark, sf_dir).select("cx").distinct()
    lon = F.lit(35.0) + F.col("cx") * F.lit(0.1)
    back = rows.join(F.broadcast(rows.agg(F.max("cx").alias("most"))))  # one row
    one = lambda df, name, k, value: df.select(F.lit(name).alias("grid"), k.alias("k"), value.alias("value"))
    return one(rows, "t2m", F.col("cx"), lon).unionByName(one(back, "d2m", F.col("most") - F.col("cx"), lon)).unionByName(one(rows, "sp", F.col("cx"), lon + 1e-8))


def coordinate_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each input's axis relates to the first one's, with a shifted and a shuffled axis beside them."""
    plain = axes(spark, sf_dir)
    first = plain.where("grid = 't2m'")
    shifted = first.select(F.lit("shifted").alias("grid"), "k", (F.col("value") + 0.01).alias("value"))
    shuffled = first.select(F.lit("shuffled").alias("grid"), F.col("k").bitwiseXOR(1).alias("k"), "value")
    return triplets.axis_relations(plain.unionByName(shifted).unionByName(shuffled), "t2m")


def _with_inputs(spark: SparkSession, sf_dir: str, keep: Callable[[str], F.Column], work: Callable[[list[str]], DataFrame]) -> DataFrame:
    """work's rows over the stored inputs, where keep(input) tells which hours an input has; the inputs are deleted once the rows are written."""
    folder, tag = scratch(spark, "inputs"), uuid.uuid4().hex[:12]
    hours = observations(spark, sf_dir).groupBy("cy", "cx", "d", "h").agg(F.avg("t").alias("t2m"), F.avg("td").alias("d2m"), F.avg("p").alias("sp"))
    relations, most = triplets.axis_relations(axes(spark, sf_dir), "t2m"), F.max("cx")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = []
    for name in INPUTS:
        own = hours.where(keep(name)).select("cy", "cx", "d", "h", F.col(name).alias("x"))
        if name == "d2m":  # as its file has it: along an axis that runs backwards
            own = own.join(F.broadcast(hours.agg(most.alias("most")))).withColumn("cx", F.col("most") - F.col("cx")).drop("most")  # one row
        names.append(f"{name}_{tag}")
        triplets.store_input(triplets.turned(own, relations, name), names[-1], folder, buckets)
    out = work(names)
    out.write.parquet(f"{folder}-rows")
    for name in names:
        spark.sql(f"DROP TABLE {name}")
    delete_folder(spark, folder)
    return spark.read.parquet(f"{folder}-rows")


def aligned_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours and sums of the aligned inputs per cell and month."""

    def work(names: list[str]) -> DataFrame:
        df = triplets.aligned(spark, names).groupBy("cy", "cx", F.month("d").alias("month"))
        return df.agg(F.count("*").alias("hours"), *(F.count(c).alias(f"n_{c}") for c in ("t", "td", "p")), *(F.round(F.sum(c), 5).alias(f"sum_{c}") for c in ("t", "td", "p")))

    return _with_inputs(spark, sf_dir, lambda _: F.lit(True), work)


def alignment_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours missing and extra per cell and input, where dew point lacks each seventh hour of some days, and pressure whole days, and the first input lacks hour 3 of others."""
    gone = {"t2m": (F.dayofmonth("d") == 9) & (F.col("h") == 3), "d2m": (F.dayofmonth("d") % 5 == 0) & (F.col("h") % 7 == 0), "sp": F.dayofmonth("d") == 28}

    def work(names: list[str]) -> DataFrame:
        return triplets.alignment_report(spark, names).withColumn("input", F.substring_index("input", "_", 1))

    return _with_inputs(spark, sf_dir, lambda name: ~gone[name], work)


SQL: dict[str, str] = {
    "coordinate_relation": f"""WITH {MOIST}, c AS (SELECT DISTINCT cx FROM obs), a0 AS (SELECT cx AS k, 35.0::DOUBLE + cx * 0.1::DOUBLE AS value FROM c),
ax AS (SELECT 't2m' AS grid, k, value FROM a0 UNION ALL SELECT 'd2m', (SELECT max(cx) FROM c) - k, value FROM a0 UNION ALL SELECT 'sp', k, value + 1e-8::DOUBLE FROM a0
  UNION ALL SELECT 'shifted', k, value + 0.01::DOUBLE FROM a0 UNION ALL SELECT 'shuffled', xor(k, 1), value FROM a0),
sz AS (SELECT grid, count(*) AS n FROM ax GROUP BY grid), r AS (SELECT k AS rk, value AS ref FROM ax WHERE grid = 't2m'),
s AS (SELECT grid, bool_and(coalesce(abs(value - ref) <= 1e-6, FALSE)) AS same FROM ax LEFT JOIN r ON k = rk GROUP BY grid),
t AS (SELECT grid, bool_and(coalesce(abs(value - ref) <= 1e-6, FALSE)) AS turned FROM ax JOIN sz USING (grid) LEFT JOIN r ON n - 1 - k = rk GROUP BY grid),
m AS (SELECT grid, bool_and(coalesce(step > 0, TRUE)) OR bool_and(coalesce(step < 0, TRUE)) AS monotonic FROM (SELECT grid, value - lag(value) OVER (PARTITION BY grid ORDER BY k) AS step FROM ax) GROUP BY grid)
SELECT grid, n, CASE WHEN same THEN 'exact' WHEN turned THEN 'reversed' ELSE 'mismatch' END AS relation, monotonic FROM sz JOIN s USING (grid) JOIN t USING (grid) JOIN m USING (grid)""",
    "aligned_inputs": f"""WITH {MOIST}, hr AS (SELECT cy, cx, d, h, avg(t) AS t, avg(td) AS td, avg(p) AS p FROM obs GROUP BY ALL)
SELECT cy, cx, CAST(month(d) AS INTEGER) AS month, count(*) AS hours, count(t) AS n_t, count(td) AS n_td, count(p) AS n_p, round(sum(t), 5) AS sum_t, round(sum(td), 5) AS sum_td, round(sum(p), 5) AS sum_p FROM hr GROUP BY ALL""",
    "alignment_gaps": f"""WITH {MOIST}, hr AS (SELECT DISTINCT cy, cx, d, h, NOT (day(d) = 9 AND h = 3) AS t, NOT (day(d) % 5 = 0 AND h % 7 = 0) AS td, day(d) <> 28 AS p FROM obs),
lg AS (SELECT cy, cx, d, 'd2m' AS input, t AND NOT td AS gone, td AND NOT t AS more FROM hr UNION ALL SELECT cy, cx, d, 'sp', t AND NOT p, p AND NOT t FROM hr)
SELECT cy, cx, input, count(DISTINCT d) AS days, count(*) FILTER (gone) AS missing, count(*) FILTER (more) AS extra FROM lg WHERE gone OR more GROUP BY cy, cx, input""",
}
