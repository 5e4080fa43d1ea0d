"""Neighbouring hours, ranks, percentiles and centred windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that the values of a group are cut into, so that no group is ranked in one task.
PARTS = 64
#: Values of a group that its ranges are cut by, about.
CUT_BY = 4_000


def neighbours(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """df with prev and next: the value before and after in each group."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumns({"prev": F.lag(value).over(w), "next": F.lead(value).over(w)})


def running(counts: DataFrame, keys: Sequence[str], value: str, weight: str, parts: int = PARTS) -> DataFrame:
    """counts with upto, the sum of weight over rows of the group with at most this value, and n, the sum of the whole group.

    One row for each value of a group. Quantiles of values picked by hash cut the group into ranges; ranges are summed, the few sums added up, and
    rows only within their range. Spark works the cuts out more than once, so they must not depend on the order in which rows arrive, as those of
    approx_percentile do. Keys are not null."""
    sizes = counts.groupBy(*keys).agg(F.count("*").alias("_size"))
    few = counts.join(sizes, list(keys)).where(F.pmod(F.xxhash64(value), F.lit(1 << 30)) * F.col("_size") < F.lit(CUT_BY << 30))
    cuts = few.groupBy(*keys).agg(F.percentile(value, F.array(*(F.lit(k / parts) for k in range(1, parts)))).alias("_cuts"))
    place = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(value))), F.lit(0))
    ranged = counts.join(cuts, list(keys), "left").withColumn("_range", place).drop("_cuts")
    sums = ranged.groupBy(*keys, "_range").agg(F.sum(weight).alias("_sum"))  # at most `parts` rows for each group
    group = Window.partitionBy(*keys)
    below = F.coalesce(F.sum("_sum").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sums.select(*keys, "_range", below.alias("_below"), F.sum("_sum").over(group).alias("n"))
    within = F.sum(weight).over(Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("_within", within).join(bases, [*keys, "_range"]).withColumn("upto", F.col("_below") + F.col("_within")).drop("_range", "_below", "_within")


def average_rank(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """df with rank_avg and n: ties share the mean of their ranks. Rows without a value go.

    Values are counted first; ranks come from running sums over distinct values."""
    known = df.where(F.col(value).isNotNull())
    counts = known.groupBy(*keys, value).agg(F.count("*").alias("ties"))
    ranked = running(counts, keys, value, "ties").select(*keys, value, (F.col("upto") - (F.col("ties") - 1) / 2).alias("rank_avg"), "n")
    return known.join(ranked, [*keys, value])


def percentiles(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys and a column for each share: exact percentiles, linear between neighbours, over non-null values.

    Values are counted first, so a group's work grows with its distinct values and is dealt out by range."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("ties"))
    placed = running(counts, keys, value, "ties")
    before = F.col("upto") - F.col("ties")

    def at(share: float) -> Column:
        spot = share * (F.col("n") - 1)
        low, high = F.floor(spot), F.least(F.floor(spot) + 1, F.col("n") - 1)
        value_at = lambda k: F.max(F.when(before <= k, F.col(value)))
        return value_at(low) + (value_at(high) - value_at(low)) * F.max(spot - low)

    return placed.groupBy(*keys).agg(*(at(share).alias(name) for name, share in shares.items()))


def centred(df: DataFrame, date: str, days: int = 2) -> DataFrame:
    """df once for each target date within `days` of its own: an equi-joinable form of the range join."""
    return df.withColumn("target", F.explode(F.sequence(F.date_sub(date, days), F.date_add(date, days))))


def dominant(df: DataFrame, keys: Sequence[str], code: str) -> DataFrame:
    """keys, code, n: the most frequent code of each group, ties going to the largest."""
    counts = df.groupBy(*keys, code).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.max(F.struct("n", code)).alias("s")).select(*keys, f"s.{code}", "s.n")


def percent_change(a: Column, b: Column) -> Column:
    return F.when(F.abs(b) > 0, 100 * (a - b) / F.abs(b))
