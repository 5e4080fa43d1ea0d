"""Checks of climatology states: decades against the full period, and what must hold of every state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dewfall.functions import calendar
from dewfall.operators import moments


def merge_differences(states: DataFrame) -> DataFrame:
    """(variable, level, keys, n, off): decades merged again against the full period, over every key; differences beyond 1e-9 of their size are counted."""
    keys = ["slot", "level_bin", "cy", "cx", "variable"]
    again = moments.merge_moments(states.where("period <> 'FULL'"), keys)
    both = again.join(states.where("period = 'FULL'").select(*keys, *(F.col(c).alias(f"full_{c}") for c in ("n", "mean", "m2", "low", "high"))), keys, "full")
    size = F.col("n") * F.col("mean") * F.col("mean") + F.col("m2")
    off = (
        (F.abs(F.col("mean") - F.col("full_mean")) > 1e-9 * F.abs("mean")) | (F.abs(F.col("m2") - F.col("full_m2")) > 1e-9 * size)
        | ~F.col("n").eqNullSafe(F.col("full_n")) | (F.col("low") != F.col("full_low")) | (F.col("high") != F.col("full_high"))
    )
    level = F.when(F.col("level_bin") == 0, "L1").when(F.col("level_bin") < 9, "L2").otherwise("L3")
    return both.groupBy("variable", level.alias("level")).agg(F.count("*").alias("keys"), F.sum("n").alias("n"), F.count_if(F.coalesce(off, F.lit(True))).alias("off"))


def broken_invariants(states: DataFrame) -> DataFrame:
    """(check, broken): how many keys break each of what must hold of states."""
    per = lambda c, name: c.agg(F.count("*").alias("broken")).select(F.lit(name).alias("check"), "broken")
    order = per(states.where("low > high or mean < low - 1e-9 * abs(low) or mean > high + 1e-9 * abs(high)"), "mean between extremes")
    reserved = per(states.where(F.col("slot") == calendar.RESERVED), "reserved slot empty")
    negative = per(states.where("m2 < 0 or m4 < 0 or n <= 0"), "even moments not negative")
    level = F.when(F.col("level_bin") == 0, "a").when(F.col("level_bin") < 9, "b").otherwise("c")
    sums = states.withColumn("l", level).groupBy("period", "slot", "cy", "cx", "variable").pivot("l", ["a", "b", "c"]).agg(F.sum("n"))
    levels = per(sums.where("a is distinct from b or b is distinct from c"), "levels agree in n")
    return order.unionByName(reserved).unionByName(negative).unionByName(levels)


def verdict(checks: DataFrame) -> DataFrame:
    """checks with PASS or FAIL."""
    return checks.withColumn("verdict", F.when(F.col("broken") == 0, "PASS").otherwise("FAIL"))
