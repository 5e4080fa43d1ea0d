"""The 366-slot climatological calendar. Slot 59 is reserved, slot 60 holds both Feb 28 and Feb 29."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RESERVED = 59


def slot(d: Column) -> Column:
    doy, year = F.dayofyear(d), F.year(d)
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    return F.when((F.month(d) == 2) & (F.day(d) >= 28), 60).when(doy < 59, doy).otherwise(doy + F.when(leap, 0).otherwise(1))


def decade_start(d: Column) -> Column:
    """First year of the decade that d is in: 1991 for 1991 to 2000."""
    return (F.floor((F.year(d) - 1) / 10) * 10 + 1).cast("int")


def calendar(spark: SparkSession) -> DataFrame:
    """(slot, month, day, label, reserved) for the 366 slots."""
    dates = spark.range(365).select(F.date_add(F.lit("2001-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    days = dates.select(
        slot(F.col("d")).alias("slot"),
        F.month("d").alias("month"),
        F.day("d").alias("day"),
        F.when((F.month("d") == 2) & (F.day("d") == 28), "Feb-28/Feb-29").otherwise(F.date_format("d", "MMM-dd")).alias("label"),
        F.lit(0).alias("reserved"),
    )
    return days.unionByName(spark.sql(f"SELECT {RESERVED} AS slot, -1 AS month, -1 AS day, 'RESERVED' AS label, 1 AS reserved"))
