"""A climatology from three input tables: one configuration, and the steps validate, run, audit, merge-audit and report over it.

An input is a Parquet folder of hourly values (ts timestamp, cy int, cx int, value double), as files of a grid become when they are read. Steps can be repeated:
a run goes on after the years that are in the store, a year is one commit."""

from __future__ import annotations

import calendar as months
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dewfall.functions import calendar, physics
from dewfall.operators import audits
from dewfall.sources import triplets
from dewfall.sources.states import StateStore, delete_folder, scratch

INPUTS = ("t2m", "d2m", "sp")


@dataclass(frozen=True)
class Config:
    """Where inputs, states and products are, the years, units, and the number of buckets that a year's inputs are stored in."""

    t2m: str
    d2m: str
    sp: str
    store: str
    output: str
    # The climatology's years.
    first_year: int = 1981
    last_year: int = 2020
    temperature_units: str = "K"
    pressure_units: str = "Pa"
    buckets: int = 64

    def __post_init__(self) -> None:
        if self.first_year > self.last_year:
            raise ValueError("first_year is after last_year")
        if self.buckets < 1:
            raise ValueError("buckets must be positive")

    def states(self, spark: SparkSession) -> StateStore:
        """The store; what changes its numbers is its configuration, years and folders are not."""
        return StateStore(spark, self.store, {k: v for k, v in asdict(self).items() if k.endswith("units")})


def year_of(spark: SparkSession, config: Config, name: str, year: int) -> DataFrame:
    """(cy, cx, d, h, x) of an input's year: the range is a filter on ts, so that files and row groups of other years are not read."""
    raw = spark.read.parquet(getattr(config, name)).where((F.col("ts") >= F.make_timestamp_ltz(F.lit(year), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))) & (F.col("ts") < F.make_timestamp_ltz(F.lit(year + 1), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))))
    return raw.select("cy", "cx", F.to_date("ts").alias("d"), F.hour("ts").alias("h"), F.col("value").cast("double").alias("x"))


def validate(spark: SparkSession, config: Config, year: int) -> DataFrame:
    """(check, broken, verdict) of a year's inputs: every cell has every hour of the year, none twice, and all three have the same hours. Nothing is written that stays."""
    due = 24 * (366 if months.isleap(year) else 365)
    folder, names, checks = scratch(spark, "validate"), [], None
    for name in INPUTS:
        own = year_of(spark, config, name, year)
        cells = own.groupBy("cy", "cx", "d", "h").agg(F.count("*").alias("n")).groupBy("cy", "cx").agg(F.count("*").alias("hours"), F.count_if(F.col("n") > 1).alias("twice"))
        told = cells.agg(F.count_if(F.col("hours") < due).alias("short"), F.coalesce(F.sum("twice"), F.lit(0)).alias("twice"))
        rows = told.select(F.inline(F.array(*(F.struct(F.lit(f"{name}: {says}").alias("check"), F.col(c).alias("broken")) for c, says in (("short", "cells short of hours"), ("twice", "hours that come twice"))))))
        checks = rows if checks is None else checks.unionByName(rows)
        names.append(f"{name}_{folder.rpartition('-')[2]}")
        triplets.store_input(own.dropDuplicates(["cy", "cx", "d", "h"]), names[-1], folder, config.buckets)
    gaps = triplets.alignment_report(spark, names).withColumn("input", F.substring_index("input", "_", 1))
    apart = gaps.groupBy("input").agg(F.sum(F.col("missing") + F.col("extra")).alias("broken"))
    others = spark.createDataFrame([(n,) for n in INPUTS[1:]], "input string").join(apart, "input", "left")
    both = checks.unionByName(others.select(F.concat("input", F.lit(": hours apart from t2m")).alias("check"), F.coalesce("broken", F.lit(0)).alias("broken")))
    out = spark.createDataFrame(audits.verdict(both).collect(), "check string, broken long, verdict string")  # eight rows
    _drop(spark, names, folder)
    return out


def _drop(spark: SparkSession, names: list[str], folder: str) -> None:
    for name in names:
        spark.sql(f"DROP TABLE {name}")
    delete_folder(spark, folder)


def run(spark: SparkSession, config: Config) -> list[int]:
    """Commit every year that the store lacks: inputs aligned strictly, converted, and summed up; the years that were added. A year without rows is passed over."""
    store, added = config.states(spark), []
    done = {r.y for r in store.ledger().select(F.year("d").alias("y")).distinct().collect()}  # one for each year
    for year in range(config.first_year, config.last_year + 1):
        if year in done:
            continue
        folder, names = scratch(spark, "inputs"), []
        for name in INPUTS:
            names.append(f"{name}_{folder.rpartition('-')[2]}")
            triplets.store_input(year_of(spark, config, name, year), names[-1], folder, config.buckets)
        units = {"t": physics.temperature_celsius, "td": physics.temperature_celsius, "p": physics.pressure_hpa}
        of = lambda c: units[c](F.col(c), F.lit(config.pressure_units if c == "p" else config.temperature_units)).alias(c)
        obs = triplets.aligned(spark, names).select("cy", "cx", "d", "h", *(of(c) for c in units))
        if store.commit(physics.with_moisture(obs).withColumn("slot", calendar.slot(F.col("d"))), f"year-{year}"):
            added.append(year)
        _drop(spark, names, folder)
    return added


def audit(spark: SparkSession, config: Config) -> DataFrame:
    """(check, broken, verdict) of the stored states."""
    return audits.verdict(audits.broken_invariants(config.states(spark).merged()))


def merge_audit(spark: SparkSession, config: Config) -> DataFrame:
    """(variable, level, keys, n, off) of decades against the full period."""
    return audits.merge_differences(config.states(spark).merged())


def report(spark: SparkSession, config: Config) -> dict:
    """Products and summary into the output folder; what the store holds."""
    store = config.states(spark)
    store.finish(config.output)
    return store.manifest()
