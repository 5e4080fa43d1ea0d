"""The three inputs of moisture (temperature, dew point, pressure) as stored day slabs, and their strict alignment.

An input is stored with a row for each cell and day: its hours in order, and a value for each. The tables are bucketed by cell and day
into the same number of buckets, so that they join where they lie, without an exchange, however many days they hold. Alignment is strict both ways: a
day, or an hour of a day, that one input has and another lacks is an error that names it; a null value is none.

Before it is stored an input is turned to the reference's axes: an axis that equals the reference's within TOLERANCE takes its places, a reversed one is flipped,
anything else is an error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Coordinates that differ by no more are the same.
TOLERANCE = 1e-6
CELL_DAY = ("cy", "cx", "d")


def axis_relations(axes: DataFrame, reference: str) -> DataFrame:
    """(grid, n, relation, monotonic) for axes(grid, k, value), places k from 0: exact, reversed or mismatch against the reference's axis, and whether values strictly rise or fall.

    Axes are compared place by place; one of another length is a mismatch. A null or repeated coordinate breaks monotony."""
    size = axes.groupBy("grid").agg(F.count("*").alias("n"))
    ref = axes.where(F.col("grid") == reference).select(F.col("k").alias("ref_k"), F.col("value").alias("ref"))
    length = size.where(F.col("grid") == reference).select(F.col("n").alias("ref_n"))
    placed = axes.join(F.broadcast(size), "grid").join(F.broadcast(length))  # a row for each grid, and one row
    close = F.coalesce(F.abs(F.col("value") - F.col("ref")) <= TOLERANCE, F.lit(False)) & (F.col("n") == F.col("ref_n"))
    # each place meets the reference's at k and at n - 1 - k
    ends = F.array(F.struct(F.lit(True).alias("ahead"), F.col("k").alias("at")), F.struct(F.lit(False).alias("ahead"), (F.col("n") - 1 - F.col("k")).alias("at")))
    both = placed.withColumn("e", F.explode(ends)).join(ref, F.col("e.at") == F.col("ref_k"), "left")
    told = both.groupBy("grid").agg(F.first("n").alias("n"), F.bool_and(close | ~F.col("e.ahead")).alias("same"), F.bool_and(close | F.col("e.ahead")).alias("turned"))
    before = F.lag("value").over(Window.partitionBy("grid").orderBy("k"))  # an axis is a few thousand places
    step = axes.select("grid", (F.col("value") - before).alias("step"), F.col("value").isNull().alias("gone"))
    rises, falls = (F.bool_and(F.coalesce(c, F.lit(True))) for c in (F.col("step") > 0, F.col("step") < 0))
    monotonic = step.groupBy("grid").agg(((rises | falls) & ~F.bool_or("gone")).alias("monotonic"))
    relation = F.when(F.col("same"), "exact").when(F.col("turned"), "reversed").otherwise("mismatch")
    return told.join(monotonic, "grid").select("grid", "n", relation.alias("relation"), "monotonic")


def turned(values: DataFrame, relations: DataFrame, grid: str, place: str = "cx") -> DataFrame:
    """values with `place` counted along the reference's axis; an error if the grid's axis is not monotonic, or neither the reference's nor its reverse."""
    # the relation of one grid: one row
    one = relations.where(F.col("grid") == grid).select(F.col("n").alias("_n"), F.col("relation").alias("_relation"), F.col("monotonic").alias("_monotonic"))
    bad = ~F.col("_monotonic") | (F.col("_relation") == "mismatch")
    note = F.concat(F.lit(f"the axis of {grid} is "), F.when(~F.col("_monotonic"), "not monotonic").otherwise("not the reference's"))
    at = F.when(bad, F.raise_error(note).cast("int")).when(F.col("_relation") == "reversed", F.col("_n") - 1 - F.col(place)).otherwise(F.col(place))
    return values.join(F.broadcast(one)).withColumn(place, at.cast("int")).drop("_n", "_relation", "_monotonic")


def slabs(values: DataFrame) -> DataFrame:
    """(cy, cx, d, hours, x): a row for each cell and day of values(cy, cx, d, h, x), hours ascending; an hour given twice is an error."""
    days = values.groupBy(*CELL_DAY).agg(F.array_sort(F.collect_list(F.struct("h", "x"))).alias("s"))  # at most 24 to a day
    twice = F.size(F.array_distinct("s.h")) < F.size("s")
    note = F.concat(F.lit("an hour comes twice on "), F.col("d").cast("string"))
    return days.select(*CELL_DAY, F.when(twice, F.raise_error(note).cast("array<int>")).otherwise(F.col("s.h").cast("array<int>")).alias("hours"), F.col("s.x").alias("x"))


def store_input(values: DataFrame, name: str, folder: str, buckets: int) -> DataFrame:
    """slabs() of an input as a table bucketed and sorted by cell and day below folder; the table. One that is there under this name is replaced."""
    spark = values.sparkSession
    days = slabs(values).repartition(buckets, *CELL_DAY)  # one file to a bucket
    days.write.mode("overwrite").bucketBy(buckets, *CELL_DAY).sortBy(*CELL_DAY).option("path", f"{folder}/{name}").saveAsTable(name)
    return spark.table(name)


def joined(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """The stored inputs side by side: hours_k and x_k for each, null where an input lacks a day of the first one; then the days that another input alone has.

    Left and anti joins on the bucket columns keep the first input's partitioning (a full join would not), so there is no exchange."""
    keys, of = list(CELL_DAY), {}
    for k, name in enumerate(names):
        of[k] = spark.table(name).select(*CELL_DAY, F.col("hours").alias(f"hours_{k}"), F.col("x").alias(f"x_{k}"))
    out = of[0]
    for k in range(1, len(names)):
        out = out.join(of[k], keys, "left")
    for k in range(1, len(names)):
        out = out.unionByName(of[k].join(of[0].select(*CELL_DAY), keys, "left_anti"), allowMissingColumns=True)
    return out


def lacking(names: Sequence[str]) -> Column:
    """What a row of joined() lacks against the first input: (input, day, missing hours, extra hours) for each input that differs."""
    none = F.array().cast("array<int>")
    first = F.coalesce("hours_0", none)
    differences = []
    for k, name in enumerate(names[1:], 1):
        own = F.coalesce(f"hours_{k}", none)
        differences.append(F.struct(F.lit(name).alias("input"), F.array_except(first, own).alias("missing"), F.array_except(own, first).alias("extra")))
    return F.filter(F.array(*differences), lambda s: (F.size(s["missing"]) > 0) | (F.size(s["extra"]) > 0))


def alignment_report(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """(cy, cx, input, days, missing, extra): hours that an input lacks against the first one and that it alone has, and the days with any."""
    rows = joined(spark, names).select("cy", "cx", F.explode(lacking(names)).alias("s"))
    return rows.groupBy("cy", "cx", "s.input").agg(F.count("*").alias("days"), F.sum(F.size("s.missing")).alias("missing"), F.sum(F.size("s.extra")).alias("extra"))


def aligned(spark: SparkSession, names: Sequence[str], columns: Sequence[str] = ("t", "td", "p")) -> DataFrame:
    """(cy, cx, d, h, columns...): the inputs hour by hour; an error that names the input, cell, day and hours of a difference."""
    gaps = lacking(names)
    hours = lambda h: F.array_join(h.cast("array<string>"), ",")
    note = F.array_join(F.transform(gaps, lambda s: F.concat(s["input"], F.lit(" lacks hours ["), hours(s["missing"]), F.lit("] and adds ["), hours(s["extra"]), F.lit("]"))), "; ")
    place = F.concat(F.lit(" at cell "), F.col("cy").cast("string"), F.lit(","), F.col("cx").cast("string"), F.lit(" on "), F.col("d").cast("string"))
    held = F.when(F.size(gaps) > 0, F.raise_error(F.concat(note, place)).cast("array<int>")).otherwise(F.col("hours_0"))
    zipped = F.arrays_zip(held.alias("h"), *(F.col(f"x_{k}").alias(c) for k, c in enumerate(columns)))
    rows = joined(spark, names).select(*CELL_DAY, F.explode(zipped).alias("z"))
    return rows.select(*CELL_DAY, F.col("z.h").alias("h"), *(F.col(f"z.{c}").alias(c) for c in columns))
