"""Diagnostics of hourly fields: coverage, drops, steps, dominant values, events; and comparison tables of periods and codes.

Over the events table a variable is an event type and a cell a group of users; a value below 5 counts as not finite there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dewfall.functions import calendar
from dewfall.functions.physics import VARIABLES
from dewfall.jobs.climatology import CELL, moist
from dewfall.jobs.oracles import LONG, MOIST
from dewfall.operators import moments, windows
from dewfall.sources.observations import observations, table

CELLS = 8
LEAST = 5.0


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(variable, hour, cell, x): x is null where the value is masked."""
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("event_type").alias("variable"), F.date_trunc("hour", "ts").alias("hour"), (F.col("user_id") % CELLS).cast("int").alias("cell"), F.when(F.col("value") >= LEAST, F.col("value")).alias("x"))


def hourly_finite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per variable and hour: values, finite ones, their share and extremes."""
    n, ok = F.count("*"), F.count("x")
    return fields(spark, sf_dir).groupBy("variable", "hour").agg(n.alias("total"), ok.alias("finite"), (n - ok).alias("nonfinite"), (100 * ok / n).alias("finite_pct"), F.min("x").alias("low"), F.max("x").alias("high"))


def _drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = hourly_finite(spark, sf_dir)
    median = windows.percentiles(hours, ["variable"], "finite_pct", {"median": 0.5})
    drop = F.when(F.col("median") > 0, 100 * (F.col("median") - F.col("finite_pct")) / F.col("median"))
    return hours.join(F.broadcast(median), "variable").withColumn("drop", drop)  # a row for each variable


def suspicious_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours whose finite share lies more than 0.05 % below the variable's median hour."""
    return _drops(spark, sf_dir).where("drop > 0.05").select("variable", "hour", "finite_pct", "median", "drop")


def daily_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per variable and day: hours, the range of finite shares, suspicious hours."""
    return _drops(spark, sf_dir).groupBy("variable", F.to_date("hour").alias("d")).agg(
        F.count("*").alias("hours"), F.min("finite_pct").alias("least"), F.avg("finite_pct").alias("mean"), F.max("finite_pct").alias("most"), F.count_if(F.col("drop") > 0.05).alias("suspicious")
    )


def bad_across(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours that are suspicious in several variables, with the names joined: the union of all variables' flags."""
    bad = suspicious_hours(spark, sf_dir).groupBy("hour").agg(F.count("*").alias("bad"), F.array_join(F.array_sort(F.collect_list("variable")), "|").alias("flags"))  # as many names as variables
    return bad.where("bad >= 2")


def flagged_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per cell and day: low, high and sparse flags joined by |, for days with any."""
    day = fields(spark, sf_dir).groupBy("cell", F.to_date("hour").alias("d")).agg(F.count("*").alias("n"), F.count("x").alias("ok"), F.min("x").alias("low"), F.max("x").alias("high"))
    flag = lambda c, name: F.when(c, name)
    flags = F.concat_ws("|", flag(F.col("low") < 6, "low"), flag(F.col("high") > 500, "high"), flag(F.col("ok") < 0.9 * F.col("n"), "sparse"))
    return day.select("cell", "d", "n", flags.alias("flags")).where("flags <> ''")


def dominant_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the most frequent rounded value among the finite ones of each variable and day; ties go to the larger value."""
    counts = fields(spark, sf_dir).where("x is not null").groupBy("variable", F.to_date("hour").alias("d"), F.round("x", 0).alias("value")).agg(F.count("*").alias("n"))
    best = counts.groupBy("variable", "d").agg(F.max(F.struct("n", "value")).alias("s"), F.sum("n").alias("finite"), F.count("*").alias("distinct"))
    return best.select("variable", "d", "finite", "distinct", F.col("s.value").alias("value"), (100 * F.col("s.n") / F.col("finite")).alias("share"))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One value for each variable, cell and hour, with the hours before and after where they are the neighbouring ones."""
    one = fields(spark, sf_dir).groupBy("variable", "cell", "hour").agg(F.round(F.avg("x"), 0).alias("v"))
    near = windows.neighbours(one.withColumn("s", F.struct("hour", "v")), ["variable", "cell"], "hour", "s")
    gap = lambda a, b: F.timestamp_diff("SECOND", a, b) == 3600
    return near.select(
        "variable", "cell", "hour", "v", F.when(gap(F.col("prev.hour"), F.col("hour")), F.col("prev.v")).alias("prev"), F.when(gap(F.col("hour"), F.col("next.hour")), F.col("next.v")).alias("next")
    )


def hour_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per variable and hour: cells with the hour before, how many of them are identical, mean and largest change."""
    both = _cells(spark, sf_dir).where("v is not null and prev is not null").withColumn("change", F.abs(F.col("v") - F.col("prev")))
    return both.groupBy("variable", "hour").agg(
        F.count("*").alias("cells"), (100 * F.count_if(F.col("change") == 0) / F.count("*")).alias("identical_pct"), F.avg("change").alias("mean_change"), F.max("change").alias("max_change")
    )


def event_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours by how many of their cells change by more than 2, 8 and 15: extensive, large, regional or local."""
    both = _cells(spark, sf_dir).where("v is not null and prev is not null").withColumn("change", F.abs(F.col("v") - F.col("prev")))
    share = lambda k: (100 * F.count_if(F.col("change") > k) / F.count("*")).alias(f"p{k}")
    hours = both.groupBy("variable", "hour").agg(F.count("*").alias("cells"), share(2), share(8), share(15))
    kind = F.when(F.col("p15") > 20, "extensive").when(F.col("p8") > 10, "large").when(F.col("p8") > 1, "regional").otherwise("local")
    return hours.withColumn("kind", kind)


def largest_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest changes against the hour before, with their place; ties by variable, cell and hour."""
    both = _cells(spark, sf_dir).where("v is not null and prev is not null")
    change = F.abs(F.col("v") - F.col("prev"))
    return both.select("variable", "cell", "hour", "prev", "v", change.alias("change")).orderBy(F.desc("change"), "variable", "cell", "hour").limit(10)


# Names of the codes that dominance reports show.
NAMES = {1: "Normal", 2: "SkewNormal", 3: "PearsonIII", 4: "Beta", 5: "BimodalNormal", 6: "Gaussian", 7: "Clayton"}


def slot_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each named code among the observations of a slot."""
    names = spark.createDataFrame(sorted(NAMES.items()), "code int, name string")
    counts = observations(spark, sf_dir).groupBy(calendar.slot(F.col("d")).alias("slot"), "code").agg(F.count("*").alias("n"))
    named = counts.join(F.broadcast(names), "code", "left")  # a fixed list
    return named.select("slot", F.coalesce("name", F.concat(F.lit("code "), F.col("code").cast("string"))).alias("name"), "n", (F.col("n") / F.sum("n").over(Window.partitionBy("slot"))).alias("share"))


def names_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same names read back from a JSON object, with each code's observations and parameters as JSON in order of key."""
    text = '{"1": "Normal", "2": "SkewNormal", "3": "PearsonIII", "4": "Beta", "5": "BimodalNormal", "6": "Gaussian", "7": "Clayton"}'
    names = spark.range(1).select(F.explode(F.from_json(F.lit(text), "map<string,string>")).alias("code", "name"))
    counts = observations(spark, sf_dir).groupBy("code").agg(F.count("*").alias("n"), F.min("d").alias("first"))
    both = counts.join(F.broadcast(names.withColumn("code", F.col("code").cast("int"))), "code")
    told = F.to_json(F.struct(F.date_format("first", "yyyy-MM-dd").alias("first"), "n", "name"))
    return both.select("code", "name", told.alias("json"), F.sha2(told, 256).alias("sha256"))


def winner_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each code wins a month and cell, and its share of all."""
    won = windows.dominant(observations(spark, sf_dir).withColumn("month", F.month("d")), ["month", "cy", "cx"], "code")
    counts = won.groupBy("code").agg(F.count("*").alias("wins"))
    total = counts.agg(F.sum("wins").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("code", "wins", (F.col("wins") / F.col("total")).alias("share"))  # one row


def change_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted mean, minimum and maximum of cell means per variable and level: base and latest decade, their change, and the full period."""
    df = moments.long_form(moist(spark, sf_dir).withColumn("decade", calendar.decade_start(F.col("d"))), ["decade", *CELL, "h"], VARIABLES)
    hours = df.groupBy("decade", *CELL, "h", "variable").agg(F.count("x").alias("n"), F.sum("x").alias("s")).where("n > 0")
    bins = F.array(F.struct(F.lit("L1").alias("level"), F.lit(0).alias("level_bin")), F.struct(F.lit("L2").alias("level"), (1 + F.floor(F.col("h") / 3)).cast("int").alias("level_bin")))
    of = hours.select("decade", *CELL, "variable", F.explode(bins).alias("b"), "n", "s").select("decade", *CELL, "variable", "b.*", "n", "s")
    periods = of.withColumn("period", F.explode(F.array(F.col("decade").cast("string"), F.lit("FULL"))))
    cells = periods.groupBy("period", *CELL, "variable", "level", "level_bin").agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("mean"))
    domain = cells.groupBy("period", "variable", "level").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("weighted_mean"), F.min("mean").alias("min"), F.max("mean").alias("max"), F.count("*").alias("cells"), F.sum("n").alias("support"))
    metrics = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("weighted_mean", "min", "max")))
    long = domain.select("period", "variable", "level", "cells", "support", F.explode(metrics).alias("m")).select("period", "variable", "level", "cells", "support", "m.*")
    at = lambda p, c="value": F.max(F.when(F.col("period") == p, F.col(c)))
    out = long.groupBy("variable", "level", "metric").agg(at("1991").alias("base"), at("2001").alias("latest"), at("FULL").alias("full"), at("FULL", "cells").alias("cells"), at("FULL", "support").alias("support"))
    return out.withColumns({"change": F.col("latest") - F.col("base"), "percent": windows.percent_change(F.col("latest"), F.col("base"))})


def change_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percent change of the latest against the base decade per slot, cell and variable, where both have values."""
    df = moments.long_form(moist(spark, sf_dir).withColumn("decade", calendar.decade_start(F.col("d"))), ["decade", *CELL], VARIABLES)
    cells = df.groupBy(*CELL, "variable").pivot("decade", [1991, 2001]).agg(F.avg("x"))
    both = cells.where("`1991` is not null and `2001` is not null")
    return both.select(*CELL, "variable", F.col("1991").alias("base"), F.col("2001").alias("latest"), windows.percent_change(F.col("2001"), F.col("1991")).alias("percent"))


def robust_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extremes, mean, population deviation, exact median and distinct values of temperature by month."""
    obs = observations(spark, sf_dir).select(F.month("d").alias("month"), "t").where("t is not null")
    plain = obs.groupBy("month").agg(F.min("t").alias("low"), F.max("t").alias("high"), F.avg("t").alias("mean"), F.stddev_pop("t").alias("std"))
    values = obs.groupBy("month", "t").agg(F.count("*").alias("ties")).groupBy("month").agg(F.count("t").alias("distinct"))
    return plain.join(windows.percentiles(obs, ["month"], "t", {"median": 0.5}), "month").join(values, "month")


_F = f"f AS (SELECT event_type AS variable, date_trunc('hour', ts) AS hour, CAST(user_id % {CELLS} AS INTEGER) AS cell, CASE WHEN value >= {LEAST} THEN value END AS x FROM events)"
_H = f"{_F}, h AS (SELECT variable, hour, count(*) AS total, count(x) AS finite, count(*) - count(x) AS nonfinite, 100 * count(x) / count(*) AS finite_pct, min(x) AS low, max(x) AS high FROM f GROUP BY variable, hour)"
_D = f"{_H}, m AS (SELECT variable, median(finite_pct) AS median FROM h GROUP BY variable), dr AS (SELECT h.*, median, CASE WHEN median > 0 THEN 100 * (median - finite_pct) / median END AS drop FROM h JOIN m USING (variable))"
_C = f"""{_F}, one AS (SELECT variable, cell, hour, round(avg(x), 0) AS v FROM f GROUP BY ALL),
w AS (SELECT a.*, b.v AS prev, c.v AS next FROM one a LEFT JOIN one b ON a.variable = b.variable AND a.cell = b.cell AND b.hour = a.hour - INTERVAL 1 HOUR LEFT JOIN one c ON a.variable = c.variable AND a.cell = c.cell AND c.hour = a.hour + INTERVAL 1 HOUR),
g AS (SELECT *, abs(v - prev) AS change FROM w WHERE v IS NOT NULL AND prev IS NOT NULL)"""
_NAMES = "nm(code, name) AS (VALUES (1, 'Normal'), (2, 'SkewNormal'), (3, 'PearsonIII'), (4, 'Beta'), (5, 'BimodalNormal'), (6, 'Gaussian'), (7, 'Clayton'))"
SQL: dict[str, str] = {
    "hourly_finite": f"WITH {_H} SELECT * FROM h",
    "suspicious_hours": f"WITH {_D} SELECT variable, hour, finite_pct, median, drop FROM dr WHERE drop > 0.05",
    "daily_summary": f"WITH {_D} SELECT variable, CAST(hour AS DATE) AS d, count(*) AS hours, min(finite_pct) AS least, avg(finite_pct) AS mean, max(finite_pct) AS most, count(*) FILTER (drop > 0.05) AS suspicious FROM dr GROUP BY 1, 2",
    "bad_across": f"WITH {_D} SELECT hour, count(*) AS bad, string_agg(variable, '|' ORDER BY variable) AS flags FROM dr WHERE drop > 0.05 GROUP BY hour HAVING count(*) >= 2",
    "flagged_cells": f"""WITH {_F}, g AS (SELECT cell, CAST(hour AS DATE) AS d, count(*) AS n, count(x) AS ok, min(x) AS low, max(x) AS high FROM f GROUP BY 1, 2),
k AS (SELECT cell, d, n, concat_ws('|', CASE WHEN low < 6 THEN 'low' END, CASE WHEN high > 500 THEN 'high' END, CASE WHEN ok < 0.9::DOUBLE * n THEN 'sparse' END) AS flags FROM g) SELECT * FROM k WHERE flags <> ''""",
    "dominant_value": f"""WITH {_F}, c AS (SELECT variable, CAST(hour AS DATE) AS d, round(x, 0) AS value, count(*) AS n FROM f WHERE x IS NOT NULL GROUP BY ALL)
SELECT variable, d, CAST(sum(n) AS BIGINT) AS finite, count(*) AS distinct, arg_max(value, n * 1e9 + value) AS value, 100 * max(n) / sum(n) AS share FROM c GROUP BY variable, d""",
    "hour_changes": f"WITH {_C} SELECT variable, hour, count(*) AS cells, 100 * count(*) FILTER (change = 0) / count(*) AS identical_pct, avg(change) AS mean_change, max(change) AS max_change FROM g GROUP BY variable, hour",
    "event_classes": f"""WITH {_C}, p AS (SELECT variable, hour, count(*) AS cells, 100 * count(*) FILTER (change > 2) / count(*) AS p2, 100 * count(*) FILTER (change > 8) / count(*) AS p8, 100 * count(*) FILTER (change > 15) / count(*) AS p15 FROM g GROUP BY variable, hour)
SELECT *, CASE WHEN p15 > 20 THEN 'extensive' WHEN p8 > 10 THEN 'large' WHEN p8 > 1 THEN 'regional' ELSE 'local' END AS kind FROM p""",
    "largest_changes": f"WITH {_C} SELECT variable, cell, hour, prev, v, change FROM g ORDER BY change DESC, variable, cell, hour LIMIT 10",
    "slot_shares": f"""WITH {MOIST}, {_NAMES}, c AS (SELECT slot, code, count(*) AS n FROM ep GROUP BY slot, code)
SELECT CAST(slot AS INTEGER) AS slot, coalesce(name, 'code ' || c.code) AS name, n, n / sum(n) OVER (PARTITION BY slot) AS share FROM c LEFT JOIN nm ON c.code = nm.code""",
    "names_json": f"""WITH {MOIST}, {_NAMES}, c AS (SELECT code, count(*) AS n, min(d) AS first FROM obs GROUP BY code),
j AS (SELECT c.code, name, '{{"first":"' || strftime(first, '%Y-%m-%d') || '","n":' || n || ',"name":"' || name || '"}}' AS json FROM c JOIN nm ON c.code = nm.code) SELECT *, sha256(json) AS sha256 FROM j""",
    "winner_counts": f"""WITH {MOIST}, c AS (SELECT month(d) AS month, cy, cx, code, count(*) AS n FROM obs GROUP BY ALL), w AS (SELECT code FROM c QUALIFY row_number() OVER (PARTITION BY month, cy, cx ORDER BY n DESC, code DESC) = 1)
SELECT code, count(*) AS wins, count(*) / sum(count(*)) OVER () AS share FROM w GROUP BY code""",
    "change_table": f"""WITH {MOIST}{LONG}, b AS (SELECT *, unnest(['L1', 'L2']) AS level, unnest([0, 1 + h // 3]) AS level_bin FROM long), pd AS (SELECT *, unnest([decade::VARCHAR, 'FULL']) AS period FROM b),
c AS (SELECT period, slot, cy, cx, variable, level, level_bin, count(x) AS n, avg(x) AS mean FROM pd GROUP BY ALL HAVING count(x) > 0),
dm AS (SELECT period, variable, level, sum(n * mean) / sum(n) AS weighted_mean, min(mean) AS min, max(mean) AS max, count(*) AS cells, CAST(sum(n) AS BIGINT) AS support FROM c GROUP BY ALL),
l AS (SELECT period, variable, level, cells, support, unnest(['weighted_mean', 'min', 'max']) AS metric, unnest([weighted_mean, min, max]) AS value FROM dm),
o AS (SELECT variable, level, metric, max(value) FILTER (period = '1991') AS base, max(value) FILTER (period = '2001') AS latest, max(value) FILTER (period = 'FULL') AS full, max(cells) FILTER (period = 'FULL') AS cells, max(support) FILTER (period = 'FULL') AS support FROM l GROUP BY ALL)
SELECT variable, level, metric, base, latest, "full", cells, support, latest - base AS change, CASE WHEN abs(base) > 0 THEN 100 * (latest - base) / abs(base) END AS percent FROM o""",
    "change_map": f"""WITH {MOIST}{LONG}, c AS (SELECT slot, cy, cx, variable, avg(x) FILTER (decade = 1991) AS base, avg(x) FILTER (decade = 2001) AS latest FROM long GROUP BY ALL)
SELECT *, CASE WHEN abs(base) > 0 THEN 100 * (latest - base) / abs(base) END AS percent FROM c WHERE base IS NOT NULL AND latest IS NOT NULL""",
    "robust_statistics": f"WITH {MOIST} SELECT CAST(month(d) AS INTEGER) AS month, min(t) AS low, max(t) AS high, avg(t) AS mean, stddev_pop(t) AS std, median(t) AS median, count(DISTINCT t) AS distinct FROM obs WHERE t IS NOT NULL GROUP BY 1",
}
