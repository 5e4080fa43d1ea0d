"""The registered jobs over the observation view and the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dewfall.functions import calendar
from dewfall.functions.physics import VARIABLES, with_moisture
from dewfall.operators import moments, windows
from dewfall.sources.observations import observations, table

CELL = ("slot", "cy", "cx")


def moist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_moisture(observations(spark, sf_dir)).withColumn("slot", calendar.slot(F.col("d")))


def _levels(df: DataFrame) -> DataFrame:
    """Each row under level bins 0 (day), 1 to 8 (three hours) and 9 to 32 (hour)."""
    return df.withColumn("level_bin", F.explode(F.array(F.lit(0), (1 + F.floor(F.col("h") / 3)).cast("int"), F.col("h") + 9)))


def moments_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = moist(spark, sf_dir).groupBy(*CELL).agg(*moments.moment_state("rh")).withColumn("variable", F.lit("rh"))
    return states.select(*CELL, "n", "missing", *moments.scale_free(), *moments.shown_sums())


def moments_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return level_states(spark, sf_dir).select(*CELL, "level_bin", "variable", "n", *moments.scale_free(), *moments.shown_sums())


def shared_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of all variables over the rows that have all four (P8), and how many more rows each has by itself."""
    df = moist(spark, sf_dir)
    whole = F.lit(True)
    for v in VARIABLES:
        whole = whole & F.col(v).isNotNull()
    kept = df.select(*CELL, *VARIABLES, *(F.when(whole, F.col(v)).alias(f"{v}_kept") for v in VARIABLES))
    # one pass: a state of each variable under the mask beside the count without it
    states = [F.struct(*moments.moment_state(f"{v}_kept"), F.count(v).alias("n_own")).alias(v) for v in VARIABLES]
    rows = moments.stacked(kept.groupBy(*CELL).agg(*states), CELL, VARIABLES)
    return rows.select(*CELL, "variable", "n", "missing", (F.col("n_own") - F.col("n")).alias("left_out"), *moments.scale_free(), *moments.shown_sums())


def level_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of all variables at the three levels: hours are aggregated once, coarser levels merged from them."""
    wide = moist(spark, sf_dir).groupBy(*CELL, "h").agg(*moments.wide_states(VARIABLES))
    hours = moments.stacked(wide, [*CELL, "h"], VARIABLES)
    return moments.merge_moments(_levels(hours), [*CELL, "level_bin", "variable"])


def decades_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-period products from decade states."""
    wide = moist(spark, sf_dir).withColumn("decade", calendar.decade_start(F.col("d"))).groupBy("decade", *CELL).agg(*moments.wide_states(VARIABLES))
    parts = moments.stacked(wide, ["decade", *CELL], VARIABLES)
    done = moments.merge_moments(parts, [*CELL, "variable"]).select(*CELL, "variable", "n", "mean", *moments.finalized())
    return done.select(*CELL, "variable", "n", *((F.round(c, 9 if c in ("mean", "std") else 6) + 0.0).alias(c) for c in ("mean", "std", "skew", "kurt")))


def thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [F.count_if(F.col(v) > t).alias(f"{v}_over_{k}") for v, ts in moments.THRESHOLDS.items() for k, t in enumerate(ts)]
    joint = F.count_if((F.col("rh") > 90) & (F.col("q") > 0.012)).alias("rh90_q012")
    return moist(spark, sf_dir).groupBy(*CELL).agg(*counts, joint, F.count_if("supersat").alias("n_supersat"), F.count_if("bad_ep").alias("n_bad_ep"))


def pair_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of relative and specific humidity over each day of the calendar."""
    state = moist(spark, sf_dir).groupBy(*CELL).agg(*moments.pair_state("rh", "q"))
    return state.where("n > 0").select("*", *moments.pair_products())


def binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell, hour and the bins of relative and specific humidity, null out of range.

    Both values leave the physics through inline(), which no rule moves expressions across: bins name them several times, and
    every mention would carry the whole physics with it."""
    values = moist(spark, sf_dir).select(*CELL, "h", F.inline(F.array(F.struct("rh", "q"))))
    return values.select(*CELL, "h", moments.bin_of(F.col("rh"), *moments.RH_RANGE).alias("xb"), moments.bin_of(F.col("q"), *moments.Q_RANGE).alias("yb"))


def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by bins over all days."""
    return binned(spark, sf_dir).where("xb is not null and yb is not null").groupBy("cy", "cx", "xb", "yb").agg(F.count("*").alias("n"))


def triplet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner alignment of temperature, dew point and pressure tables on cell and hour, with keys that lack a partner counted."""
    obs, keys = observations(spark, sf_dir), ["cy", "cx", "d", "h"]
    one = lambda c: obs.where(F.col(c).isNotNull()).groupBy(*keys).agg(F.avg(c).alias(c))
    both = one("t").join(one("td"), keys, "full").join(one("p"), keys, "full")
    whole = F.col("t").isNotNull() & F.col("td").isNotNull() & F.col("p").isNotNull()
    return both.groupBy("cy", "cx").agg(
        F.count_if(whole).alias("aligned"), F.count_if(F.col("td").isNull()).alias("no_td"), F.count_if(F.col("p").isNull()).alias("no_p"), F.avg(F.when(whole, F.col("td") - F.col("p"))).alias("mean_gap")
    )


def centred_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-day windows per cell; days are aggregated before they are repeated for their targets."""
    days = moist(spark, sf_dir).groupBy("cy", "cx", "d").agg(F.count("rh").alias("n"), F.sum("rh").alias("s"))
    near = windows.centred(days, "d").groupBy("cy", "cx", "target").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.count("*").alias("days"))
    own = days.select("cy", "cx", F.col("d").alias("target"))
    return near.join(own, ["cy", "cx", "target"]).select("cy", "cx", "target", "n", (F.col("s") / F.col("n")).alias("mean_rh"), (F.col("days") / 5).alias("completeness"))


def _window_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per cell and day: values, their sum, and the distinct hours that have one."""
    return moist(spark, sf_dir).where("rh is not null").groupBy("cy", "cx", "d").agg(F.count("rh").alias("n"), F.sum("rh").alias("s"), F.count_distinct("h").alias("hours"))


def window_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-day windows around every day of a cell, complete by available over expected hours (A35); without a value, 0."""
    sums = [F.sum(c).alias(c) for c in ("n", "s", "hours")]
    near = windows.centred(_window_days(spark, sf_dir), "d").groupBy("cy", "cx", "target").agg(*sums)
    own = observations(spark, sf_dir).select("cy", "cx", F.col("d").alias("target")).distinct()
    n, hours = F.coalesce("n", F.lit(0)), F.coalesce("hours", F.lit(0))
    return own.join(near, ["cy", "cx", "target"], "left").select("cy", "cx", "target", n.alias("n"), (F.col("s") / F.col("n")).alias("mean_rh"), hours.alias("hours"), (hours / 120).alias("completeness"))


def window_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows pooled over years by the slot of their target (W10), over the targets that window_hours has."""
    w = window_hours(spark, sf_dir).withColumn("slot", calendar.slot(F.col("target")))
    pooled = w.groupBy(*CELL).agg(F.sum("n").alias("n"), (F.sum(F.col("mean_rh") * F.col("n")) / F.sum("n")).alias("mean_rh"), F.count("*").alias("windows"), F.sum("hours").alias("hours"))
    return pooled.withColumn("completeness", F.col("hours") / (120 * F.col("windows")))


def pseudo_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = moist(spark, sf_dir).select(F.month("d").alias("month"), "cy", "cx", "t")
    return windows.average_rank(df, ["month", "cy", "cx"], "t").select(
        "month", "cy", "cx", "t", "rank_avg", ((F.col("rank_avg") - 0.5) / F.col("n")).alias("u_engine"), (F.col("rank_avg") / (F.col("n") + 1)).alias("u_diagnostic")
    )


def normal_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal likelihood with its criteria per month, cell and variable, from 30 values on."""
    df = moments.long_form(moist(spark, sf_dir).withColumn("month", F.month("d")), ["month", "cy", "cx"], VARIABLES)
    fit = df.groupBy("month", "cy", "cx", "variable").agg(F.count("x").alias("n"), F.avg("x").alias("loc"), F.stddev_pop("x").alias("scale"))
    n, ll = F.col("n"), F.col("ll")
    fit = fit.where("n >= 30 and scale > 0").withColumn("ll", -n / 2 * (F.log(2 * F.pi() * F.col("scale") * F.col("scale")) + 1))
    return fit.withColumns({"aic": 4 - 2 * ll, "bic": 2 * F.log(n) - 2 * ll, "aicc": 4 - 2 * ll + 12 / (n - 3)})


def hourly_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes against the hour before and after in each event type: jumps, two-sided jumps, midpoint residuals."""
    hours = table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.avg("value").alias("v"))
    w = windows.neighbours(hours, ["event_type"], "hour", "v")
    back, ahead = F.abs(F.col("v") - F.col("prev")), F.abs(F.col("next") - F.col("v"))
    return w.groupBy("event_type").agg(
        F.count("*").alias("hours"),
        F.avg(back).alias("mean_step"),
        F.max(back).alias("max_step"),
        F.count_if((back > 5) & (ahead > 5)).alias("two_sided"),
        F.avg(F.abs(F.col("v") - (F.col("prev") + F.col("next")) / 2)).alias("mean_midpoint"),
    )


def missing_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours between an event type's first and last that have no event."""
    hours = table(spark, sf_dir, "events").select("event_type", F.date_trunc("hour", "ts").alias("hour")).distinct()
    span = hours.groupBy("event_type").agg(F.min("hour").alias("a"), F.max("hour").alias("b"))
    due = span.select("event_type", F.explode(F.expr("sequence(a, b, interval 1 hour)")).alias("hour"))
    return due.join(hours, ["event_type", "hour"], "left_anti")


def step_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir).where("td is not null").withColumn("gap", F.abs(F.col("t") - F.col("td")))
    over = [F.count_if(F.col("gap") > k).alias(f"over_{k}") for k in (2, 5, 8, 10, 15)]
    plain = obs.groupBy("cy", "cx").agg(F.avg("gap").alias("mean"), F.max("gap").alias("max"), *over)
    ranked = windows.percentiles(obs, ["cy", "cx"], "gap", {"median": 0.5, "p95": 0.95, "p99": 0.99})
    values = obs.groupBy("cy", "cx", "t").agg(F.count("*").alias("ties")).groupBy("cy", "cx").agg(F.count("t").alias("distinct_t"))
    return plain.join(ranked, ["cy", "cx"]).join(values, ["cy", "cx"])


def dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each code in its month."""
    counts = observations(spark, sf_dir).groupBy(F.month("d").alias("month"), "code").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("month")))


def modal_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.dominant(observations(spark, sf_dir).withColumn("month", F.month("d")), ["month", "cy", "cx"], "code")


def crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = list(range(1, 8))
    counts = observations(spark, sf_dir).groupBy(F.month("d").alias("month")).pivot("code", codes).count().na.fill(0)
    return counts.select("month", *(F.col(str(c)).alias(f"code_{c}") for c in codes))


def decade_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted domain means of both decades and their change."""
    df = moments.long_form(moist(spark, sf_dir).withColumn("decade", calendar.decade_start(F.col("d"))), ["decade", *CELL], VARIABLES)
    cells = df.groupBy("decade", *CELL, "variable").agg(F.count("x").alias("n"), F.avg("x").alias("mean")).where("n > 0")
    at = lambda y: F.sum(F.when(F.col("decade") == y, F.col("n") * F.col("mean"))) / F.sum(F.when(F.col("decade") == y, F.col("n")))
    out = cells.groupBy("variable").agg(F.count("*").alias("cells"), F.sum("n").alias("support"), at(1991).alias("base"), at(2001).alias("latest"))
    return out.withColumns({"change": F.col("latest") - F.col("base"), "percent": windows.percent_change(F.col("latest"), F.col("base"))})


def driver_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaussian state of t, td and ln p over rows that have all three."""
    df = observations(spark, sf_dir).withColumn("lnp", F.when(F.col("p") > 0, F.log("p"))).where("t is not null and td is not null and lnp is not null")
    pairs = [F.covar_pop(a, b).alias(f"cov_{a}_{b}") for a, b in (("t", "td"), ("t", "lnp"), ("td", "lnp"))]
    return df.groupBy("cy", "cx").agg(F.count("*").alias("n"), *(F.avg(c).alias(f"mean_{c}") for c in ("t", "td", "lnp")), *(F.var_pop(c).alias(f"var_{c}") for c in ("t", "td", "lnp")), *pairs)


def work_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transaction id per day and block."""
    work = observations(spark, sf_dir).select("d", "cy", "cx").distinct()
    key = F.concat(F.date_format("d", "yyyy-MM-dd"), F.format_string("-Y%05d-X%05d", "cy", "cx"))
    return work.withColumn("txid", F.substring(F.sha2(key, 256), 1, 32))


def calendar_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations per slot of the calendar, reserved slot included."""
    counts = observations(spark, sf_dir).groupBy(calendar.slot(F.col("d")).alias("slot")).agg(F.count("*").alias("n"))
    return calendar.calendar(spark).join(counts, "slot", "left").select("slot", "month", "day", "label", "reserved", F.coalesce("n", F.lit(0)).alias("n"))


def level_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per variable: support at each level (all equal), extremes in order, nothing in the reserved slot."""
    at = lambda lo, hi: F.sum(F.when(F.col("level_bin").between(lo, hi), F.col("n")).otherwise(0))
    return level_states(spark, sf_dir).groupBy("variable").agg(
        at(0, 0).alias("n_l1"), at(1, 8).alias("n_l2"), at(9, 32).alias("n_l3"), F.count_if(F.col("low") > F.col("high")).alias("out_of_order"), F.count_if(F.col("slot") == calendar.RESERVED).alias("reserved")
    )
