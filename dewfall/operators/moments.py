"""Mergeable states as plain aggregates: moments to fourth order, paired sums, histograms, and their merges.

All are partial aggregates, so a shuffle carries one row per group and task however many observations there are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Strict thresholds counted for each variable; pairs of variables; joint thresholds of pairs; ranges of the histogram.
THRESHOLDS = {"rh": (80, 90, 95, 100), "e": (10, 15, 20, 25), "r": (0.008, 0.010, 0.012, 0.015, 0.020), "q": (0.008, 0.010, 0.012, 0.015, 0.020)}


PAIRS = (("rh", "q"), ("rh", "e"), ("q", "e"), ("r", "q"))
JOINT = ((80, 0.012), (90, 0.012), (95, 0.015), (80, 0.012))  # rh above, q above; the last repeats the first
RH_RANGE, Q_RANGE = (0, 130), (0, 0.030)
#: Sizes by which central sums are shown: a typical value of each variable.
UNIT = {"rh": 100.0, "e": 10.0, "r": 0.01, "q": 0.01}


def moment_state(x: str) -> list[Column]:
    """n, missing, mean, m2, m3, m4, low, high of a column; central sums are 0 for constant groups."""
    n, m2 = F.count(x), F.var_pop(x) * F.count(x)
    g = F.coalesce(F.skewness(x), F.lit(0.0))
    k = F.coalesce(F.kurtosis(x), F.lit(-3.0))
    return [
        n.alias("n"),
        (F.count(F.lit(1)) - n).alias("missing"),
        F.avg(x).alias("mean"),
        m2.alias("m2"),
        (g * n * F.pow(m2 / n, F.lit(1.5))).alias("m3"),
        ((k + 3) * m2 * m2 / n).alias("m4"),
        F.min(x).alias("low"),
        F.max(x).alias("high"),
    ]


def long_form(df: DataFrame, keys: Sequence[str], variables: Sequence[str]) -> DataFrame:
    """keys, variable, x: one row per variable."""
    return df.select(*keys, F.explode(F.array(*(F.struct(F.lit(v).alias("variable"), F.col(v).alias("x")) for v in variables))).alias("s")).select(*keys, "s.*")


def wide_states(variables: Sequence[str]) -> list[Column]:
    """A state for each variable beside the others, as a struct of its name: observations are not repeated by variable."""
    return [F.struct(*moment_state(v)).alias(v) for v in variables]


def stacked(wide: DataFrame, keys: Sequence[str], variables: Sequence[str]) -> DataFrame:
    """keys, variable and the state's columns: a row for each variable of wide_states."""
    return long_form(wide, keys, variables).select(*keys, "variable", "x.*")


def merge_moments(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """States of disjoint parts merged by keys.

    Two aggregates on the same keys, so one exchange: the mean first, then the parts' central sums moved to it.
    The parts of a group are few (periods, levels), so they are gathered as an array in between."""
    part = F.struct("n", "mean", "m2", "m3", "m4")
    got = states.where("n > 0").groupBy(*keys).agg(
        F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"), F.collect_list(part).alias("parts"), F.min("low").alias("low"), F.max("high").alias("high")
    )

    def total(term) -> Column:
        return F.aggregate("parts", F.lit(0.0), lambda acc, s: acc + term(s, s["mean"] - F.col("mean")))

    return got.select(
        *keys,
        "n",
        "mean",
        total(lambda s, d: s["m2"] + s["n"] * d * d).alias("m2"),
        total(lambda s, d: s["m3"] + 3 * d * s["m2"] + s["n"] * d * d * d).alias("m3"),
        total(lambda s, d: s["m4"] + 4 * d * s["m3"] + 6 * d * d * s["m2"] + s["n"] * d * d * d * d).alias("m4"),
        "low",
        "high",
    )


def finalized() -> list[Column]:
    """std, skew, kurt (bias-corrected) from a state's n, m2, m3, m4."""
    n, m2, m3, m4 = (F.col(c) for c in ("n", "m2", "m3", "m4"))
    varied = varies()
    skew = F.sqrt(n * (n - 1)) / (n - 2) * (m3 / n) / F.pow(m2 / n, F.lit(1.5))
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * n * m4 / (m2 * m2) - 3 * (n - 1))
    return [
        F.when(n >= 2, F.sqrt(F.greatest(m2 / (n - 1), F.lit(0.0)))).alias("std"),
        F.when((n >= 3) & varied, skew).alias("skew"),
        F.when((n >= 4) & varied, kurt).alias("kurt"),
    ]


def varies() -> Column:
    """The extremes differ by more than 1e-9 of their size: below that central sums are rounding, and M2 > 0 says nothing."""
    return F.col("high") - F.col("low") > 1e-9 * F.abs("high")


def scale_free() -> list[Column]:
    """mean, m2, g1, g2, low, high rounded: population skewness and excess kurtosis stand for m3 and m4, whose size varies with units."""
    n, m2 = F.col("n"), F.col("m2")
    varied = (n > 0) & varies()
    g1 = F.when(varied, F.round(F.col("m3") / n / F.pow(m2 / n, F.lit(1.5)), 6) + 0.0)
    g2 = F.when(varied, F.round(n * F.col("m4") / (m2 * m2) - 3, 6) + 0.0)
    return [*((F.round(c, 9) + 0.0).alias(c) for c in ("mean", "m2")), g1.alias("g1"), g2.alias("g2"), *(F.round(c, 9).alias(c) for c in ("low", "high"))]


def pair_state(x: str, y: str) -> list[Column]:
    """Count, means and central sums over rows that have both columns."""
    return [
        F.regr_count(y, x).alias("n"),
        F.regr_avgx(y, x).alias("mean_x"),
        F.regr_avgy(y, x).alias("mean_y"),
        F.regr_sxx(y, x).alias("m2_x"),
        F.regr_syy(y, x).alias("m2_y"),
        F.regr_sxy(y, x).alias("cxy"),
    ]


def shown_sums() -> list[Column]:
    """m3 and m4 of a state of `variable`, in units of its typical value and rounded there."""
    unit = F.create_map(*(F.lit(x) for kv in UNIT.items() for x in kv))[F.col("variable")]
    return [(F.round(F.col(c) / F.pow(unit, F.lit(float(k))), 6) + 0.0).alias(c) for c, k in (("m3", 3), ("m4", 4))]


def merge_pairs(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Paired sums of disjoint parts merged by keys; the few parts of a group are gathered in between, as for moments."""
    part = F.struct("n", "mean_x", "mean_y", "m2_x", "m2_y", "cxy")
    mean = lambda c: (F.sum(F.col("n") * F.col(c)) / F.sum("n")).alias(c)
    got = states.where("n > 0").groupBy(*keys).agg(F.sum("n").alias("n"), mean("mean_x"), mean("mean_y"), F.collect_list(part).alias("parts"))

    def total(c: str, x: str, y: str) -> Column:
        moved = lambda s: s[c] + s["n"] * (s[x] - F.col(x)) * (s[y] - F.col(y))
        return F.aggregate("parts", F.lit(0.0), lambda acc, s: acc + moved(s)).alias(c)

    return got.select(*keys, "n", "mean_x", "mean_y", total("m2_x", "mean_x", "mean_x"), total("m2_y", "mean_y", "mean_y"), total("cxy", "mean_x", "mean_y"))


def spread(c: str, mean: str) -> Column:
    """Whether a central sum of squares is more than rounding of values of the size of the mean."""
    return F.col(c) > 1e-18 * F.col("n") * F.col(mean) * F.col(mean)


def pair_products() -> list[Column]:
    """cov and corr of a pair state; corr is null where either side does not vary."""
    n, sxy = F.col("n"), F.sqrt(F.col("m2_x") * F.col("m2_y"))
    corr = F.least(F.greatest(F.col("cxy") / sxy, F.lit(-1.0)), F.lit(1.0))
    return [F.when(n >= 2, F.col("cxy") / (n - 1)).alias("cov"), F.when((n >= 2) & spread("m2_x", "mean_x") & spread("m2_y", "mean_y"), corr).alias("corr")]


def bin_of(x: Column, low: float, high: float, bins: int = 8) -> Column:
    """Bin 0 to bins - 1, both ends inclusive; null outside."""
    return F.when(x.between(low, high), F.least(F.floor((x - low) / (high - low) * bins), F.lit(bins - 1)).cast("int"))
