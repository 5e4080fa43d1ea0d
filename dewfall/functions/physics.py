"""Moisture physics as Column expressions. Null, NaN and infinite input give null, never NaN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VARIABLES = ("rh", "e", "r", "q")

# Coefficients of the Magnus form over water and over ice, hPa at 0 °C, ratio of the gas constants.
E0, WATER, ICE, EPSILON = 6.112, (17.67, 243.5), (22.46, 272.62), 0.622
# Names of units.
KELVIN, CELSIUS = ("k", "kelvin"), ("c", "degc", "degree_celsius", "degrees_celsius", "celsius")
PASCAL, HECTOPASCAL = ("pa", "pascal", "pascals"), ("hpa", "mb", "millibar", "millibars")


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite: Spark would order NaN above every number and keep it in sums."""
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def saturation_vapor_pressure(t: Column) -> Column:
    """hPa over water from 0 °C, over ice below. A value that is not finite gives null."""
    over = lambda a, b: E0 * F.exp(a * t / (t + b))
    return finite(F.when(t >= 0, over(*WATER)).when(t < 0, over(*ICE)))


def temperature_celsius(value: Column, units: Column) -> Column:
    u = normalize_units(units)
    return (
        F.when(u.isin(*KELVIN), value - 273.15)
        .when(u.isin(*CELSIUS), value)
        .otherwise(F.raise_error(F.concat(F.lit("unknown temperature units: "), F.coalesce(u, F.lit("null")))).cast("double"))
    )


def pressure_hpa(value: Column, units: Column) -> Column:
    u = normalize_units(units)
    return (
        F.when(u.isin(*PASCAL), value / 100)
        .when(u.isin(*HECTOPASCAL), value)
        .otherwise(F.raise_error(F.concat(F.lit("unknown pressure units: "), F.coalesce(u, F.lit("null")))).cast("double"))
    )


def normalize_units(units: Column) -> Column:
    return F.replace(F.replace(F.lower(F.trim(units)), F.lit("°"), F.lit("deg")), F.lit(" "), F.lit("_"))


def with_moisture(obs: DataFrame) -> DataFrame:
    """obs(t, td, p) with e, rh, r, q and the flags supersat and bad_ep; t, td and p that are not finite become null."""
    e, p = F.col("e"), F.col("p")
    raw = F.col("rh_raw")
    sound = obs.withColumns({c: finite(F.col(c)) for c in ("t", "td", "p")})
    out = sound.withColumn("e", saturation_vapor_pressure(F.col("td"))).withColumn("rh_raw", 100 * e / saturation_vapor_pressure(F.col("t")))
    return out.withColumns(
        {
            "rh": F.when(raw.isNotNull(), F.least(F.greatest(raw, F.lit(0.0)), F.lit(100.0))),
            "r": F.when((e > 0) & (p > 0) & (e < p), EPSILON * e / (p - e)),
            "supersat": F.coalesce(raw > 100, F.lit(False)),
            "bad_ep": F.coalesce(e >= p, F.lit(False)),
        }
    ).withColumn("q", F.col("r") / (1 + F.col("r")))
