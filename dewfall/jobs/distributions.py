"""Fits per month and cell: native normal, skew-normal and Gaussian copula; the other families group by group; their comparison."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dewfall.functions.physics import VARIABLES
from dewfall.jobs.climatology import moist
from dewfall.jobs.oracles import MOIST
from dewfall.operators import fits, moments, windows

GROUP = ("month", "cy", "cx")
#: Values that a fit, and pairs that a comparison of copulas, must have.
LEAST, LEAST_PAIRS = 30, 200
FITTED = "month int, cy int, cx int, variable string, family string, params array<double>, n long, ll double, aic double, aicc double, bic double, status string"
#: Of a mixture of two normals: how far apart they are, and the mass under both.
MIXED = "separation double, overlap double"


def hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each cell and hour, so that a group is bounded by the hours of a month times the years."""
    one = moist(spark, sf_dir).groupBy("cy", "cx", "d", "h").agg(*(F.avg(v).alias(v) for v in VARIABLES))
    return one.withColumn("month", F.month("d"))


def skew_normal_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skew-normal parameters from mean, deviation and skewness, in built-in functions alone."""
    df = moments.long_form(hours(spark, sf_dir), list(GROUP), ("rh", "e"))
    states = df.groupBy(*GROUP, "variable").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("s"), F.round(F.skewness("x"), 9).alias("g"))
    g = F.col("g")
    raw = F.when(F.abs(g) < 0.99, g / F.sqrt(1 + (2 / F.pi() - 1) * g * g)).otherwise(0.0)
    out = states.where(f"n >= {LEAST} and s > 0").withColumn("delta", F.least(F.greatest(raw, F.lit(-0.999999)), F.lit(0.999999)))
    out = out.withColumn("omega", F.col("s") / F.sqrt(1 - 2 * F.col("delta") * F.col("delta") / F.pi()))
    shape = F.when(F.abs("delta") < 0.999, F.col("delta") / F.sqrt(1 - F.col("delta") * F.col("delta"))).otherwise(0.0)
    shown = {"omega": F.round("omega", 6), "xi": F.round(F.col("mean") - F.col("omega") * F.col("delta") * F.sqrt(2 / F.pi()), 6) + 0.0, "alpha": F.round(shape, 6) + 0.0}
    return out.select(*GROUP, "variable", "n", *(c.alias(k) for k, c in shown.items()))


def gaussian_copula_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of normal scores of relative and specific humidity with its likelihood and criteria, in built-in functions alone."""
    both = hours(spark, sf_dir).where("rh is not null and q is not null").select(*GROUP, F.round("rh", 6).alias("rh"), F.round("q", 9).alias("q"))
    ranked = windows.average_rank(both, GROUP, "rh").withColumn("u", (F.col("rank_avg") - 0.5) / F.col("n")).select(*GROUP, "rh", "q", "u")
    ranked = windows.average_rank(ranked, GROUP, "q").withColumn("v", (F.col("rank_avg") - 0.5) / F.col("n"))
    score = lambda c: fits.normal_quantile(F.least(F.greatest(F.col(c), F.lit(1e-10)), F.lit(1 - 1e-10)))
    z = ranked.select(*GROUP, score("u").alias("a"), score("v").alias("b"))
    sums = z.groupBy(*GROUP).agg(F.count("*").alias("n"), F.regr_sxx("b", "a").alias("sxx"), F.regr_syy("b", "a").alias("syy"), F.regr_sxy("b", "a").alias("sxy"), F.sum(F.col("a") * F.col("a") + F.col("b") * F.col("b")).alias("ss"), F.sum(F.col("a") * F.col("b")).alias("ab"))
    rho = F.least(F.greatest(F.col("sxy") / F.sqrt(F.col("sxx") * F.col("syy")), F.lit(-0.9999)), F.lit(0.9999))
    good = sums.where((F.col("n") >= LEAST) & (F.col("sxx") > 0) & (F.col("syy") > 0)).withColumn("rho", rho)
    rest = 1 - F.col("rho") * F.col("rho")
    good = good.withColumn("ll", -F.col("n") / 2 * F.log(rest) - (F.col("rho") * F.col("rho") * F.col("ss") - 2 * F.col("rho") * F.col("ab")) / (2 * rest))
    return good.select(*GROUP, "n", F.round("rho", 8).alias("rho"), F.round("ll", 6).alias("ll"), *(F.round(c, 6).alias(k) for k, c in fits.criteria(F.col("ll"), F.col("n"), 1).items()))


def density_at_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bivariate normal density of temperature and dew point one deviation above their means, per month and cell."""
    obs = moist(spark, sf_dir).withColumn("month", F.month("d")).where("t is not null and td is not null")
    s = obs.groupBy(*GROUP).agg(F.count("*").alias("n"), F.avg("t").alias("mx"), F.avg("td").alias("my"), F.stddev_samp("t").alias("sx"), F.stddev_samp("td").alias("sy"), F.covar_samp("t", "td").alias("c"))
    rho = F.when((F.col("sx") > 0) & (F.col("sy") > 0), F.col("c") / (F.col("sx") * F.col("sy")))
    s = s.withColumn("rho", F.least(F.greatest(rho, F.lit(-0.999999)), F.lit(0.999999)))
    density = fits.bivariate_normal_density(F.col("mx") + F.col("sx"), F.col("my") + F.col("sy"), F.col("mx"), F.col("my"), F.col("sx"), F.col("sy"), F.col("rho"))
    return s.where("n >= 10").select(*GROUP, "n", F.round("rho", 9).alias("rho"), F.round(density, 9).alias("density"))


def _scored(family: str, params: list[float], ll: float, n: int, k: int) -> tuple:
    aic = 2 * k - 2 * ll
    return family, [float(p) for p in params], n, ll, aic, aic + 2 * k * (k + 1) / (n - k - 1) if n > k + 1 else float("inf"), k * np.log(max(n, 1)) - 2 * ll


def window_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every marginal family of temperature's relative humidity share and of specific humidity per month and cell; params in a fixed order, and of the two-normal mixture its separation and overlap.

    Families that fail, or groups with under 30 values, say so in status and have no parameters."""
    shares = hours(spark, sf_dir).select(*GROUP, (F.col("rh") / 100).alias("rh_fraction"), "q")
    long = moments.long_form(shares, list(GROUP), ("rh_fraction", "q")).where("x is not null")

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, rows = np.sort(pdf["x"].to_numpy("f8")), []
        none = (None, len(x), None, None, None, None)
        if len(x) < LEAST or x.std() == 0:
            rows.append((*key, "none", *none, "insufficient_data", None, None))
        else:
            for family, (run, k) in fits.MARGINALS.items():
                if family == "Beta" and not (x[0] >= 0 and x[-1] <= 1):
                    continue
                try:
                    params, ll = run(x)
                    apart = (fits.ashman(params), fits.overlap(params)) if family == "BimodalNormal" else (None, None)
                    rows.append((*key, *_scored(family, params, ll, len(x), k), "ok", *apart))
                except (ValueError, ArithmeticError, np.linalg.LinAlgError) as error:
                    rows.append((*key, family, *none, type(error).__name__, None, None))
        return pd.DataFrame(rows, columns=[c.split(" ")[0] for c in f"{FITTED}, {MIXED}".split(", ")])

    return long.groupBy(*GROUP, "variable").applyInPandas(fit, f"{FITTED}, {MIXED}")


def beta_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The beta family of relative humidity as a share per month and cell, by Newton steps."""
    shares = hours(spark, sf_dir).where("rh is not null").select(*GROUP, F.round(F.col("rh") / 100, 9).alias("x"))

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, rows = np.sort(pdf["x"].to_numpy("f8")), []
        if len(x) >= LEAST and x.std() > 0:
            (a, b), ll = fits.beta_fit(x)
            rows.append((*key, len(x), a, b, ll))
        return pd.DataFrame(rows, columns=[*GROUP, "n", "a", "b", "ll"])

    found = shares.groupBy(*GROUP).applyInPandas(fit, "month int, cy int, cx int, n long, a double, b double, ll double")
    return found.select(*GROUP, "n", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), (F.round("ll", 5) + 0.0).alias("ll"))


def best_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The family with the least aicc, then bic, then name, in each month, cell and variable."""
    order = Window.partitionBy(*GROUP, "variable").orderBy("aicc", "bic", "family")
    return window_fits(spark, sf_dir).where("status = 'ok'").withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def copula_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five copula families of relative and specific humidity per month and cell with 200 pairs or more; delta_bic against the best."""
    both = hours(spark, sf_dir).where("rh is not null and q is not null").select(*GROUP, "rh", "q")

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows, n = [], len(pdf)
        if n >= LEAST_PAIRS:
            u, v = (np.clip(pdf[c].rank(method="average").to_numpy() / (n + 1), 1e-10, 1 - 1e-10) for c in ("rh", "q"))
            for family, (run, k) in fits.COPULAS.items():
                rows.append((*key, "rh-q", *_scored(family, *run(u, v), n, k), "ok"))
        return pd.DataFrame(rows, columns=[c.split(" ")[0] for c in FITTED.split(", ")])

    found = both.groupBy(*GROUP).applyInPandas(fit, FITTED)
    return found.withColumn("delta_bic", F.col("bic") - F.min("bic").over(Window.partitionBy(*GROUP))).drop("variable", "status")


def copula_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The winning copula of each month and cell, and by how much it beats the second."""
    found = copula_fits(spark, sf_dir)
    place = F.row_number().over(Window.partitionBy(*GROUP).orderBy("bic", "family"))
    at = lambda k, c: F.max(F.when(F.col("place") == k, F.col(c)))
    out = found.withColumn("place", place).groupBy(*GROUP).agg(at(1, "family").alias("winner"), (at(2, "bic") - at(1, "bic")).alias("margin"))
    return out.withColumn("decisive", F.col("margin") >= 10)


def _sql_quantile(u: str) -> str:
    def poly(x: str, c: tuple) -> str:
        out = f"({c[0]!r}::DOUBLE)"
        for k in c[1:]:
            out = f"({out} * {x} + ({k!r}::DOUBLE))"
        return out

    def tail(p: str) -> str:
        t = f"sqrt(-2 * ln({p}))"
        return f"{poly(t, fits._C)} / ({poly(t, fits._D)} * {t} + 1)"

    q = f"({u} - 0.5)"
    middle = f"{poly(f'({q} * {q})', fits._A)} * {q} / ({poly(f'({q} * {q})', fits._B)} * {q} * {q} + 1)"
    return f"CASE WHEN {u} < 0.02425 THEN {tail(u)} WHEN {u} <= 1 - 0.02425 THEN {middle} ELSE -({tail(f'(1 - {u})')}) END"


_HOURS = "hr AS (SELECT cy, cx, d, h, month(d) AS month, avg(rh) AS rh, avg(e) AS e, avg(r) AS r, avg(q) AS q FROM moist GROUP BY cy, cx, d, h)"
_RANK = "(rank() OVER (PARTITION BY month, cy, cx ORDER BY {0}) + (count(*) OVER (PARTITION BY month, cy, cx, {0}) - 1) / 2 - 0.5) / count(*) OVER (PARTITION BY month, cy, cx)"


def _digamma(x: str) -> str:
    y = f"({x} + 6)"
    return f"(ln({y}) - 0.5 / {y} - 1 / (12 * {y} ** 2) + 1 / (120 * {y} ** 4) - 1 / (252 * {y} ** 6) + 1 / (240 * {y} ** 8) - {' - '.join(f'1 / ({x} + {k})' for k in range(6))})"


def _trigamma(x: str) -> str:
    y = f"({x} + 6)"
    return f"(1 / {y} + 0.5 / {y} ** 2 + 1 / (6 * {y} ** 3) - 1 / (30 * {y} ** 5) + 1 / (42 * {y} ** 7) - 1 / (30 * {y} ** 9) + {' + '.join(f'1 / ({x} + {k}) ** 2' for k in range(6))})"


SQL: dict[str, str] = {
    "beta_fits": f"""WITH RECURSIVE {MOIST}, {_HOURS}, s0 AS (SELECT month, cy, cx, round(rh / 100, 9) AS x FROM hr WHERE rh IS NOT NULL),
s1 AS (SELECT month, cy, cx, count(*) AS n, greatest(1e-6, 0.5 / count(*)) AS eps FROM s0 GROUP BY ALL HAVING count(*) >= {LEAST} AND stddev_pop(x) > 0),
s2 AS (SELECT month, cy, cx, n, least(greatest(x, eps), 1 - eps) AS y FROM s0 JOIN s1 USING (month, cy, cx)),
s3 AS (SELECT month, cy, cx, n, avg(ln(y)) AS u, avg(ln(1 - y)) AS v, avg(y) AS m, var_pop(y) AS s2 FROM s2 GROUP BY ALL), s4 AS (SELECT *, greatest(m * (1 - m) / s2 - 1, 1e-3) AS k FROM s3),
nw AS (SELECT 0 AS step, month, cy, cx, n, u, v, m * k AS a, (1 - m) * k AS b FROM s4
  UNION ALL SELECT step + 1, month, cy, cx, n, u, v, CASE WHEN a - da > 0 AND b - db > 0 THEN a - da ELSE a / 2 END, CASE WHEN a - da > 0 AND b - db > 0 THEN b - db ELSE b / 2 END FROM (
    SELECT *, (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS da, (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS db FROM (
      SELECT *, u - {_digamma("a")} + {_digamma("(a + b)")} AS ga, v - {_digamma("b")} + {_digamma("(a + b)")} AS gb, {_trigamma("(a + b)")} AS hab, {_trigamma("(a + b)")} - {_trigamma("a")} AS haa, {_trigamma("(a + b)")} - {_trigamma("b")} AS hbb FROM nw WHERE step < 60)))
SELECT month, cy, cx, n, round(a, 6) AS a, round(b, 6) AS b, round(n * ((a - 1) * u + (b - 1) * v + lgamma(a + b) - lgamma(a) - lgamma(b)), 5) + 0 AS ll FROM nw WHERE step = 60""",
    "skew_normal_moments": f"""WITH {MOIST}, {_HOURS}, l AS (SELECT month, cy, cx, unnest(['rh', 'e']) AS variable, unnest([rh, e]) AS x FROM hr),
mu AS (SELECT month, cy, cx, variable, avg(x) AS mean, stddev_pop(x) AS s, count(x) AS n FROM l GROUP BY ALL HAVING count(x) >= {LEAST} AND stddev_pop(x) > 0),
s AS (SELECT month, cy, cx, variable, any_value(n) AS n, any_value(mean) AS mean, any_value(s) AS s, round(avg(((x - mean) / s) ** 3), 9) AS g FROM l JOIN mu USING (month, cy, cx, variable) GROUP BY ALL),
dl AS (SELECT *, least(greatest(CASE WHEN abs(g) < 0.99 THEN g / sqrt(1 + (2 / pi() - 1) * g * g) ELSE 0 END, -0.999999), 0.999999) AS delta FROM s), om AS (SELECT *, s / sqrt(1 - 2 * delta * delta / pi()) AS omega FROM dl)
SELECT month, cy, cx, variable, n, round(omega, 6) AS omega, round(mean - omega * delta * sqrt(2 / pi()), 6) + 0 AS xi, round(CASE WHEN abs(delta) < 0.999 THEN delta / sqrt(1 - delta * delta) ELSE 0 END, 6) + 0 AS alpha FROM om""",
    "gaussian_copula_fits": f"""WITH {MOIST}, {_HOURS}, b AS (SELECT month, cy, cx, round(rh, 6) AS rh, round(q, 9) AS q FROM hr WHERE rh IS NOT NULL AND q IS NOT NULL),
uv AS (SELECT month, cy, cx, least(greatest({_RANK.format("rh")}, 1e-10), 1 - 1e-10) AS u, least(greatest({_RANK.format("q")}, 1e-10), 1 - 1e-10) AS v FROM b),
z AS (SELECT month, cy, cx, {_sql_quantile("u")} AS a, {_sql_quantile("v")} AS b FROM uv),
s AS (SELECT month, cy, cx, count(*) AS n, regr_sxx(b, a) AS sxx, regr_syy(b, a) AS syy, regr_sxy(b, a) AS sxy, sum(a * a + b * b) AS ss, sum(a * b) AS ab FROM z GROUP BY ALL),
r AS (SELECT *, least(greatest(sxy / sqrt(sxx * syy), -0.9999), 0.9999) AS rho FROM s WHERE n >= {LEAST} AND sxx > 0 AND syy > 0),
l AS (SELECT *, -n / 2 * ln(1 - rho * rho) - (rho * rho * ss - 2 * rho * ab) / (2 * (1 - rho * rho)) AS ll FROM r)
SELECT month, cy, cx, n, round(rho, 8) AS rho, round(ll, 6) AS ll, round(2 - 2 * ll, 6) AS aic, round(ln(n) - 2 * ll, 6) AS bic, round(2 - 2 * ll + 4 / (n - 2), 6) AS aicc FROM l""",
    "density_at_means": f"""WITH {MOIST}, s AS (SELECT month(d) AS month, cy, cx, count(*) AS n, stddev_samp(t) AS sx, stddev_samp(td) AS sy, covar_samp(t, td) AS c FROM obs WHERE t IS NOT NULL AND td IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
r AS (SELECT *, least(greatest(CASE WHEN sx > 0 AND sy > 0 THEN c / (sx * sy) END, -0.999999), 0.999999) AS rho FROM s)
SELECT month, cy, cx, n, round(rho, 9) AS rho, round(exp(-(2 - 2 * rho) / (2 * (1 - rho * rho))) / (2 * pi() * sx * sy * sqrt(1 - rho * rho)), 9) AS density FROM r""",
}
#: Iterative fits have no SQL; tests check them by their likelihoods.
UNCHECKED = ("window_fits", "best_fits", "copula_fits", "copula_margins")
