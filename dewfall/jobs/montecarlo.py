"""Monte-Carlo moisture of a Gaussian driver: temperature, dew point and log pressure of each cell drawn with their correlation.

Draws are a quasi-random sequence through the normal quantile, so reruns agree; the factor is the Cholesky factor L of the correlation and a draw is L z."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dewfall.functions import calendar
from dewfall.functions.physics import E0, EPSILON, ICE, WATER, with_moisture
from dewfall.jobs.distributions import _sql_quantile
from dewfall.jobs.oracles import MOIST, _SVP
from dewfall.operators import fits, moments
from dewfall.sources.observations import observations

DRAWS = 500
#: Draws of each slot and cell.
SLOT_DRAWS = 5_000
#: Rows of a slot and cell without which its three correlations are tied to each other: draws would rest on rounding.
LEAST_ROWS = 5
#: Draws without which a cell's result is not given.
LEAST = 10
#: Eigenvalues down to this are rounding and repaired.
TOLERANCE = -1e-8
# Steps of a three-dimensional additive sequence, powers of the inverse of the root of x^4 = x + 1.
_G = 1.2207440846057596
STEPS = tuple(1 / _G**k for k in (1, 2, 3))
LADDER = (100, 200, 500)


def driver(spark: SparkSession, sf_dir: str, keys: tuple[str, ...] = ("cy", "cx"), least: int = 2) -> DataFrame:
    """Means, deviations and clipped correlations of t, td and ln p per cell, or slot and cell; groups with `least` rows or more and all deviations above 0."""
    obs = observations(spark, sf_dir).withColumn("slot", calendar.slot(F.col("d")))
    df = obs.withColumn("w", F.when(F.col("p") > 0, F.log("p"))).where("t is not null and td is not null and w is not null")
    s = df.groupBy(*keys).agg(
        F.count("*").alias("n"), *(F.avg(c).alias(f"m_{c}") for c in ("t", "td", "w")), *(F.stddev_samp(c).alias(f"s_{c}") for c in ("t", "td", "w")),
        *(F.covar_samp(a, b).alias(f"c{k}") for k, (a, b) in enumerate((("t", "td"), ("t", "w"), ("td", "w")), 1)),
    )
    sides = {1: ("s_t", "s_td"), 2: ("s_t", "s_w"), 3: ("s_td", "s_w")}
    clip = lambda c: F.least(F.greatest(c, F.lit(-0.999999)), F.lit(0.999999))
    good = s.where(f"n >= {least} and s_t > 0 and s_td > 0 and s_w > 0")
    return good.select(*keys, "n", "m_t", "m_td", "m_w", "s_t", "s_td", "s_w", *(clip(F.col(f"c{k}") / (F.col(a) * F.col(b))).alias(f"r{k}") for k, (a, b) in sides.items()))


def least_eigenvalue(r1: Column, r2: Column, r3: Column) -> Column:
    """Of the 3 by 3 correlation matrix with r12, r13, r23, by the cosine form of the cubic."""
    p2 = (r1 * r1 + r2 * r2 + r3 * r3) / 3
    ratio = F.when(p2 > 0, F.least(F.greatest(r1 * r2 * r3 / F.pow(p2, F.lit(1.5)), F.lit(-1.0)), F.lit(1.0))).otherwise(0.0)
    return 1 + 2 * F.sqrt(p2) * F.cos((F.acos(ratio) + 2 * math.pi) / 3)


def nearest_correlation(r1: Column, r2: Column, r3: Column) -> list[Column]:
    """The correlations of the nearest positive semidefinite matrix, scaled back to a diagonal of 1: negative eigenvalues become 0.

    The trace is 3 and no eigenvalue passes it, so at most the least is negative, and taking it out with its vector is the whole projection. The
    vector is the largest cross product of two rows of the matrix less the eigenvalue, which both are orthogonal to it."""
    low = least_eigenvalue(r1, r2, r3)
    d = 1 - low
    sides = [(r1 * r3 - r2 * d, r2 * r1 - d * r3, d * d - r1 * r1), (r1 * d - r2 * r3, r2 * r2 - d * d, d * r3 - r1 * r2), (d * d - r3 * r3, r3 * r2 - r1 * d, r1 * r3 - d * r2)]
    vectors = [F.struct((x * x + y * y + z * z).alias("s"), x.alias("x"), y.alias("y"), z.alias("z")) for x, y, z in sides]
    best = F.array_max(F.array(*vectors))

    def repaired(v: Column) -> Column:
        x, y, z = (v[c] / F.sqrt(v["s"]) for c in "xyz")
        a, b, c = (F.sqrt(F.greatest(1 - low * w * w, F.lit(1e-15))) for w in (x, y, z))
        return F.array((r1 - low * x * y) / (a * b), (r2 - low * x * z) / (a * c), (r3 - low * y * z) / (b * c))

    held = F.transform(F.array(best), repaired)[0]
    return [F.when(low < 0, held[k]).otherwise(r) for k, r in enumerate((r1, r2, r3))]


def factored(drivers: DataFrame) -> DataFrame:
    """drivers with the Cholesky factor of their correlation and `valid`; where the least eigenvalue is below 0, by rounding alone if the cell is valid, the nearest correlations stand in."""
    r = [F.col(c) for c in ("r1", "r2", "r3")]
    low = drivers.withColumn("least", least_eigenvalue(*r))
    eased = low.withColumns(dict(zip(("r1", "r2", "r3"), nearest_correlation(*r), strict=True)))
    a = F.sqrt(F.greatest(1 - F.col("r1") * F.col("r1"), F.lit(1e-300)))
    b = (F.col("r3") - F.col("r1") * F.col("r2")) / a
    return eased.withColumns({"l22": a, "l32": b}).withColumns(
        {"l33": F.sqrt(F.greatest(1 - F.col("r2") * F.col("r2") - F.col("l32") * F.col("l32"), F.lit(0.0))), "valid": F.col("least") >= TOLERANCE}
    )


def nearest_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations of each slot and cell put together from three different samples (t and td, the slot's t and p of other hours, td and p with its sign turned), which need not fit together, and the nearest ones that do."""
    mixed = driver(spark, sf_dir, ("slot", "cy", "cx"), LEAST_ROWS).select("slot", "cy", "cx", "r1", "r2", (-F.col("r3")).alias("r3"))
    r = [F.col(c) for c in ("r1", "r2", "r3")]
    shown = [(F.round(c, 6) + 0.0).alias(f"near_{k}") for k, c in enumerate(nearest_correlation(*r), 1)]
    return mixed.select("slot", "cy", "cx", (least_eigenvalue(*r) < -1e-9).alias("repaired"), *shown)


def correlation_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations, least eigenvalue and Cholesky factor of each cell."""
    return factored(driver(spark, sf_dir)).select("cy", "cx", "n", "valid", *(F.round(c, 9).alias(c) for c in ("r1", "r2", "r3", "least", "l22", "l32", "l33")))


def drawn(spark: SparkSession, sf_dir: str, draws: int = DRAWS) -> DataFrame:
    """Physics of the draws of each valid cell, numbered by k."""
    cells = factored(driver(spark, sf_dir)).where("valid")
    numbered = cells.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    u = {f"z{j}": fits.normal_quantile(F.pmod(0.5 + (F.col("k") + 1) * s, F.lit(1.0))) for j, s in enumerate(STEPS, 1)}
    z1, z2, z3 = F.col("z1"), F.col("z2"), F.col("z3")
    t = F.col("m_t") + F.col("s_t") * z1
    td = F.col("m_td") + F.col("s_td") * (F.col("r1") * z1 + F.col("l22") * z2)
    p = F.exp(F.col("m_w") + F.col("s_w") * (F.col("r2") * z1 + F.col("l32") * z2 + F.col("l33") * z3))
    state = numbered.withColumns(u).select("cy", "cx", "k", t.alias("t"), td.alias("td"), p.alias("p"))
    return with_moisture(state)


def additive_normals(draws: int) -> np.ndarray:
    """The draws' standard normals, a row for each: the same ones for every cell."""
    u = (0.5 + (np.arange(draws)[:, None] + 1) * np.array(STEPS)) % 1.0
    return fits.quantile(u)


def moist_arrays(t: np.ndarray, td: np.ndarray, p: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(variables, mask of draws with all four, supersaturated, e at or above p): with_moisture over arrays."""

    def svp(x: np.ndarray) -> np.ndarray:
        over = lambda a, b: E0 * np.exp(a * x / (x + b))
        return np.where(x >= 0, over(*WATER), over(*ICE))

    with np.errstate(all="ignore"):
        e, raw = svp(td), 100 * svp(td) / svp(t)
        r = np.where((e > 0) & (p > 0) & (e < p), EPSILON * e / (p - e), np.nan)
        out = {"rh": np.clip(raw, 0, 100), "e": e, "r": r, "q": r / (1 + r)}
        mask = np.isfinite(out["rh"]) & np.isfinite(e) & np.isfinite(r) & np.isfinite(out["q"])
        return out, mask, raw > 100, e >= p


SIMULATED = "slot int, cy int, cx int, variable string, n long, mean double, m2 double, m3 double, m4 double, low double, high double, supersat long, bad_ep long"
#: Cells that are drawn at once.
AT_ONCE = 64


def simulated_states(drivers: DataFrame, draws: int) -> DataFrame:
    """SIMULATED: moment states of each variable over the draws of each valid slot and cell that give all four. Draws are made and summed up inside a task, AT_ONCE cells at a time, and never become rows."""
    named = ("slot", "cy", "cx", "m_t", "m_td", "m_w", "s_t", "s_td", "s_w", "r1", "l22", "r2", "l32", "l33")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z = additive_normals(draws)
        for frame in frames:
            for k in range(0, len(frame), AT_ONCE):
                part = frame.iloc[k : k + AT_ONCE]
                c = {name: part[name].to_numpy("f8")[:, None] for name in named[3:]}
                t = c["m_t"] + c["s_t"] * z[:, 0]
                td = c["m_td"] + c["s_td"] * (c["r1"] * z[:, 0] + c["l22"] * z[:, 1])
                p = np.exp(c["m_w"] + c["s_w"] * (c["r2"] * z[:, 0] + c["l32"] * z[:, 1] + c["l33"] * z[:, 2]))
                values, mask, supersat, bad = moist_arrays(t, td, p)
                n = mask.sum(axis=1)
                for variable, x in values.items():
                    with np.errstate(all="ignore"):
                        mean = np.where(mask, x, 0).sum(axis=1) / n
                        off = np.where(mask, x - mean[:, None], 0)
                        square = off * off
                        sums = {"m2": square.sum(axis=1), "m3": (square * off).sum(axis=1), "m4": (square * square).sum(axis=1)}
                    ends = {"low": np.where(mask, x, np.inf).min(axis=1), "high": np.where(mask, x, -np.inf).max(axis=1)}
                    told = {"slot": part["slot"], "cy": part["cy"], "cx": part["cx"], "variable": variable, "n": n, "mean": mean, **sums, **ends, "supersat": supersat.sum(axis=1), "bad_ep": bad.sum(axis=1)}
                    yield pd.DataFrame({name: np.asarray(v) if not isinstance(v, str) else v for name, v in told.items()})

    return factored(drivers).where("valid").select(*named).mapInPandas(run, SIMULATED)


def slot_simulation(spark: SparkSession, sf_dir: str, draws: int = SLOT_DRAWS) -> DataFrame:
    """Simulated moments of each slot, cell and variable, with the shares of supersaturated draws and of draws with e at or above p; LEAST draws or more with all four variables."""
    states = simulated_states(driver(spark, sf_dir, ("slot", "cy", "cx"), LEAST_ROWS), draws).where(f"n >= {LEAST}")
    done = states.select("*", *moments.finalized())
    shown = [(F.round(c, d) + 0.0).alias(c) for c, d in (("mean", 7), ("std", 7), ("skew", 3), ("kurt", 1))]
    return done.select("slot", "cy", "cx", "variable", "n", *shown, F.round(F.col("supersat") / F.col("n"), 7).alias("supersaturation_fraction"), F.round(F.col("bad_ep") / F.lit(draws), 7).alias("invalid_fraction"))


def simulated_moisture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means and deviations of drawn moisture per cell, with the shares of supersaturated draws and of draws with e at or above p."""
    df = drawn(spark, sf_dir)
    of = lambda v: [F.round(F.avg(v), 7).alias(f"mean_{v}"), F.round(F.stddev_samp(v), 7).alias(f"std_{v}")]
    out = df.groupBy("cy", "cx").agg(
        F.count("*").alias("draws"), F.count("q").alias("n_q"), *of("rh"), *of("e"), *of("q"), (F.count_if("supersat") / F.count("*")).alias("supersaturation_fraction"), (F.count_if("bad_ep") / F.count("*")).alias("invalid_fraction")
    )
    return out.where(f"n_q >= {LEAST}")


def convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, deviation and standard error of relative humidity after so many draws."""
    sizes = spark.createDataFrame([(n,) for n in LADDER], "draws int")
    df = drawn(spark, sf_dir, max(LADDER)).join(F.broadcast(sizes), F.col("k") < F.col("draws"))  # a fixed ladder
    s = df.groupBy("cy", "cx", "draws").agg(F.count("rh").alias("n"), F.avg("rh").alias("m"), F.stddev_samp("rh").alias("s"))
    return s.select("cy", "cx", "draws", "n", F.round("m", 7).alias("mean"), F.round("s", 7).alias("std"), F.round(F.col("s") / F.sqrt("n"), 8).alias("error"))


_DRIVER = f"""{MOIST}, dv AS (SELECT cy, cx, slot, t, td, CASE WHEN p > 0 THEN ln(p) END AS w FROM ep), st AS (SELECT cy, cx, count(*) AS n, avg(t) AS m_t, avg(td) AS m_td, avg(w) AS m_w,
  stddev_samp(t) AS s_t, stddev_samp(td) AS s_td, stddev_samp(w) AS s_w, covar_samp(t, td) AS c1, covar_samp(t, w) AS c2, covar_samp(td, w) AS c3 FROM dv WHERE t IS NOT NULL AND td IS NOT NULL AND w IS NOT NULL GROUP BY cy, cx),
rr AS (SELECT *, least(greatest(c1 / (s_t * s_td), -0.999999), 0.999999) AS r1, least(greatest(c2 / (s_t * s_w), -0.999999), 0.999999) AS r2, least(greatest(c3 / (s_td * s_w), -0.999999), 0.999999) AS r3 FROM st WHERE n >= 2 AND s_t > 0 AND s_td > 0 AND s_w > 0),
ev AS (SELECT *, (r1 * r1 + r2 * r2 + r3 * r3) / 3 AS p2 FROM rr), lo AS (SELECT *, 1 + 2 * sqrt(p2) * cos((acos(CASE WHEN p2 > 0 THEN least(greatest(r1 * r2 * r3 / pow(p2, 1.5), -1), 1) ELSE 0 END) + 2 * pi()) / 3) AS least FROM ev),
l2 AS (SELECT *, sqrt(1 - r1 * r1) AS l22, (r3 - r1 * r2) / sqrt(1 - r1 * r1) AS l32 FROM lo), ch AS (SELECT *, sqrt(greatest(1 - r2 * r2 - l32 * l32, 0)) AS l33, least >= -1e-8 AS valid FROM l2)"""

#: The same by slot and cell.
_SLOT_DRIVER = _DRIVER.replace("st AS (SELECT cy, cx,", "st AS (SELECT slot, cy, cx,").replace("GROUP BY cy, cx)", "GROUP BY slot, cy, cx)").replace("WHERE n >= 2 AND", f"WHERE n >= {LEAST_ROWS} AND")
# The projector on the least eigenvalue's vector is (R - a)(R - b) / ((c - a)(c - b)), a and b being the other eigenvalues.
_NEAREST = f"""{_SLOT_DRIVER}, mx AS (SELECT slot, cy, cx, r1, r2, -r3 AS r3 FROM rr), e0 AS (SELECT *, (r1 * r1 + r2 * r2 + r3 * r3) / 3 AS pp FROM mx),
e1 AS (SELECT *, acos(CASE WHEN pp > 0 THEN least(greatest(r1 * r2 * r3 / pow(pp, 1.5), -1), 1) ELSE 0 END) / 3 AS ph FROM e0),
e2 AS (SELECT *, 1 + 2 * sqrt(pp) * cos(ph) AS ea, 1 + 2 * sqrt(pp) * cos(ph + 2 * pi() / 3) AS ec FROM e1), e3 AS (SELECT *, 3 - ea - ec AS eb, (ec - ea) * (2 * ec + ea - 3) AS den FROM e2),
q AS (SELECT *, ((1 - ea) * r1 + r1 * (1 - eb) + r2 * r3) / den AS q12, ((1 - ea) * r2 + r1 * r3 + r2 * (1 - eb)) / den AS q13, (r1 * r2 + (1 - ea) * r3 + r3 * (1 - eb)) / den AS q23,
  ((1 - ea) * (1 - eb) + r1 * r1 + r2 * r2) / den AS q11, ((1 - ea) * (1 - eb) + r1 * r1 + r3 * r3) / den AS q22, ((1 - ea) * (1 - eb) + r2 * r2 + r3 * r3) / den AS q33 FROM e3)"""


def _drawn_sql(draws: int) -> str:
    u = ", ".join(f"{_sql_quantile(f'u{j}')} AS z{j}" for j in (1, 2, 3))
    frac = ", ".join(f"(0.5::DOUBLE + (k + 1) * {s!r}::DOUBLE) % 1 AS u{j}" for j, s in enumerate(STEPS, 1))
    return f"""{_DRIVER}, ks AS (SELECT *, {frac} FROM (SELECT unnest(range(0, {draws})) AS k)), zs AS (SELECT k, {u} FROM ks),
dr AS (SELECT cy, cx, k, m_t + s_t * z1 AS t, m_td + s_td * (r1 * z1 + l22 * z2) AS td, exp(m_w + s_w * (r2 * z1 + l32 * z2 + l33 * z3)) AS p FROM ch, zs WHERE valid),
de AS (SELECT *, {_SVP.format("td")} AS e, {_SVP.format("t")} AS es FROM dr), dm AS (SELECT *, CASE WHEN e > 0 AND p > 0 AND e < p THEN 0.622::DOUBLE * e / (p - e) END AS r, 100 * e / es AS rh_raw FROM de),
sim AS (SELECT *, CASE WHEN rh_raw IS NOT NULL THEN least(greatest(rh_raw, 0), 100) END AS rh, r / (1 + r) AS q FROM dm)"""


SQL: dict[str, str] = {
    "correlation_factors": f"WITH {_DRIVER} SELECT cy, cx, n, valid, {', '.join(f'round({c}, 9) AS {c}' for c in ('r1', 'r2', 'r3', 'least', 'l22', 'l32', 'l33'))} FROM ch",
    "simulated_moisture": f"""WITH {_drawn_sql(DRAWS)} SELECT cy, cx, count(*) AS draws, count(q) AS n_q, {", ".join(f"round(avg({v}), 7) AS mean_{v}, round(stddev_samp({v}), 7) AS std_{v}" for v in ("rh", "e", "q"))},
  count(*) FILTER (rh_raw > 100) / count(*) AS supersaturation_fraction, count(*) FILTER (e >= p) / count(*) AS invalid_fraction FROM sim GROUP BY cy, cx HAVING count(q) >= {LEAST}""",
    "nearest_correlations": f"""WITH {_NEAREST} SELECT slot, cy, cx, ec < -1e-9 AS repaired, {", ".join(f"round(CASE WHEN ec < 0 THEN (r{k} - ec * q{i}{j}) / sqrt((1 - ec * q{i}{i}) * (1 - ec * q{j}{j})) ELSE r{k} END, 6) + 0 AS near_{k}" for k, (i, j) in enumerate(((1, 2), (1, 3), (2, 3)), 1))} FROM q""",
    "slot_simulation": f"""WITH {_drawn_sql(SLOT_DRAWS).replace(_DRIVER, _SLOT_DRIVER).replace("dr AS (SELECT cy, cx, k,", "dr AS (SELECT slot, cy, cx, k,")},
ok AS (SELECT * FROM sim WHERE rh IS NOT NULL AND r IS NOT NULL), fr AS (SELECT slot, cy, cx, count(*) FILTER (rh_raw > 100) AS sup, count(*) FILTER (e >= p) AS bad FROM sim GROUP BY ALL),
mm AS (SELECT slot, cy, cx, count(*) AS n, {", ".join(f"avg({v}) AS m_{v}" for v in ("rh", "e", "r", "q"))} FROM ok GROUP BY ALL HAVING count(*) >= {LEAST}),
ws AS (SELECT slot, cy, cx, any_value(n) AS n, {", ".join(f"any_value(m_{v}) AS m_{v}, min({v}) AS a_{v}, max({v}) AS b_{v}, " + ", ".join(f"sum(({v} - m_{v}) ** {k}) AS s{k}_{v}" for k in (2, 3, 4)) for v in ("rh", "e", "r", "q"))} FROM ok JOIN mm USING (slot, cy, cx) GROUP BY ALL),
lw AS (SELECT slot, cy, cx, n, {", ".join(f"unnest([{', '.join(t.format(v) for v in ('rh', 'e', 'r', 'q'))}]) AS {name}" for name, t in (("variable", "'{0}'"), ("mean", "m_{0}"), ("low", "a_{0}"), ("high", "b_{0}"), ("m2", "s2_{0}"), ("m3", "s3_{0}"), ("m4", "s4_{0}")))} FROM ws)
SELECT slot, cy, cx, variable, n, round(mean, 7) + 0 AS mean, round(sqrt(m2 / (n - 1)), 7) + 0 AS std,
  CASE WHEN high - low > 1e-9 * abs(high) THEN round(sqrt(n * (n - 1)) / (n - 2) * (m3 / n) / pow(m2 / n, 1.5), 3) + 0 END AS skew,
  CASE WHEN high - low > 1e-9 * abs(high) THEN round((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * n * m4 / (m2 * m2) - 3 * (n - 1)), 1) + 0 END AS kurt,
  round(sup / n, 7) AS supersaturation_fraction, round(bad / {SLOT_DRAWS}, 7) AS invalid_fraction FROM lw JOIN fr USING (slot, cy, cx)""",
    "convergence": f"""WITH {_drawn_sql(max(LADDER))}, ld AS (SELECT unnest([100, 200, 500]) AS draws), s AS (SELECT cy, cx, draws, count(rh) AS n, avg(rh) AS m, stddev_samp(rh) AS s FROM sim JOIN ld ON k < draws GROUP BY ALL)
SELECT cy, cx, draws, n, round(m, 7) AS mean, round(s, 7) AS std, round(s / sqrt(n), 8) AS error FROM s""",
}
