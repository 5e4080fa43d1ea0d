"""Jobs over the samples of slots' windows: the samples, their fits on the grid and by tile, and copula families at sample points and mid-months."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dewfall.functions import calendar
from dewfall.jobs.distributions import _HOURS, _scored, _sql_quantile, hours
from dewfall.jobs.oracles import MOIST
from dewfall.operators import fits, pooled
from dewfall.sources.observations import observations
from dewfall.sources.states import scratch

#: Families whose parameters follow from moments: the grid's fits.
QUICK = ("Normal", "SkewNormalMoments")
#: Years without which a decade's diagnostic means nothing; pairs that copulas are compared on.
LEAST_YEARS, LEAST_PAIRS = 5, 40
#: One-parameter families, whose fits SQL can search for as well.
SINGLE = ("Gaussian", "Clayton", "Gumbel", "Frank")
TILE = 2
POINTS = "cy int, cx int, slot int, family string, n long, params array<double>, ll double, aic double, aicc double, bic double"


def _years(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    told = observations(spark, sf_dir).agg(F.min(F.year("d")).alias("a"), F.max(F.year("d")).alias("b")).first()
    return told.a or 0, told.b or 0


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day blocks of relative humidity as a share and specific humidity, rounded so that ties are the same in any order of adding."""
    return pooled.day_blocks(hours(spark, sf_dir).select("cy", "cx", "d", F.round(F.col("rh") / 100, 9).alias("rh"), F.round("q", 11).alias("q")), ("rh", "q"))


def pooled_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and sums of the sample of each cell and slot, after it has been put together from blocks."""
    dealt = pooled.dealt(_blocks(spark, sf_dir), *_years(spark, sf_dir))
    work = lambda key, x: [(*key, len(x), float(x[:, 0].sum()), float(x[:, 1].sum()), float((x[:, 0] * x[:, 1]).sum()))]
    out = pooled.grouped_samples(dealt, work, "cy int, cx int, slot int, n long, s_rh double, s_q double, s_rhq double")
    return out.select("cy", "cx", "slot", "n", *(F.round(c, k).alias(c) for c, k in (("s_rh", 9), ("s_q", 11), ("s_rhq", 8))))


def pooled_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best marginal of both variables and the correlation of normal scores for each cell and slot, with status."""
    found = pooled.fitted(pooled.dealt(_blocks(spark, sf_dir), *_years(spark, sf_dir)), QUICK)
    return _shown(found)


def _shown(found: DataFrame, *more: str) -> DataFrame:
    place = lambda v, k: (F.round(F.col(f"{v}_params")[k], 6) + 0.0).alias(f"{v}_{k}")
    return found.select("cy", "cx", "slot", *more, "n", "rh_name", "q_name", *(place(v, k) for v in ("rh", "q") for k in range(3)), F.round("rho", 8).alias("rho"), "status")


def tiled_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fits written by tile and run of slots, merged by compact slot. The first tile is then fitted and written again: it replaces itself, the others stay."""
    folder, dealt = scratch(spark, "tiles"), pooled.dealt(_blocks(spark, sf_dir), *_years(spark, sf_dir))
    pooled.write_tiles(pooled.fitted(dealt, QUICK), folder, TILE)
    pooled.write_tiles(pooled.fitted(dealt.where(f"cy < {TILE} and cx < {TILE} and chunk = 0"), QUICK), folder, TILE)
    return _shown(pooled.merge_tiles(spark, folder, TILE), "compact")


def sample_places(size: int, count: int) -> list[int]:
    """`count` places spread over 0 to size - 1, ends included, halves to even, without repeats."""
    return sorted({int(np.round(x)) for x in np.linspace(0, size - 1, count)}) if size else []


def point_blocks(spark: SparkSession, sf_dir: str, along_y: int = 3, along_x: int = 3) -> DataFrame:
    """Dealt blocks of the sample points for the slots of mid-months; an error with under LEAST_YEARS years."""
    first, last = _years(spark, sf_dir)
    if 0 < last - first + 1 < LEAST_YEARS:
        raise ValueError(f"{last - first + 1} years are too few for a diagnostic; {LEAST_YEARS} are needed")
    size = observations(spark, sf_dir).agg(F.max("cy").alias("y"), F.max("cx").alias("x")).first()
    ys, xs = (sample_places((n if n is not None else -1) + 1, k) for n, k in ((size.y, along_y), (size.x, along_x)))
    blocks = _blocks(spark, sf_dir).where(F.col("cy").isin(ys) & F.col("cx").isin(xs))
    slots = [r.slot for r in calendar.calendar(spark).where("day = 15").collect()]  # twelve
    return pooled.dealt(blocks, first, last, slots)


def _copulas(families: Sequence[str]):
    def work(key: tuple[int, int, int], x: np.ndarray) -> list[tuple]:
        n = len(x)
        if n < LEAST_PAIRS:
            return []
        u, v = (np.clip(pd.Series(x[:, k]).rank().to_numpy() / (n + 1), 1e-10, 1 - 1e-10) for k in (0, 1))
        return [(*key, *_scored_pair(f, u, v, n)) for f in families]

    return work


def _scored_pair(family: str, u: np.ndarray, v: np.ndarray, n: int) -> tuple:
    run, k = fits.COPULAS[family]
    name, params, _, ll, aic, aicc, bic = _scored(family, *run(u, v), n, k)
    return name, n, params, ll, aic, aicc, bic


def point_copulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-parameter copulas of both variables at each sample point and mid-month with LEAST_PAIRS pairs or more, and how far each is behind the best by bic."""
    found = pooled.grouped_samples(point_blocks(spark, sf_dir), _copulas(SINGLE), POINTS)
    behind = F.col("bic") - F.min("bic").over(Window.partitionBy("cy", "cx", "slot"))
    return found.select("cy", "cx", "slot", "family", "n", (F.round(F.col("params")[0], 2) + 0.0).alias("theta"), (F.round("ll", 4) + 0.0).alias("ll"), F.round("bic", 4).alias("bic"), F.round(behind, 4).alias("delta_bic"))


def point_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of all five families by bic and by aic at each sample point and mid-month, with its parameters."""
    found = pooled.grouped_samples(point_blocks(spark, sf_dir), _copulas(tuple(fits.COPULAS)), POINTS)
    least = lambda c: F.min_by(F.struct("family", "params"), F.struct(c, "family"))
    out = found.groupBy("cy", "cx", "slot").agg(F.first("n").alias("n"), least("bic").alias("b"), least("aic").alias("a"))
    return out.select("cy", "cx", "slot", "n", F.col("b.family").alias("winner_bic"), F.col("b.params").alias("params"), F.col("a.family").alias("winner_aic"))


# ---- SQL ----

_SLOT_OF = """CASE WHEN month({0}) = 2 AND day({0}) >= 28 THEN 60 WHEN dayofyear({0}) < 59 THEN dayofyear({0})
  ELSE dayofyear({0}) + CASE WHEN (year({0}) % 4 = 0 AND year({0}) % 100 <> 0) OR year({0}) % 400 = 0 THEN 0 ELSE 1 END END"""
_SAMPLES = f"""{MOIST}, {_HOURS}, yr AS (SELECT min(year(d)) AS y0, max(year(d)) AS y1 FROM obs),
b AS (SELECT cy, cx, d, round(rh / 100, 9) AS rh, round(q, 11) AS q FROM hr WHERE rh IS NOT NULL AND q IS NOT NULL),
tg AS (SELECT *, CAST(d + k AS DATE) AS target FROM b, (SELECT unnest([-2, -1, 0, 1, 2]) AS k)),
sm AS (SELECT cy, cx, CAST({_SLOT_OF.format("target")} AS INTEGER) AS slot, rh, q FROM tg, yr WHERE year(target) BETWEEN y0 AND y1)"""
# The published rational form of the normal distribution function, numerator and denominator from the highest power.
_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_BOTTOM = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def _poly(x: str, c: Sequence[float]) -> str:
    out = f"({c[0]!r}::DOUBLE)"
    for k in c[1:]:
        out = f"({out} * {x} + ({k!r}::DOUBLE))"
    return out


def _log_phi(x: str) -> str:
    y = f"abs({x})"
    far = f"-ln({y} + 1 / ({y} + 2 / ({y} + 3 / ({y} + 4 / ({y} + 0.65))))) - ln(2.506628274631::DOUBLE)"
    tail = f"(-{y} * {y} / 2 + CASE WHEN {y} < 7.07106781186547 THEN ln({_poly(y, _TOP)} / {_poly(y, _BOTTOM)}) ELSE {far} END)"
    return f"CASE WHEN {x} > 0 THEN ln(1 - exp({tail})) ELSE {tail} END"


_RANKED = "(rank() OVER (PARTITION BY cy, cx, slot ORDER BY {0}) + (count(*) OVER (PARTITION BY cy, cx, slot, {0}) - 1) / 2)"
_FITS = f"""{_SAMPLES}, lg AS (SELECT cy, cx, slot, unnest(['rh', 'q']) AS v, unnest([rh, q]) AS x FROM sm),
m0 AS (SELECT cy, cx, slot, v, count(*) AS n, avg(x) AS m, stddev_pop(x) AS s FROM lg GROUP BY ALL HAVING count(*) >= 30 AND stddev_pop(x) > 0),
m1 AS (SELECT cy, cx, slot, v, any_value(n) AS n, any_value(m) AS m, any_value(s) AS s, avg(((x - m) / s) ** 3) AS g FROM lg JOIN m0 USING (cy, cx, slot, v) GROUP BY ALL),
m2 AS (SELECT *, least(greatest(CASE WHEN abs(g) < 0.99 THEN g / sqrt(1 + (2 / pi() - 1) * g * g) ELSE 0 END, -0.999999), 0.999999) AS dl FROM m1),
m3 AS (SELECT *, s / sqrt(1 - 2 * dl * dl / pi()) AS om, CASE WHEN abs(dl) < 0.999 THEN dl / sqrt(1 - dl * dl) ELSE 0 END AS al FROM m2), m4 AS (SELECT *, m - om * dl * sqrt(2 / pi()) AS xi FROM m3),
l1 AS (SELECT cy, cx, slot, v, sum(ln(2) - ln(om) - 0.5 * ln(2 * pi()) - 0.5 * ((x - xi) / om) ** 2 + {_log_phi("(al * (x - xi) / om)")}) AS ll3 FROM lg JOIN m4 USING (cy, cx, slot, v) GROUP BY ALL),
sc AS (SELECT *, n * (ln(2 * pi() * s * s) + 1) + 4 + 12 / (n - 3) AS a2, 6 - 2 * ll3 + 24 / (n - 4) AS a3 FROM m4 JOIN l1 USING (cy, cx, slot, v)),
bs AS (SELECT cy, cx, slot, v, CASE WHEN a2 <= a3 THEN 'Normal' ELSE 'SkewNormalMoments' END AS name, CASE WHEN a2 <= a3 THEN m ELSE al END AS p0, CASE WHEN a2 <= a3 THEN s ELSE xi END AS p1, CASE WHEN a2 <= a3 THEN NULL ELSE om END AS p2 FROM sc),
uv AS (SELECT cy, cx, slot, least(greatest(({_RANKED.format("rh")} - 0.5) / count(*) OVER (PARTITION BY cy, cx, slot), 1e-10), 1 - 1e-10) AS u,
  least(greatest(({_RANKED.format("q")} - 0.5) / count(*) OVER (PARTITION BY cy, cx, slot), 1e-10), 1 - 1e-10) AS w FROM sm),
zz AS (SELECT cy, cx, slot, {_sql_quantile("u")} AS a, {_sql_quantile("w")} AS b FROM uv), rr AS (SELECT cy, cx, slot, count(*) AS n, least(greatest(corr(a, b), -0.9999), 0.9999) AS rho FROM zz GROUP BY ALL),
ft AS (SELECT rr.cy, rr.cx, rr.slot, rr.n, h.name AS rh_name, k.name AS q_name, {", ".join(f"round({t}.p{i}, 6) + 0 AS {v}_{i}" for v, t in (("rh", "h"), ("q", "k")) for i in range(3))},
  CASE WHEN rr.n >= 30 THEN round(rho, 8) END AS rho, CASE WHEN rr.n < 30 THEN 'insufficient_data' WHEN h.name IS NULL OR k.name IS NULL THEN 'fit_failed' ELSE 'ok' END AS status
  FROM rr LEFT JOIN (SELECT * FROM bs WHERE v = 'rh') h USING (cy, cx, slot) LEFT JOIN (SELECT * FROM bs WHERE v = 'q') k ON rr.cy = k.cy AND rr.cx = k.cx AND rr.slot = k.slot)"""


def _loss(family: str, t: str) -> str:
    """Negative log-likelihood of a list `xs` of (u, v) structs at t."""
    of = {
        "Clayton": "ln(1 + {t}) - ({t} + 1) * (ln(p.u) + ln(p.v)) - (2 + 1 / {t}) * ln(pow(p.u, -{t}) + pow(p.v, -{t}) - 1)",
        "Gumbel": "-pow(pow(-ln(p.u), {t}) + pow(-ln(p.v), {t}), 1 / {t}) - ln(p.u) - ln(p.v) + ({t} - 1) * ln(ln(p.u) * ln(p.v)) + (1 / {t} - 2) * ln(pow(-ln(p.u), {t}) + pow(-ln(p.v), {t})) + ln(pow(pow(-ln(p.u), {t}) + pow(-ln(p.v), {t}), 1 / {t}) + {t} - 1)",
        "Frank": "ln({t} * (1 - exp(-{t})) * exp(-{t} * (p.u + p.v))) - 2 * ln(abs(1 - exp(-{t}) - (1 - exp(-{t} * p.u)) * (1 - exp(-{t} * p.v))))",
    }[family]
    return f"-list_sum(list_transform(xs, lambda p: {of.format(t=t)}))"


def _search(name: str, family: str, low: float, high: float, steps: int = 56) -> str:
    """CTEs that narrow [low, high] of every sample to its least loss: a grid, then golden sections."""
    r = (5**0.5 - 1) / 2
    grid = f"list_transform(range(0, 33), lambda i: {low!r}::DOUBLE + i * ({high!r}::DOUBLE - {low!r}::DOUBLE) / 32)"
    x, y = (f"({e})" for e in (f"b - {r!r}::DOUBLE * (b - a)", f"a + {r!r}::DOUBLE * (b - a)"))
    return f"""{name}_g AS (SELECT cy, cx, slot, n, xs, {grid} AS gs FROM pt), {name}_l AS (SELECT *, list_transform(gs, lambda t: {_loss(family, 't')}) AS fs FROM {name}_g),
{name}_k AS (SELECT *, list_position(fs, list_min(fs)) AS k FROM {name}_l),
{name}_s AS (SELECT 0 AS step, cy, cx, slot, n, xs, gs[greatest(k - 1, 1)] AS a, gs[least(k + 1, 33)] AS b FROM {name}_k
  UNION ALL SELECT step + 1, cy, cx, slot, n, xs, CASE WHEN fx < fy THEN a ELSE x END, CASE WHEN fx < fy THEN y ELSE b END
  FROM (SELECT *, {_loss(family, 'x')} AS fx, {_loss(family, 'y')} AS fy FROM (SELECT *, {x} AS x, {y} AS y FROM {name}_s WHERE step < {steps}))),
{name}_f AS (SELECT cy, cx, slot, '{family}' AS family, n, (a + b) / 2 AS theta, -({_loss(family, '((a + b) / 2)')}) AS ll FROM {name}_s WHERE step = {steps})"""


_POINTS = f"""{_SAMPLES}, gr AS (SELECT max(cy) + 1 AS ny, max(cx) + 1 AS nx FROM obs), ay AS (SELECT unnest(list_distinct([0, CAST(round_even((ny - 1) / 2, 0) AS INTEGER), ny - 1])) AS cy FROM gr),
ax AS (SELECT unnest(list_distinct([0, CAST(round_even((nx - 1) / 2, 0) AS INTEGER), nx - 1])) AS cx FROM gr),
ps AS (SELECT * FROM sm WHERE slot IN (15, 46, 75, 106, 136, 167, 197, 228, 259, 289, 320, 350) AND cy IN (SELECT cy FROM ay) AND cx IN (SELECT cx FROM ax)),
pu AS (SELECT cy, cx, slot, least(greatest({_RANKED.format("rh")} / (count(*) OVER (PARTITION BY cy, cx, slot) + 1), 1e-10), 1 - 1e-10) AS u,
  least(greatest({_RANKED.format("q")} / (count(*) OVER (PARTITION BY cy, cx, slot) + 1), 1e-10), 1 - 1e-10) AS v FROM ps),
pt AS (SELECT cy, cx, slot, count(*) AS n, list(struct_pack(u := u, v := v)) AS xs FROM pu GROUP BY ALL HAVING count(*) >= {LEAST_PAIRS}),
gz AS (SELECT cy, cx, slot, {_sql_quantile("u")} AS a, {_sql_quantile("v")} AS b FROM pu),
gs AS (SELECT cy, cx, slot, count(*) AS n, least(greatest(corr(a, b), -0.999), 0.999) AS r, sum(a * a + b * b) AS ss, sum(a * b) AS ab FROM gz GROUP BY ALL HAVING count(*) >= {LEAST_PAIRS}),
gf AS (SELECT cy, cx, slot, 'Gaussian' AS family, n, r AS theta, -n / 2 * ln(1 - r * r) - (r * r * ss - 2 * r * ab) / (2 * (1 - r * r)) AS ll FROM gs)"""
SQL: dict[str, str] = {
    "pooled_samples": f"WITH {_SAMPLES} SELECT cy, cx, slot, count(*) AS n, round(sum(rh), 9) AS s_rh, round(sum(q), 11) AS s_q, round(sum(rh * q), 8) AS s_rhq FROM sm GROUP BY ALL",
    "pooled_fits": f"WITH {_FITS} SELECT * FROM ft",
    "tiled_fits": f"WITH {_FITS} SELECT *, CAST(CASE WHEN slot < 59 THEN slot - 1 ELSE slot - 2 END AS INTEGER) AS compact FROM ft",
    "point_copulas": f"""WITH RECURSIVE {_POINTS}, {_search("cl", "Clayton", 1e-4, 50.0)}, {_search("gu", "Gumbel", 1.0, 20.0)}, {_search("fn", "Frank", -30.0, -0.05)}, {_search("fp", "Frank", 0.05, 30.0)},
ff AS (SELECT cy, cx, slot, family, n, arg_max(theta, ll) AS theta, max(ll) AS ll FROM (SELECT * FROM fn_f UNION ALL SELECT * FROM fp_f) GROUP BY ALL),
al AS (SELECT *, ln(n) - 2 * ll AS bic FROM (SELECT * FROM gf UNION ALL SELECT * FROM cl_f UNION ALL SELECT * FROM gu_f UNION ALL SELECT * FROM ff))
SELECT cy, cx, slot, family, n, round(theta, 2) + 0 AS theta, round(ll, 4) + 0 AS ll, round(bic, 4) AS bic, round(bic - min(bic) OVER (PARTITION BY cy, cx, slot), 4) AS delta_bic FROM al""",
}
#: Student's family is searched over two parameters and quantiles that SQL lacks; tests check it.
UNCHECKED = ("point_winners",)
