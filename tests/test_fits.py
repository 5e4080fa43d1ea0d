"""Fits recover what samples were drawn from, and beat the likelihood of the true parameters."""

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from dewfall.jobs import distributions
from dewfall.operators import fits

SF = "/root/testdata/sf0.01"
rng = np.random.default_rng(31)


def test_normal_quantile(spark):
    us = [1e-9, 0.001, 0.02425, 0.3, 0.5, 0.77, 0.98, 1 - 1e-7]
    df = spark.createDataFrame([(u,) for u in [*us, 0.0, 1.0]], "u double")
    got = [r[0] for r in df.select(fits.normal_quantile(F.col("u"))).collect()]
    want = [statistics.NormalDist().inv_cdf(u) for u in us]
    assert got[:-2] == pytest.approx(want, rel=1e-8, abs=1e-8)
    assert got[-2:] == [None, None]
    assert fits.quantile(np.array(us)) == pytest.approx(want, rel=1e-8, abs=1e-8)


def test_criteria(spark):
    df = spark.createDataFrame([(-10.0, 40), (-10.0, 3)], "ll double, n long")
    aic, bic, aicc = ([r[c] for r in df.select(*(v.alias(k) for k, v in fits.criteria(F.col("ll"), F.col("n"), 2).items())).collect()] for c in ("aic", "bic", "aicc"))
    assert aic == [24.0, 24.0] and bic[0] == pytest.approx(2 * math.log(40) + 20)
    assert aicc == [pytest.approx(24 + 12 / 37), float("inf")]


def test_bivariate_density(spark):
    df = spark.createDataFrame([(0.3, -0.4, 0.5), (0.0, 0.0, 1.0), (0.0, 0.0, 0.0)], "x double, y double, r double")
    one, zero = F.lit(1.0), F.lit(0.0)
    got = [r[0] for r in df.select(fits.bivariate_normal_density(F.col("x"), F.col("y"), zero, zero, one, one, F.col("r"))).collect()]
    assert got[0] == pytest.approx(math.exp(-(0.09 + 0.16 + 0.12) / 1.5) / (2 * math.pi * math.sqrt(0.75)))
    assert got[1] is None and got[2] == pytest.approx(1 / (2 * math.pi))


def test_skew_normal():
    u, v = rng.normal(size=4000), rng.normal(size=4000)
    x = 2 + 1.5 * (0.9 * np.abs(u) + math.sqrt(1 - 0.81) * v)
    truth = -fits.skew_normal_loss(np.array([0.9 / math.sqrt(0.19), 2, math.log(1.5)]), x)
    p, ll = fits.skew_normal_fit(x)
    assert ll >= truth - 0.5 and p == pytest.approx([0.9 / math.sqrt(0.19), 2, 1.5], rel=0.25)
    assert fits.skew_normal_by_moments(x)[1] <= ll + 1e-6
    assert fits.skew_normal_by_moments(-x)[0][0] < 0


@pytest.mark.parametrize("sign", [1, -1])
def test_pearson_three(sign):
    x = sign * (rng.gamma(4.0, 2.0, 3000) - 8)
    p, ll = fits.pearson3_fit(x)
    assert p == pytest.approx([sign * 1.0, 0.0, 4.0], abs=0.35)
    assert ll > fits.normal_fit(x)[1]


def test_beta():
    p, _ = fits.beta_fit(rng.beta(2.0, 5.0, 4000))
    assert p == pytest.approx([2, 5], rel=0.12)


def test_bimodal():
    x = np.r_[rng.normal(-3, 1, 1500), rng.normal(4, 2, 1000)]
    p, ll = fits.bimodal_fit(x, starts=3)
    assert p == pytest.approx([0.6, -3, 4, 1, 2], rel=0.15)
    assert ll > fits.normal_fit(x)[1] and fits.ashman(p) > 4 and 0 <= fits.overlap(p) < 0.05
    assert fits.overlap([0.5, 1.0, 1.0, 2.0, 2.0]) == pytest.approx(0.5, abs=1e-3)


def pairs(rho, n=3000):
    a = rng.normal(size=n)
    b = rho * a + math.sqrt(1 - rho * rho) * rng.normal(size=n)
    return tuple(np.array([statistics.NormalDist().cdf(v) for v in x]) for x in (a, b))


def test_gaussian_copula_and_student():
    u, v = pairs(-0.6)
    (rho,), ll = fits.gaussian_copula(u, v)
    assert rho == pytest.approx(-0.6, abs=0.05)
    (r, nu), st = fits.student_copula(u[:800], v[:800])
    assert r == pytest.approx(-0.6, abs=0.08) and nu > 8
    assert fits.student_quantile(np.array([0.975, 0.5]), 5.0) == pytest.approx([2.5706, 0.0], abs=0.01)


def test_clayton():
    u, w = rng.uniform(size=3000), rng.uniform(size=3000)
    v = (u**-2.0 * (w ** (-2.0 / 3.0) - 1) + 1) ** (-1 / 2.0)
    assert fits.clayton_copula(u, v)[0][0] == pytest.approx(2.0, rel=0.12)
    assert fits.clayton_copula(u, v)[1] > max(fits.gumbel_copula(u, v)[1], fits.frank_copula(u, v)[1])


@pytest.mark.parametrize("theta", [5.0, -5.0])
def test_frank_of_both_signs(theta):
    u, w = rng.uniform(size=3000), rng.uniform(size=3000)
    v = -np.log1p(w * np.expm1(-theta) / (w * (1 - np.exp(-theta * u)) + np.exp(-theta * u))) / theta
    assert fits.frank_copula(u, v)[0][0] == pytest.approx(theta, rel=0.12)


def test_gumbel_of_independence():
    u, v = rng.uniform(size=2000), rng.uniform(size=2000)
    (t,), ll = fits.gumbel_copula(u, v)
    assert t == pytest.approx(1.0, abs=0.06) and abs(ll) < 3


def test_group_fits(spark, monkeypatch):
    """Two groups: one of enough pairs, one too small."""
    n = 240
    a = rng.normal(size=n)
    rows = [(1, 0, 0, float(60 + 8 * x), float(0.01 + 0.001 * (x + y))) for x, y in zip(a, rng.normal(size=n))] + [(2, 0, 0, 50.0 + k, 0.01 + k / 1e4) for k in range(20)]
    df = spark.createDataFrame(rows, "month int, cy int, cx int, rh double, q double")
    monkeypatch.setattr(distributions, "hours", lambda *_: df)
    got = distributions.window_fits(spark, SF).collect()
    assert {(r.family, r.status) for r in got if r.month == 2} == {("none", "insufficient_data")}
    ok = [r for r in got if r.month == 1]
    assert all(r.status == "ok" and len(r.params) == {"Normal": 2, "Beta": 2, "BimodalNormal": 5}.get(r.family, 3) for r in ok)
    assert {r.family for r in ok} == set(fits.MARGINALS)
    best = {r.variable: r.aicc for r in distributions.best_fits(spark, SF).collect()}
    assert best == {v: min(r.aicc for r in ok if r.variable == v) for v in ("rh_fraction", "q")}
    copulas = distributions.copula_fits(spark, SF).collect()
    assert {r.month for r in copulas} == {1} and {r.family for r in copulas} == set(fits.COPULAS)
    assert min(r.delta_bic for r in copulas) == 0
    margin = distributions.copula_margins(spark, SF).first()
    assert margin.margin == pytest.approx(sorted(r.delta_bic for r in copulas)[1]) and margin.decisive == (margin.margin >= 10)
