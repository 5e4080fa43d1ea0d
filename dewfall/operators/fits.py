"""Distribution fits: criteria, normal quantiles and Gaussian copulas as columns; iterative likelihoods for one group at a time.

A group is the sample of one cell and calendar window, bounded by hours a window and years, so a task holds it whole."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the published rational approximation of the normal quantile (relative error 1.15e-9).
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
_LOW = 0.02425


def _poly(x, coefficients):
    out = coefficients[0]
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_quantile(u: Column) -> Column:
    """The standard normal quantile of 0 < u < 1; null outside."""
    tail = lambda p: _poly(F.sqrt(-2 * F.log(p)), _C) / (_poly(F.sqrt(-2 * F.log(p)), _D) * F.sqrt(-2 * F.log(p)) + 1)
    q = u - 0.5
    middle = _poly(q * q, _A) * q / (_poly(q * q, _B) * q * q + 1)
    return F.when((u > 0) & (u < _LOW), tail(u)).when((u >= _LOW) & (u <= 1 - _LOW), middle).when((u > 1 - _LOW) & (u < 1), -tail(1 - u))


def criteria(ll: Column, n: Column, k: int) -> dict[str, Column]:
    """aic, bic and aicc of a fit with k parameters; aicc is infinite where n leaves no freedom."""
    aic = 2 * k - 2 * ll
    return {"aic": aic, "bic": k * F.log(F.greatest(n, F.lit(1)).cast("double")) - 2 * ll, "aicc": F.when(n > k + 1, aic + 2 * k * (k + 1) / (n - k - 1)).otherwise(F.lit(float("inf")))}


def bivariate_normal_density(x: Column, y: Column, mx: Column, my: Column, sx: Column, sy: Column, rho: Column) -> Column:
    """Null unless both deviations are above 0 and the correlation is inside -1 and 1."""
    a, b, rest = (x - mx) / sx, (y - my) / sy, 1 - rho * rho
    density = F.exp(-(a * a - 2 * rho * a * b + b * b) / (2 * rest)) / (2 * F.pi() * sx * sy * F.sqrt(rest))
    return F.when((sx > 0) & (sy > 0) & (F.abs(rho) < 1), density)


# ---- iterative fits of one sample ----


def golden(f: Callable[[float], float], low: float, high: float, steps: int = 80) -> tuple[float, float]:
    """(x, f(x)) at a minimum of f between low and high: a coarse grid, then golden sections around its best point."""
    grid = np.linspace(low, high, 33)
    k = int(np.argmin([f(x) for x in grid]))
    a, b = grid[max(k - 1, 0)], grid[min(k + 1, 32)]
    r = (math.sqrt(5) - 1) / 2
    x, y = b - r * (b - a), a + r * (b - a)
    fx, fy = f(x), f(y)
    for _ in range(steps):
        if fx < fy:
            b, y, fy = y, x, fx
            x = b - r * (b - a)
            fx = f(x)
        else:
            a, x, fx = x, y, fy
            y = a + r * (b - a)
            fy = f(y)
        if b - a < 1e-10 * (1 + abs(a)):
            break
    best = (a + b) / 2
    return best, f(best)


def simplex(f: Callable[[np.ndarray], float], start: np.ndarray, step: float = 0.25, rounds: int = 600, tol: float = 1e-9) -> tuple[np.ndarray, float]:
    """(x, f(x)) by the downhill simplex of reflections, expansions and contractions."""
    n = len(start)
    points = [np.array(start, float)] + [start + step * np.eye(n)[k] * (1 + abs(start[k])) for k in range(n)]
    values = [f(p) for p in points]
    for _ in range(rounds):
        order = np.argsort(values)
        points, values = [points[k] for k in order], [values[k] for k in order]
        if abs(values[-1] - values[0]) <= tol * (1 + abs(values[0])):
            break
        middle = np.mean(points[:-1], axis=0)
        away = middle + (middle - points[-1])
        v = f(away)
        if v < values[0]:
            far = middle + 2 * (middle - points[-1])
            w = f(far)
            points[-1], values[-1] = (far, w) if w < v else (away, v)
        elif v < values[-2]:
            points[-1], values[-1] = away, v
        else:
            near = middle + 0.5 * ((away if v < values[-1] else points[-1]) - middle)
            w = f(near)
            if w < min(v, values[-1]):
                points[-1], values[-1] = near, w
            else:
                points = [points[0]] + [points[0] + 0.5 * (p - points[0]) for p in points[1:]]
                values = [values[0]] + [f(p) for p in points[1:]]
    k = int(np.argmin(values))
    return points[k], values[k]


#: Places, values and slopes of log_phi between -20 and 20, from the library's erfc; a cubic through two places is off by less than 1e-10.
_AT = np.linspace(-20, 20, 4_001)
_LOG_PHI = np.array([math.log(0.5 * math.erfc(-v / math.sqrt(2))) for v in _AT])
_SLOPE = np.exp(-0.5 * _AT * _AT - 0.5 * math.log(2 * math.pi) - _LOG_PHI)


def log_phi(x: np.ndarray) -> np.ndarray:
    """Log of the standard normal distribution function: a table between -20 and 20, the tail's series below, 0 above."""
    step = _AT[1] - _AT[0]
    inner = np.clip(x, -20, 20)
    k = np.minimum(((inner + 20) / step).astype(int), len(_AT) - 2)
    t = (inner - _AT[k]) / step
    low, high = (1 + 2 * t) * (1 - t) ** 2, t * t * (3 - 2 * t)
    near = low * _LOG_PHI[k] + high * _LOG_PHI[k + 1] + step * t * (1 - t) * ((1 - t) * _SLOPE[k] - t * _SLOPE[k + 1])
    far = np.minimum(x, -20.0)
    tail = -0.5 * far * far - np.log(-far) - 0.5 * math.log(2 * math.pi) + np.log1p(-1 / far**2 + 3 / far**4 - 15 / far**6)
    return np.where(x >= 20, 0.0, np.where(x > -20, near, tail))


def normal_fit(x: np.ndarray) -> tuple[list[float], float]:
    s = x.std()
    return [x.mean(), s], -len(x) / 2 * (math.log(2 * math.pi * s * s) + 1)


def skew_normal_by_moments(x: np.ndarray) -> tuple[list[float], float]:
    """(shape, location, scale) from mean, deviation and skewness; no skew where the skewness is beyond the family."""
    m, s = x.mean(), x.std()
    g = float((((x - m) / s) ** 3).mean())
    delta = g / math.sqrt(1 + (2 / math.pi - 1) * g * g) if abs(g) < 0.99 else 0.0
    delta = max(-0.999999, min(0.999999, delta))
    omega = s / math.sqrt(1 - 2 * delta * delta / math.pi)
    shape = delta / math.sqrt(1 - delta * delta) if abs(delta) < 0.999 else 0.0
    p = [shape, m - omega * delta * math.sqrt(2 / math.pi), omega]
    return p, -skew_normal_loss(np.array([p[0], p[1], math.log(p[2])]), x)


def skew_normal_loss(p: np.ndarray, x: np.ndarray) -> float:
    z = (x - p[1]) / math.exp(p[2])
    return float(-(math.log(2) - p[2] - 0.5 * math.log(2 * math.pi) - 0.5 * z * z + log_phi(p[0] * z)).sum())


def skew_normal_fit(x: np.ndarray) -> tuple[list[float], float]:
    start, _ = skew_normal_by_moments(x)
    p, loss = simplex(lambda p: skew_normal_loss(p, x), np.array([start[0], start[1], math.log(start[2])]))
    return [p[0], p[1], math.exp(p[2])], -loss


def pearson3_fit(x: np.ndarray) -> tuple[list[float], float]:
    """(skew, mean, deviation) of a shifted gamma distribution, also mirrored."""
    m, s = x.mean(), x.std()
    g = float((((x - m) / s) ** 3).mean())

    def loss(p: np.ndarray) -> float:
        skew, mean, dev = p[0], p[1], math.exp(p[2])
        if abs(skew) < 1e-4:
            z = (x - mean) / dev
            return float((0.5 * z * z + p[2] + 0.5 * math.log(2 * math.pi)).sum())
        alpha, beta = 4 / skew**2, abs(skew) * dev / 2
        y = (x - mean) * math.copysign(1, skew) / beta + alpha
        if y.min() <= 0:
            return 1e18 + float(-y.min())
        return float(-((alpha - 1) * np.log(y) - y - math.lgamma(alpha) - math.log(beta)).sum())

    first = max(-2.0, min(2.0, g)) or 0.1
    low = float((x.min() - m) / s if first > 0 else (m - x.max()) / s)
    first = math.copysign(min(abs(first), 1.9 / max(-low, 1e-3)), first)  # keeps the sample inside the support
    p, value = simplex(loss, np.array([first, m, math.log(s)]))
    return [p[0], p[1], math.exp(p[2])], -value


def digamma(x: float) -> tuple[float, float]:
    """The first and second derivative of log gamma: six steps up, then the asymptotic series."""
    first = second = 0.0
    for k in range(6):
        first -= 1 / (x + k)
        second += 1 / (x + k) ** 2
    y = x + 6
    z = 1 / (y * y)
    first += math.log(y) - 0.5 / y - z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z / 240)))
    second += 1 / y + 0.5 * z + z / y * (1 / 6 - z * (1 / 30 - z * (1 / 42 - z / 30)))
    return first, second


def beta_fit(x: np.ndarray) -> tuple[list[float], float]:
    """(a, b) on 0 to 1, values kept off the ends by max(1e-6, 0.5 / n); Newton steps from the moments, halved while they leave the positive range."""
    n = len(x)
    eps = max(1e-6, 0.5 / n)
    y = np.clip(x, eps, 1 - eps)
    u, v = float(np.log(y).mean()), float(np.log1p(-y).mean())
    m, s2 = float(y.mean()), float(y.var())
    k = max(m * (1 - m) / s2 - 1, 1e-3) if s2 > 0 else 1.0
    a, b = m * k, (1 - m) * k
    for _ in range(60):
        (pa, qa), (pb, qb), (pc, qc) = digamma(a), digamma(b), digamma(a + b)
        ga, gb = u - pa + pc, v - pb + pc
        haa, hbb, hab = qc - qa, qc - qb, qc
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        while a - da <= 0 or b - db <= 0:
            da, db = da / 2, db / 2
        a, b = a - da, b - db
        if abs(da) <= 1e-12 * a and abs(db) <= 1e-12 * b:
            break
    return [a, b], n * ((a - 1) * u + (b - 1) * v + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))


def bimodal_fit(x: np.ndarray, starts: int = 10, rounds: int = 1_000, tol: float = 1e-4, seed: int = 20260821) -> tuple[list[float], float]:
    """(weight of the first, means, deviations) of two normals in order of mean, by expectation maximisation from several starts."""
    rng, best = np.random.default_rng(seed), None
    s2 = x.var() + 1e-6
    for k in range(starts):
        mu = np.quantile(x, [0.25, 0.75]) if k == 0 else rng.choice(x, 2)
        w, var, old = np.array([0.5, 0.5]), np.array([s2, s2]), -math.inf
        for _ in range(rounds):
            z = -0.5 * (np.log(2 * math.pi * var) + (x[:, None] - mu) ** 2 / var) + np.log(np.maximum(w, 1e-300))
            top = z.max(axis=1)
            total = top + np.log(np.exp(z - top[:, None]).sum(axis=1))
            ll = total.sum()
            r = np.exp(z - total[:, None])
            n = r.sum(axis=0) + 1e-10
            w, mu = n / len(x), (r * x[:, None]).sum(axis=0) / n
            var = (r * (x[:, None] - mu) ** 2).sum(axis=0) / n + 1e-6
            if abs(ll - old) < tol:
                break
            old = ll
        if best is None or ll > best[1]:
            o = np.argsort(mu)
            best = ([w[o[0]], *mu[o], *np.sqrt(var[o])], float(ll))
    return best


def ashman(p: list[float]) -> float:
    """How far apart the two normals of a bimodal fit lie, in common deviations."""
    return abs(p[2] - p[1]) / math.sqrt((p[3] ** 2 + p[4] ** 2) / 2)


def overlap(p: list[float], points: int = 4_000) -> float:
    """The mass under both weighted normals, by trapezoids."""
    reach = 4 * max(p[3], p[4])
    at = np.linspace(min(p[1], p[2]) - reach, max(p[1], p[2]) + reach, points)
    both = [w / s * np.exp(-0.5 * ((at - m) / s) ** 2) / math.sqrt(2 * math.pi) for w, m, s in ((p[0], p[1], p[3]), (1 - p[0], p[2], p[4]))]
    return float(np.trapezoid(np.minimum(*both), at))


# ---- copulas of pseudo-observations u, v in (0, 1) ----


def student_quantile(u: np.ndarray, nu: float) -> np.ndarray:
    """Quantiles of Student's t, from its distribution function tabulated in the substitution t = sqrt(nu) tan(w)."""
    w = np.linspace(-math.pi / 2, math.pi / 2, 4_001)
    density = np.cos(w) ** (nu - 1)
    cdf = np.concatenate([[0], np.cumsum((density[1:] + density[:-1]) / 2)])
    return math.sqrt(nu) * np.tan(np.clip(np.interp(u, cdf / cdf[-1], w), -math.pi / 2 + 1e-9, math.pi / 2 - 1e-9))


def quantile(u: np.ndarray) -> np.ndarray:
    q = u - 0.5
    t = np.sqrt(-2 * np.log(np.minimum(u, 1 - u)))
    tail = _poly(t, _C) / (_poly(t, _D) * t + 1)
    return np.where(np.minimum(u, 1 - u) < _LOW, np.where(u < 0.5, tail, -tail), _poly(q * q, _A) * q / (_poly(q * q, _B) * q * q + 1))


def gaussian_copula(u: np.ndarray, v: np.ndarray) -> tuple[list[float], float]:
    a, b = quantile(u), quantile(v)
    rho = float(np.clip(np.corrcoef(a, b)[0, 1], -0.999, 0.999))
    rest = 1 - rho * rho
    return [rho], float((-0.5 * math.log(rest) - (rho * rho * (a * a + b * b) - 2 * rho * a * b) / (2 * rest)).sum())


def student_copula(u: np.ndarray, v: np.ndarray) -> tuple[list[float], float]:
    def loss(p: np.ndarray) -> float:
        rho, nu = 0.9999 * math.tanh(p[0]), 2 + math.exp(min(p[1], 6))
        a, b = student_quantile(u, nu), student_quantile(v, nu)
        rest = 1 - rho * rho
        joint = math.lgamma((nu + 2) / 2) + math.lgamma(nu / 2) - 2 * math.lgamma((nu + 1) / 2) - 0.5 * math.log(rest)
        z = np.log1p((a * a - 2 * rho * a * b + b * b) / (nu * rest))
        return float(-(joint - (nu + 2) / 2 * z + (nu + 1) / 2 * (np.log1p(a * a / nu) + np.log1p(b * b / nu))).sum())

    first = math.atanh(gaussian_copula(u, v)[0][0])
    p, value = min((simplex(loss, np.array([first, e]), rounds=150, tol=1e-7) for e in (0.7, 2.0, 3.5)), key=lambda r: r[1])
    return [0.9999 * math.tanh(p[0]), 2 + math.exp(min(p[1], 6))], -value


def clayton_copula(u: np.ndarray, v: np.ndarray) -> tuple[list[float], float]:
    lu, lv = np.log(u), np.log(v)

    def loss(t: float) -> float:
        m = np.maximum(-t * lu, -t * lv)
        inner = m + np.log(np.maximum(np.exp(-t * lu - m) + np.exp(-t * lv - m) - np.exp(-m), 1e-300))
        return float(-(math.log1p(t) - (t + 1) * (lu + lv) - (2 + 1 / t) * inner).sum())

    t, value = golden(loss, 1e-4, 50.0)
    return [t], -value


def gumbel_copula(u: np.ndarray, v: np.ndarray) -> tuple[list[float], float]:
    x, y = -np.log(u), -np.log(v)

    def loss(t: float) -> float:
        s = np.logaddexp(t * np.log(x), t * np.log(y))
        a = np.exp(s / t)
        return float(-(-a + x + y + (t - 1) * (np.log(x) + np.log(y)) + (1 / t - 2) * s + np.log(a + t - 1)).sum())

    t, value = golden(loss, 1.0, 20.0)
    return [t], -value


def frank_copula(u: np.ndarray, v: np.ndarray) -> tuple[list[float], float]:
    def loss(t: float) -> float:
        top = t * -math.expm1(-t) * np.exp(-t * (u + v))
        bottom = -math.expm1(-t) - np.expm1(-t * u) * np.expm1(-t * v)
        return float(-(np.log(np.maximum(top, 1e-300)) - 2 * np.log(np.maximum(np.abs(bottom), 1e-300))).sum())

    t, value = min(golden(loss, -30.0, -0.05), golden(loss, 0.05, 30.0), key=lambda r: r[1])
    return [t], -value


MARGINALS: dict[str, tuple[Callable, int]] = {"Normal": (normal_fit, 2), "SkewNormalMoments": (skew_normal_by_moments, 3), "SkewNormal": (skew_normal_fit, 3), "PearsonIII": (pearson3_fit, 3), "BimodalNormal": (bimodal_fit, 5), "Beta": (beta_fit, 2)}
COPULAS: dict[str, tuple[Callable, int]] = {"Gaussian": (gaussian_copula, 1), "Student": (student_copula, 2), "Clayton": (clayton_copula, 1), "Gumbel": (gumbel_copula, 1), "Frank": (frank_copula, 1)}
