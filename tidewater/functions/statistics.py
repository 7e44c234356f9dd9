"""Distribution tails; Arrow UDFs, since no SQL function gives them.

The scalar functions sum their terms and serve as the plain statement of each tail. The column functions work on whole batches by the
incomplete beta and gamma functions, whose cost does not grow with the counts; a null or NaN argument gives null.
"""

from __future__ import annotations

from math import exp, inf, lgamma, log

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def log_choose(n: int, k: int) -> float:
    return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) if 0 <= k <= n else -inf


def _sum(logs) -> float:
    logs = [x for x in logs if x > -inf]
    if not logs:
        return 0.0
    top = max(logs)
    return min(1.0, exp(top) * sum(exp(x - top) for x in logs))


def binomial_tail(n: int, size: int, p: float) -> float:
    """P[X >= n]."""
    if n <= 0:
        return 1.0
    if p <= 0 or p >= 1:
        return float(p >= 1 and n <= size)
    return _sum(log_choose(size, k) + k * log(p) + (size - k) * log(1 - p) for k in range(n, size + 1))


def poisson_tail(n: int, rate: float) -> float:
    """P[X >= n]."""
    if n <= 0:
        return 1.0
    if rate <= 0:
        return 0.0
    below = _sum(k * log(rate) - rate - lgamma(k + 1) for k in range(n))
    if below < 0.999:
        return 1.0 - below
    return _sum(k * log(rate) - rate - lgamma(k + 1) for k in range(n, n + 1000))


def hypergeometric_tail(k: int, population: int, marked: int, drawn: int) -> float:
    """P[X >= k]."""
    every = log_choose(population, drawn)
    return _sum(log_choose(marked, i) + log_choose(population - marked, drawn - i) - every for i in range(max(k, 0), min(marked, drawn) + 1))


def fisher_exact(a: int, b: int, c: int, d: int) -> tuple[float, float]:
    """Odds ratio and two-sided p of the table [[a, b], [c, d]]."""
    odds = a * d / (b * c) if b * c else inf
    n, row, column = a + b + c + d, a + b, a + c
    chance = lambda x: log_choose(column, x) + log_choose(n - column, row - x) - log_choose(n, row)
    own = chance(a)
    return odds, _sum(chance(x) for x in range(max(0, row + column - n), min(row, column) + 1) if chance(x) <= own + 1e-7)


#: Lanczos' coefficients for g = 7.
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
_TINY = 1e-300


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x > 0."""
    x = np.asarray(x, float) - 1
    total = _LANCZOS[0] + sum(c / (x + i) for i, c in enumerate(_LANCZOS[1:], 1))
    t = x + 7.5
    return 0.5 * np.log(2 * np.pi) + (x + 0.5) * np.log(t) - t + np.log(total)


def _bounded(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < _TINY, _TINY, x)


def beta_share(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function for a, b > 0, by its continued fraction; steps grow with the root of a and b."""
    x, a, b = (np.array(v, float) for v in np.broadcast_arrays(x, a, b))
    turned = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(turned, 1 - x, x), np.where(turned, b, a), np.where(turned, a, b)
    out = np.zeros(len(x))
    at = np.nonzero((x > 0) & (x < 1))[0]
    x, a, b = x[at], a[at], b[at]
    front = np.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
    c, d = np.ones(len(at)), 1 / _bounded(1 - (a + b) * x / (a + 1))
    total, m, live = d.copy(), 0, np.arange(len(at))
    while len(live):
        m += 1
        p, q, r = a[live], b[live], x[live]
        for up in (m * (q - m) * r / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * r / ((p + 2 * m) * (p + 2 * m + 1))):
            d[live] = 1 / _bounded(1 + up * d[live])
            c[live] = _bounded(1 + up / c[live])
            total[live] *= c[live] * d[live]
        live = live[(np.abs(c[live] * d[live] - 1) > 1e-15) & (m < 1_000_000)]
    out[at] = front * total
    return np.where(turned, 1 - out, out)


def gamma_share(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised lower incomplete gamma function for a > 0, x >= 0: its series below a + 1, its continued fraction beyond."""
    a, x = (np.array(v, float) for v in np.broadcast_arrays(a, x))
    out = np.zeros(len(a))
    for low in (True, False):
        at = np.nonzero((x > 0) & ((x < a + 1) == low))[0]
        p, y = a[at], x[at]
        front = np.exp(p * np.log(y) - y - log_gamma(p))
        live, k = np.arange(len(at)), 0
        if low:
            term, total = 1 / p, 1 / p
            while len(live):
                k += 1
                term[live] *= y[live] / (p[live] + k)
                total[live] += term[live]
                live = live[term[live] > 1e-16 * total[live]]
            out[at] = front * total
        else:
            b = y + 1 - p
            c, d = np.full(len(at), 1 / _TINY), 1 / _bounded(b)
            total = d.copy()
            while len(live):
                k += 1
                up = -k * (k - p[live])
                d[live] = 1 / _bounded(up * d[live] + b[live] + 2 * k)
                c[live] = _bounded(b[live] + 2 * k + up / c[live])
                total[live] *= c[live] * d[live]
                live = live[(np.abs(c[live] * d[live] - 1) > 1e-15) & (k < 1_000_000)]
            out[at] = 1 - front * total
    return out


def _known(*columns: pd.Series) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places where no argument is missing, and the arguments there."""
    values = [pd.to_numeric(c, errors="coerce").to_numpy(float, na_value=np.nan) for c in columns]
    at = np.nonzero(~np.isnan(values).any(axis=0))[0]
    return at, [v[at] for v in values]


def _filled(n: int, at: np.ndarray, values) -> pd.Series:
    out = np.full(n, np.nan)
    out[at] = values
    return pd.Series(out).astype("Float64")


@F.pandas_udf(T.DoubleType())
def pbinom(n: pd.Series, size: pd.Series, p: pd.Series) -> pd.Series:
    """P[X >= n] of size draws with chance p."""
    at, (k, m, q) = _known(n, size, p)
    out = np.where(k <= 0, 1.0, np.where((q <= 0) | (k > m), 0.0, 1.0))
    mid = np.nonzero((k > 0) & (k <= m) & (q > 0) & (q < 1))[0]
    out[mid] = beta_share(q[mid], k[mid], m[mid] - k[mid] + 1)
    return _filled(len(n), at, out)


@F.pandas_udf(T.DoubleType())
def ppois(n: pd.Series, rate: pd.Series) -> pd.Series:
    """P[X >= n] at a rate."""
    at, (k, m) = _known(n, rate)
    out = np.where(k <= 0, 1.0, 0.0)
    mid = np.nonzero((k > 0) & (m > 0))[0]
    out[mid] = gamma_share(k[mid], m[mid])
    return _filled(len(n), at, out)


def _log_choose(n: np.ndarray, k: np.ndarray) -> np.ndarray:
    return log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1)


def _drawn(population: float, marked: float, drawn: float) -> tuple[np.ndarray, np.ndarray]:
    """All possible numbers of marked ones among the drawn, and the log of each one's chance; one row's terms at a time."""
    x = np.arange(max(0, drawn + marked - population), min(marked, drawn) + 1, dtype=float)
    return x, _log_choose(np.float64(marked), x) + _log_choose(np.float64(population - marked), drawn - x) - _log_choose(np.float64(population), np.float64(drawn))


def _each_once(rows: list[np.ndarray], tail) -> np.ndarray:
    """tail of every row of arguments, worked out once for each combination of them."""
    distinct, at = np.unique(np.column_stack(rows), axis=0, return_inverse=True)
    return np.array([tail(*row) for row in distinct], float)[at.reshape(-1)]


@F.pandas_udf(T.DoubleType())
def phyper(k: pd.Series, population: pd.Series, marked: pd.Series, drawn: pd.Series) -> pd.Series:
    """P[X >= k] of marked ones among those drawn from a population."""
    at, rows = _known(k, population, marked, drawn)

    def tail(least, n, m, d):
        x, chance = _drawn(n, m, d)
        return min(1.0, np.exp(chance[x >= least]).sum())

    return _filled(len(k), at, _each_once(rows, tail))


@F.pandas_udf(T.DoubleType())
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """Two-sided p of the table [[a, b], [c, d]]."""
    at, rows = _known(a, b, c, d)

    def both_sides(p, q, r, s):
        x, chance = _drawn(p + q + r + s, p + r, p + q)
        own = chance[int(p - x[0])]
        return min(1.0, np.exp(chance[chance <= own + 1e-7]).sum())

    return _filled(len(a), at, _each_once(rows, both_sides))


def beta_tail(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_tail(1 - x, b, a)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    tiny, c, d, total = 1e-300, 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300), 1.0
    total = d
    for m in range(1, 400):
        for up in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + up * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + up / (c if abs(c) > tiny else tiny)
            total *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * total


def correlation_tail(r: float, n: int) -> float:
    """Two-sided p of a correlation of n pairs: with t = r sqrt((n-2) / (1-r^2)) it is the beta function at 1 - r^2."""
    if n < 3 or r != r:
        return float("nan")
    return beta_tail(max(0.0, 1 - r * r), (n - 2) / 2, 0.5)


@F.pandas_udf(T.DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of correlations r of n pairs; null below three pairs."""
    at, (c, k) = _known(r, n)
    good = k >= 3
    at, c, k = at[good], c[good], k[good]
    left = np.maximum(0.0, 1 - c * c)
    return _filled(len(r), at, np.where(left >= 1, 1.0, beta_share(left, (k - 2) / 2, np.full(len(k), 0.5))))


def normal_cdf(x):
    """The standard normal distribution function as a column expression, after Abramowitz and Stegun 7.1.26; good to 1.5e-7."""
    # The approximation's coefficients.
    p, a = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    c = F.col(x) if isinstance(x, str) else x
    z = F.abs(c) / F.sqrt(F.lit(2e0))
    t = F.lit(1e0) / (F.lit(1e0) + F.lit(p) * z)
    poly = F.lit(0e0)
    for k in reversed(a):
        poly = (poly + F.lit(k)) * t
    erf = F.lit(1e0) - poly * F.exp(-z * z)
    return (F.lit(1e0) + F.signum(c) * erf) / 2


def binomial_score(n, size, p):
    """-log10 of the binomial tail."""
    return -F.log10(pbinom(n, size, p))
