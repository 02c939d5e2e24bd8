"""Tail probabilities over NumPy arrays, for small result tables."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_TINY = 1e-300
_STEPS = 1_000_000
# From this shape on, the gamma tail is an expansion whose error is below 1e-12.
_LARGE = 1e5


def z_for(level: float) -> float:
    """The two-sided normal multiplier of a confidence level."""
    return NormalDist().inv_cdf(0.5 + level / 2)


def normal_two_sided(z: np.ndarray) -> np.ndarray:
    return np.vectorize(lambda v: math.erfc(abs(v) / math.sqrt(2)), otypes=[float])(z)


class NotConverged(ArithmeticError):
    """A series or continued fraction did not settle."""


def _fraction(first: np.ndarray, terms) -> np.ndarray:
    """Evaluate a continued fraction by the modified Lentz method, all rows at once."""
    c, d, value = np.full_like(first, 1 / _TINY), 1 / first, 1 / first
    settled = np.zeros(first.shape, bool)
    for numerator, denominator in terms:
        d = denominator + numerator * d
        c = denominator + numerator / c
        d, c = np.where(np.abs(d) < _TINY, _TINY, d), np.where(np.abs(c) < _TINY, _TINY, c)
        d = 1 / d
        step = np.where(settled, 1.0, c * d)
        value = value * step
        settled |= np.abs(step - 1) < 1e-15
        if settled.all():
            return value
    raise NotConverged("a continued fraction did not settle")


def _stirling(z: np.ndarray) -> np.ndarray:
    """What log gamma has beyond its leading Stirling terms, for z of 20 or more."""
    w = 1 / (z * z)
    return (1 / 12 - w * (1 / 360 - w * (1 / 1260 - w / 1680))) / z


def _log_gamma_step(z: np.ndarray, by: np.ndarray) -> np.ndarray:
    """log gamma(z + by) - log gamma(z) without the cancellation of two large numbers."""
    big = np.maximum(z, 20.0)
    large = (big + by - 0.5) * np.log1p(by / big) + by * (np.log(big) - 1) + _stirling(big + by) - _stirling(big)
    return np.where(z >= 20, large, _lgamma(np.minimum(z, 20.0) + by) - _lgamma(np.minimum(z, 20.0)))


def _upper_gamma_large(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The tail for large ``a`` by the uniform asymptotic expansion around x = a."""
    mu = (x - a) / a
    near = np.abs(mu) < 0.1
    series = sum((-1) ** k * np.where(near, mu, 0.0) ** k / k for k in range(2, 24))
    half = np.where(near, series, mu - np.log1p(np.where(near, 0.0, mu)))
    eta = np.sign(mu) * np.sqrt(2 * half)
    close = np.abs(eta) < 0.05
    e, far_eta, far_mu = np.where(close, eta, 0.0), np.where(close, 1.0, eta), np.where(close, 1.0, mu)
    c0 = np.where(
        close, -1 / 3 + e * (1 / 12 + e * (-2 / 135 + e * (1 / 864 + e * (1 / 2835 - e * 139 / 777600)))), 1 / far_mu - 1 / far_eta
    )
    c1 = np.where(
        close, -1 / 540 + e * (-1 / 288 + e * (1 / 378 - e * 77 / 77760)),
        1 / far_eta**3 - 1 / far_mu**3 - 1 / far_mu**2 - 1 / (12 * far_mu),
    )
    lead = np.vectorize(lambda v: 0.5 * math.erfc(v), otypes=[float])(eta * np.sqrt(a / 2))
    return lead + np.exp(-a * half) / np.sqrt(2 * np.pi * a) * (c0 + c1 / a)


def upper_gamma(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised upper incomplete gamma function."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    large = a >= _LARGE
    out = np.where(x <= 0, 1.0, 0.0)
    rows = large & (x > 0)
    out[rows] = _upper_gamma_large(a[rows], x[rows])
    for rows, tail in ((~large & (x > 0) & (x < a + 1), _by_series), (~large & (x > 0) & (x >= a + 1), _by_fraction)):
        if rows.any():
            out[rows] = tail(a[rows], x[rows], np.exp(a[rows] * np.log(x[rows]) - x[rows] - _lgamma(a[rows])))
    return out


def _by_series(a: np.ndarray, x: np.ndarray, scale: np.ndarray) -> np.ndarray:
    term = total = 1 / a
    for k in range(1, _STEPS):
        term = term * x / (a + k)
        total = total + term
        if np.all(np.abs(term) <= np.abs(total) * 1e-16):
            return 1 - scale * total
    raise NotConverged("a gamma series did not settle")


def _by_fraction(a: np.ndarray, x: np.ndarray, scale: np.ndarray) -> np.ndarray:
    terms = ((-k * (k - a), x + 2 * k + 1 - a) for k in range(1, _STEPS))
    return scale * _fraction(x + 1 - a, terms)


def beta_ratio(a: np.ndarray, b: np.ndarray, x: np.ndarray, rest: np.ndarray | None = None) -> np.ndarray:
    """The regularised incomplete beta function; ``rest`` is 1 - x where it is known more exactly."""
    a, b, x, rest = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x, 1 - np.asarray(x, float) if rest is None else rest)))
    swap = x > (a + 1) / (a + b + 2)
    p, q = np.where(swap, b, a), np.where(swap, a, b)
    y, other = np.where(swap, rest, x), np.where(swap, x, rest)
    inside = np.clip(y, _TINY, 1 - 1e-16)
    more, less = np.maximum(p, q), np.minimum(p, q)
    front = np.exp(
        _log_gamma_step(more, less) - _lgamma(less)
        + p * np.where(inside < 0.5, np.log(inside), np.log1p(-np.minimum(other, 0.5)))
        + q * np.where(inside < 0.5, np.log1p(-inside), np.log(np.maximum(other, _TINY)))
    ) / p

    def terms():
        one = np.ones_like(p)
        yield -(p + q) * inside / (p + 1), one
        for m in range(1, _STEPS):
            yield m * (q - m) * inside / ((p + 2 * m - 1) * (p + 2 * m)), one
            yield -(p + m) * (p + q + m) * inside / ((p + 2 * m) * (p + 2 * m + 1)), one

    part = np.where(y <= 0, 0.0, front * _fraction(np.ones_like(p), terms()))
    return np.where(swap, 1 - part, part)


def chi_square_tail(x, df) -> np.ndarray:
    return upper_gamma(np.asarray(df, float) / 2, np.asarray(x, float) / 2)


def t_two_sided(t, df) -> np.ndarray:
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    out, large = np.empty(t.shape), df >= _LARGE
    out[large] = normal_two_sided(_normal_score(t[large], df[large]))
    x, v = t[~large], df[~large]
    out[~large] = beta_ratio(v / 2, 0.5, v / (v + x * x), x * x / (v + x * x))
    return out


def _normal_score(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """The normal value with the tail of t, for large ``df``: a log transform and its first correction."""
    a = df - 0.5
    z = np.sqrt(a * np.log1p(t * t / df))
    return z + z * (z * z + 3) / (48 * a * a)


def t_multiplier(df, level: float) -> np.ndarray:
    """The two-sided t multiplier, by halving an interval for all rows at once."""
    df = np.asarray(df, float)
    low, high = np.zeros_like(df), np.full_like(df, 1.0)
    while np.any(t_two_sided(high, df) > 1 - level):
        high = np.where(t_two_sided(high, df) > 1 - level, high * 2, high)
    for _ in range(80):
        middle = (low + high) / 2
        wide = t_two_sided(middle, df) > 1 - level
        low, high = np.where(wide, middle, low), np.where(wide, high, middle)
    return (low + high) / 2


def fisher_tails(a: float, b: float, c: float, d: float) -> tuple[float, float, float]:
    """Two-sided, lower and upper exact p of one 2 by 2 table.

    Only tables within 60 standard deviations of the most likely one are summed;
    all others have probability zero in double precision.
    """
    row, column, n = a + b, a + c, a + b + c + d
    lowest, highest = max(0.0, row + column - n), min(row, column)
    mean = row * column / n if n else 0.0
    spread = 60 * math.sqrt(max(mean * (1 - row / n) * (1 - column / n), 0.0)) + 60 if n else 0.0
    start, stop = max(lowest, math.floor(mean - spread)), min(highest, math.ceil(mean + spread))
    x = np.arange(start, stop + 1)
    # Neighbouring tables differ by a simple ratio, so their logs add up without
    # the cancellation that log-factorials of large counts suffer from.
    at = x[:-1]
    to_next = np.log((row - at) * (column - at) / ((at + 1) * (n - row - column + at + 1)))
    log_p = np.concatenate([[0.0], np.cumsum(to_next)])
    p = np.exp(log_p - log_p.max())
    p = p / p.sum()
    seen = float(p[int(a - start)]) if start <= a <= stop else 0.0
    tails = p[p <= seen * (1 + 1e-7)].sum(), p[x <= a].sum(), p[x >= a].sum()
    return tuple(float(min(1.0, v)) for v in tails)


def _with_nulls(fn, *columns: pd.Series) -> pd.Series:
    """Apply ``fn`` to the complete rows; the rest stay null."""
    known = np.logical_and.reduce([c.notna().to_numpy() for c in columns])
    out = np.full(len(columns[0]), np.nan)
    if known.any():
        out[known] = fn(*[c.to_numpy(dtype=float)[known] for c in columns])
    return pd.Series(out).where(known, None)


@F.pandas_udf(T.DoubleType())
def chi_square_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return _with_nulls(chi_square_tail, x, df)


@F.pandas_udf(T.DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return _with_nulls(t_two_sided, t, df)


@F.pandas_udf(T.DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return _with_nulls(normal_two_sided, z)


def t_multiplier_at(level: float):
    @F.pandas_udf(T.DoubleType())
    def multiplier(df: pd.Series) -> pd.Series:
        return _with_nulls(lambda v: t_multiplier(v, level), df)

    return multiplier


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ("p", "p_less", "p_greater")]))
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
    rows = [
        fisher_tails(*map(float, cell)) if all(pd.notna(v) for v in cell) else (None, None, None)
        for cell in zip(a, b, c, d)
    ]
    return pd.DataFrame(rows, columns=["p", "p_less", "p_greater"])
