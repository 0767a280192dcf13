"""Tail probabilities of the chi-square and F distributions, vectorised over small results.

Series and continued fractions for the regularised incomplete gamma and beta functions
(Abramowitz & Stegun 6.5; DiDonato & Morris, ACM TOMS 18, 1992).
"""

from __future__ import annotations

import math
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

TINY = 1e-300
EPS = 2.3e-16  # just above the spacing of doubles at 1
STEPS = 10_000_000
LARGE = 1000.0  # from here on the asymptotic series of log gamma is exact to the last digit


def _lentz(first: float, term) -> float:
    """Continued fraction first + a1/(b1 + a2/(b2 + ...)) with ``term(n) -> (a_n, b_n)``."""
    f = first or TINY
    c, d = f, 0.0
    for n in range(1, STEPS):
        a, b = term(n)
        d = 1.0 / ((b + a * d) or TINY)
        c = (b + a / c) or TINY
        f *= c * d
        if abs(c * d - 1.0) < EPS:
            return f
    raise ArithmeticError("tail probability did not converge")


def _rest(z: float) -> float:
    """log gamma(z) - ((z - 1/2) log z - z + log(2 pi) / 2) for large z."""
    return 1 / (12 * z) - 1 / (360 * z**3)


def _gamma_ratio(a: float, b: float) -> float:
    """log(gamma(a + b) / gamma(a)) - b log a; differences of large logarithms would lose its digits."""
    if a < LARGE:
        return math.lgamma(a + b) - math.lgamma(a) - b * math.log(a)
    return (a + b - 0.5) * math.log1p(b / a) - b + _rest(a + b) - _rest(a)


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma."""
    if x <= 0:
        return 1.0
    if a < LARGE:
        scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    else:
        off = (x - a) / a
        log = math.log1p(off) if abs(off) < 0.5 else math.log(x / a)
        scale = math.exp(a * (log - off) + 0.5 * math.log(a / (2 * math.pi)) - _rest(a))
    if x < a + 1:
        total = term = 1.0 / a
        n = a
        while abs(term) > abs(total) * EPS:
            n += 1
            term *= x / n
            total += term
        return 1.0 - total * scale
    return scale / _lentz(x + 1 - a, lambda n: (-n * (n - a), x + 2 * n + 1 - a))


def beta_i(x: float, a: float, b: float, y: float | None = None) -> float:
    """Regularised incomplete beta; ``y`` is 1 - x, given where the difference would lose digits."""
    y = 1 - x if y is None else y
    if x <= 0:
        return 0.0
    if y <= 0:
        return 1.0
    above = a * y - b * x  # the fraction below has no cancelling terms where this is positive
    if above < 0:
        return 1.0 - beta_i(y, b, a, x)

    def bottom(n):
        return n + n * (b - n) * x / (a + 2 * n - 1) + (a + n) / (a + 2 * n + 1) * (above + 1 + n * (1 + y)) if n else a / (a + 1) * (above + 1)

    def term(n):
        return (a + n - 1) * (a + b + n - 1) * n * (b - n) * (x / (a + 2 * n - 1)) ** 2, bottom(n)

    # with the larger parameter p: p log u + q log(p v) stay of moderate size
    (p, u), (q, v) = ((a, x), (b, y)) if a >= b else ((b, y), (a, x))
    log_u = math.log1p(-v) if v < 0.5 else math.log(u)
    scale = math.exp(_gamma_ratio(p, q) - math.lgamma(q) + p * log_u + q * math.log(p * v))
    return scale / _lentz(bottom(0), term)


def chi_square_tail(stat: float, df: float) -> float:
    return 1.0 if stat <= 0 else gamma_q(df / 2, stat / 2)


def f_tail(stat: float, df1: float, df2: float) -> float:
    """P(F > stat); computed on the small side so that tiny values keep their digits."""
    both = df2 + df1 * stat
    return 1.0 if stat <= 0 else beta_i(df2 / both, df2 / 2, df1 / 2, df1 * stat / both)


@F.pandas_udf(T.DoubleType())
def chi_square_p(stat: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(s) or pd.isna(d) else chi_square_tail(s, d) for s, d in zip(stat, df)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def anova_p(stat: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return pd.Series(
        [None if pd.isna(s) or pd.isna(a) or pd.isna(b) else f_tail(s, a, b) for s, a, b in zip(stat, df1, df2)], dtype="float64"
    )


# The tasks carry these functions themselves: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
