"""Intervals, shares and closed forms as columns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Z95 = 1.959963984540054


def _score_end(share: Column, trials: Column, z: float, side: int) -> Column:
    """The lesser (side -1) or greater (+1) p with (share - p)^2 = z^2 p (1 - p) / trials, a quadratic in p."""
    a = z * z / trials.cast("double")
    half = 2 * share + a
    root = F.sqrt(F.greatest(F.lit(0.0), half * half - 4 * (1 + a) * share * share))
    return (half + side * root) / (2 * (1 + a))


def _score_interval(successes: Column, trials: Column, z: float, correction: float) -> tuple[Column, Column, Column]:
    """The share and the ends of its score interval, each end for the share moved outwards by ``correction`` of half a trial."""
    share, step = successes / trials, correction / (2 * trials)
    return share, _score_end(share - step, trials, z, -1), _score_end(share + step, trials, z, 1)


def wilson(successes: Column, trials: Column, z: float = Z95) -> tuple[Column, Column]:
    """Plain Wilson score interval, held to contain the share itself and to lie in [0, 1]; null without trials."""
    share, low, high = _score_interval(successes, trials, z, 0.0)
    some = trials > 0
    return F.when(some, F.least(F.greatest(F.lit(0.0), low), share)), F.when(some, F.greatest(F.least(F.lit(1.0), high), share))


def wilson_corrected(successes: Column, trials: Column, z: float = Z95) -> tuple[Column, Column]:
    """Wilson interval with continuity correction; the ends are 0 at no success and 1 at nothing else. Null without trials."""
    _, low, high = _score_interval(successes, trials, z, 1.0)
    inside = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    ends = F.when(successes > 0, inside(low)).otherwise(0.0), F.when(successes < trials, inside(high)).otherwise(1.0)
    return tuple(F.when(trials > 0, e) for e in ends)


def separated(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    """Whether two finite intervals lie strictly apart."""
    finite = ~(F.isnan(low_a) | F.isnan(high_a) | F.isnan(low_b) | F.isnan(high_b))
    return finite & ((high_a < low_b) | (high_b < low_a))


def shrinkage(between: float | Column, within: float | Column, n: Column) -> Column:
    """Weight of a group's own mean: between / (between + within / n)."""
    return between / (between + within / n)


def rrf_term(rank: Column, k: int = 60) -> Column:
    """Reciprocal-rank term; 0 for what an arm did not find."""
    return F.coalesce(1.0 / (k + rank), F.lit(0.0))


def percent_display(p: Column) -> Column:
    """Whole percent rounded half up on decimals; <1% and >99% at the ends, null outside [0, 1]."""
    whole = F.round(p.cast("decimal(38,18)") * 100, 0).cast("int")
    shown = F.when(whole <= 0, "<1%").when(whole >= 100, ">99%").otherwise(F.concat(whole.cast("string"), F.lit("%")))
    return F.when((p >= 0) & (p <= 1), shown)


def complement_display(p: Column) -> Column:
    """The other direction: 100 minus the displayed percent, bounds swapped."""
    whole = F.round(p.cast("decimal(38,18)") * 100, 0).cast("int")
    shown = F.when(whole <= 0, ">99%").when(whole >= 100, "<1%").otherwise(F.concat((100 - whole).cast("string"), F.lit("%")))
    return F.when((p >= 0) & (p <= 1), shown)


def elapsed_ms(seconds: Column) -> Column:
    """Milliseconds, rounded half to even, not below 0."""
    return F.when(seconds <= 0, F.lit(0)).otherwise(F.bround(seconds * 1000, 0)).cast("long")


#: Half the logarithm of 2 pi; where the upper tail changes from a series to a continued fraction, and the terms of both.
HALF_LOG_2PI, TAIL_FROM, TAIL_TERMS = 0.9189385332046727, 2.5, 60


def log_upper_tail(z: Column) -> Column:
    """Logarithm of the chance that a standard normal exceeds z; no z of a double makes it underflow.

    From TAIL_FROM on the continued fraction of Laplace, below it the series of the distribution function, and for
    negative z the complement: sums of a fixed number of terms, so it stays in generated code or built-in functions.
    """
    a = F.abs(z)
    down = F.array(*(F.lit(float(k)) for k in range(TAIL_TERMS, 0, -1)))
    far = -a * a / 2 - HALF_LOG_2PI - F.log(F.aggregate(down, a, lambda t, k: a + k / t))
    odd = F.array(*(F.lit(float(2 * k + 1)) for k in range(TAIL_TERMS, 0, -1)))
    series = a * F.aggregate(odd, F.lit(1.0), lambda t, k: 1.0 + a * a / k * t)
    log_q = F.when(a >= TAIL_FROM, far).otherwise(F.log(0.5 - F.exp(-a * a / 2 - HALF_LOG_2PI) * series))
    return F.when(z >= 0, log_q).otherwise(F.log1p(-F.exp(log_q)))


def log_upper_tail_sql(z: str) -> str:
    """The same in DuckDB SQL."""
    a = f"abs({z})"
    down = "[" + ", ".join(str(float(k)) for k in range(TAIL_TERMS, 0, -1)) + "]"
    odd = "[" + ", ".join(str(float(2 * k + 1)) for k in range(TAIL_TERMS, 0, -1)) + "]"
    far = f"(-{a} * {a} / 2 - {HALF_LOG_2PI} - ln(list_reduce(list_prepend({a}, CAST({down} AS DOUBLE[])), lambda t, k: {a} + k / t)))"
    near = f"ln(0.5 - exp(-{a} * {a} / 2 - {HALF_LOG_2PI}) * {a} * list_reduce(list_prepend(CAST(1 AS DOUBLE), CAST({odd} AS DOUBLE[])), lambda t, k: 1 + {a} * {a} / k * t))"
    log_q = f"CASE WHEN {a} >= {TAIL_FROM} THEN {far} ELSE {near} END"
    return f"CASE WHEN {z} >= 0 THEN {log_q} ELSE ln(1 - exp({log_q})) END"


def log_sum(a: Column, b: Column) -> Column:
    """Logarithm of the sum of two numbers given by their logarithms; minus infinity for none."""
    high, low = F.greatest(a, b), F.least(a, b)
    return F.when(high == F.lit(float("-inf")), high).otherwise(high + F.log1p(F.exp(low - high)))


def softplus(x: Column) -> Column:
    """log(1 + e^x) over the whole range."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def fenton_wilkinson(means: Column, variances: Column) -> tuple[Column, Column]:
    """Log-mean and log-sigma of one lognormal with the mean and variance of a sum of lognormals (arrays of mu and sigma^2)."""
    total = F.aggregate(F.zip_with(means, variances, lambda m, v: F.exp(m + v / 2)), F.lit(0.0), lambda a, x: a + x)
    spread = F.aggregate(F.zip_with(means, variances, lambda m, v: F.expm1(v) * F.exp(2 * m + v)), F.lit(0.0), lambda a, x: a + x)
    sigma2 = F.log1p(spread / (total * total))
    return F.log(total) - sigma2 / 2, F.sqrt(sigma2)


@F.pandas_udf(T.DoubleType())
def normal_quantile(p: pd.Series) -> pd.Series:
    from statistics import NormalDist

    inverse = NormalDist().inv_cdf
    return p.map(lambda v: inverse(v) if 0 < v < 1 else math.nan)


@F.pandas_udf(T.DoubleType())
def lognormal_survival(t: pd.Series, mu: pd.Series, sigma: pd.Series) -> pd.Series:
    """Chance that a lognormal duration exceeds t; 1 at t <= 0."""
    return pd.Series([1.0 if x <= 0 else 0.5 * math.erfc((math.log(x) - m) / (s * math.sqrt(2))) for x, m, s in zip(t, mu, sigma, strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def remaining_quantile(u: pd.Series, elapsed: pd.Series, mu: pd.Series, sigma: pd.Series) -> pd.Series:
    """Quantile u of the days left after ``elapsed`` of a lognormal duration (0 elapsed: the whole duration)."""
    from statistics import NormalDist

    normal, tiny = NormalDist(), 1e-15
    out = []
    for q, e, m, s in zip(u, elapsed, mu, sigma, strict=True):
        left = 1.0 if e <= 0 else 0.5 * math.erfc((math.log(e) - m) / (s * math.sqrt(2)))
        at = min(max(1.0 - left * (1.0 - q), tiny), 1.0 - tiny)
        out.append(max(math.exp(m + s * normal.inv_cdf(at)) - max(e, 0.0), tiny))
    return pd.Series(out, dtype=float)


def mixture_half_width(spreads: np.ndarray, level: float) -> np.ndarray:
    """For each row of ``spreads`` the h such that [-h, h] holds ``level`` of an even mixture of normals about 0 with those spreads.

    All rows are halved together.  A spread of 0 is a point at 0, which every interval holds.
    """
    erf = np.frompyfunc(math.erf, 1, 1)
    low, high = np.zeros(len(spreads)), _widest(level) * spreads.max(axis=1, initial=0.0)
    with np.errstate(divide="ignore"):
        scale = np.where(spreads > 0, 1 / (spreads * math.sqrt(2)), 0.0)
    points = (spreads <= 0).sum(axis=1)
    for _ in range(64):
        middle = (low + high) / 2
        held = (erf(middle[:, None] * scale).astype(float).sum(axis=1) + points) / max(spreads.shape[1], 1)
        low, high = np.where(held < level, middle, low), np.where(held < level, high, middle)
    return (low + high) / 2


def _widest(level: float) -> float:
    """Half the width, in spreads, of the middle ``level`` of a normal."""
    from statistics import NormalDist

    return NormalDist().inv_cdf((1 + level) / 2)


@F.pandas_udf(T.StringType())
def float_digest(values: pd.Series) -> pd.Series:
    """SHA-256 (hex) of an array's doubles as they are stored, least byte first; null for one that is null, empty or not finite throughout."""
    import hashlib

    def digest(v) -> str | None:
        raw = np.asarray(v if v is not None else [], dtype="<f8")
        return hashlib.sha256(raw.tobytes()).hexdigest() if raw.size and np.isfinite(raw).all() else None

    return values.map(digest)


def binomial_tail(k: int, n: int, p: float) -> float:
    """Chance of k or more successes in n trials."""
    if p <= 0:
        return 1.0 if k <= 0 else 0.0
    if p >= 1:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(max(k, 0), n + 1)]
    return min(1.0, sum(map(math.exp, logs)))


@F.pandas_udf(T.DoubleType())
def precision_floor(correct: pd.Series, merged: pd.Series) -> pd.Series:
    """One-sided 95 % lower bound of a precision: 1 - 3 / n without errors, else exact binomial; none without merges."""

    def bound(k: int, n: int) -> float:
        if n <= 0:
            return math.nan
        if k == n:
            return max(0.0, 1 - 3 / n)
        low, high = 0.0, k / n
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (middle, high) if binomial_tail(k, n, middle) < 0.05 else (low, middle)
        return low

    return pd.Series([bound(int(k), int(n)) for k, n in zip(correct, merged, strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def binomial_upper(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """Chance of k or more successes in n trials."""
    return pd.Series([binomial_tail(int(a), int(b), float(c)) for a, b, c in zip(k, n, p, strict=True)], dtype=float)
