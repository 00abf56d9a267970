"""Distribution functions and quantiles with NumPy only.

Quantiles are needed for a few distinct (probability, degrees of freedom): lookup() makes those a small DataFrame
for a join, so that no row runs Python."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2.0))


def _bisect(cdf: Callable[[float], float], p: float, low: float, high: float) -> float:
    for _ in range(200):
        middle = 0.5 * (low + high)
        if middle in (low, high):
            break
        low, high = (middle, high) if cdf(middle) < p else (low, middle)
    return 0.5 * (low + high)


def normal_quantile(p: float) -> float:
    if not 0 < p < 1:
        raise ValueError("a probability lies between 0 and 1")
    return _bisect(normal_cdf, p, -40.0, 40.0)


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 0.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-17:
            k += 1
            term *= x / k
            total += term
        return total * scale
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1.0 / tiny, 1.0 / b
    h = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2
        d = 1.0 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1.0 - scale * h


def chi2_cdf(x: float, dof: float) -> float:
    return gamma_p(dof / 2.0, x / 2.0)


def chi2_quantile(p: float, dof: float) -> float:
    return _bisect(lambda x: chi2_cdf(x, dof), p, 0.0, dof + 40.0 * math.sqrt(2.0 * dof) + 200.0)


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_i(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    f, c, d = 1.0, 1.0, 0.0
    for i in range(100_000):
        m = i // 2
        if i == 0:
            numerator = 1.0
        elif i % 2 == 0:
            numerator = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            numerator = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / (1.0 + numerator * d or tiny)
        c = 1.0 + numerator / c or tiny
        f *= c * d
        if i and abs(c * d - 1) < 1e-16:
            break
    return front * (f - 1.0)


def f_cdf(x: float, df1: float, df2: float) -> float:
    return beta_i(df1 / 2.0, df2 / 2.0, df1 * x / (df1 * x + df2)) if x > 0 else 0.0


def f_quantile(p: float, df1: float, df2: float) -> float:
    high = 1.0
    while f_cdf(high, df1, df2) < p:
        high *= 2.0
    return _bisect(lambda x: f_cdf(x, df1, df2), p, 0.0, high)


def t_cdf(x: float, dof: float) -> float:
    tail = 0.5 * beta_i(dof / 2.0, 0.5, dof / (dof + x * x))
    return 1.0 - tail if x > 0 else tail


def t_quantile(p: float, dof: float) -> float:
    high = 1.0
    while t_cdf(high, dof) < max(p, 1 - p):
        high *= 2.0
    return _bisect(lambda x: t_cdf(x, dof), p, -high, high)


def non_centrality(alpha: float = 0.001, beta: float = 0.20) -> float:
    return normal_quantile(1.0 - alpha / 2.0) + normal_quantile(1.0 - beta)


def tau_critical(confidence: float, dof: int) -> float:
    """Of the largest standardised residual when sigma is estimated from the same adjustment."""
    t = t_quantile((1.0 + confidence) / 2.0, dof - 1)
    return t * math.sqrt(dof) / math.sqrt(dof - 1 + t * t)


def confidence_scale(confidence: float, dimension: int, dof: int | None = None) -> float:
    """What a standard ellipse is multiplied by: chi-square without degrees of freedom, F with them."""
    return math.sqrt(chi2_quantile(confidence, dimension) if dof is None else dimension * f_quantile(confidence, dimension, dof))


def lookup(spark: SparkSession, arguments: Iterable[tuple], **columns: Callable[..., float]) -> DataFrame:
    """(dof, *columns) for distinct arguments, each column a function of dof."""
    rows = [(int(d), *(float(f(d)) for f in columns.values())) for d in sorted(set(arguments))]
    return spark.createDataFrame(rows, "dof long, " + ", ".join(f"{n} double" for n in columns))
