"""Distribution functions as Column expressions, so tests on aggregates stay in the plan."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lanczos coefficients (g = 7, n = 9).
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def lgamma(x: Column) -> Column:
    """Log gamma of positive values."""
    y = x - 1
    series = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        series = series + F.lit(c) / (y + i)
    t = y + 7.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (y + 0.5) * F.log(t) - t + F.log(series)


def _fraction(a: Column, b: Column, x: Column, terms: int = 200) -> Column:
    """The continued fraction of the incomplete beta, by Lentz's method, as a fold over its terms."""
    tiny = F.lit(1e-300)
    guard = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)
    d0 = 1 / guard(1 - (a + b) * x / (a + 1))

    def step(s: Column, m: Column) -> Column:
        m = m.cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d1 = 1 / guard(1 + even * s["d"])
        c1 = guard(1 + even / s["c"])
        d2 = 1 / guard(1 + odd * d1)
        c2 = guard(1 + odd / c1)
        return F.struct(c2.alias("c"), d2.alias("d"), (s["h"] * d1 * c1 * d2 * c2).alias("h"))

    start = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, step, lambda s: s["h"])


def beta_cdf(x: Column, a: Column, b: Column) -> Column:
    """The regularised incomplete beta function."""
    front = F.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * F.log(x) + b * F.log(1 - x))
    inside = F.when(x < (a + 1) / (a + b + 2), front * _fraction(a, b, x) / a).otherwise(1 - front * _fraction(b, a, 1 - x) / b)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(inside)


def t_two_sided(t: Column, df: Column) -> Column:
    """The two-sided p-value of Student's t."""
    return F.when(t.isNotNull() & df.isNotNull(), beta_cdf(df / (df + t * t), df / 2, F.lit(0.5)))


def f_upper(f: Column, d1: Column, d2: Column) -> Column:
    """The upper tail of Fisher's F."""
    return beta_cdf(d2 / (d2 + d1 * f), d2 / 2, d1 / 2)


def gamma_upper(a: Column, x: Column, terms: int = 300) -> Column:
    """The regularised upper incomplete gamma function: series below a + 1, fraction above."""
    front = F.exp(-x + a * F.log(x) - lgamma(a))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.struct((1 / a).alias("term"), (1 / a).alias("sum")),
        lambda s, n: F.struct((s["term"] * x / (a + n)).alias("term"), (s["sum"] + s["term"] * x / (a + n)).alias("sum")),
        lambda s: s["sum"],
    )
    tiny = 1e-300

    def step(s: Column, n: Column) -> Column:
        n = n.cast("double")
        an, b = -n * (n - a), s["b"] + 2
        d = 1 / (an * s["d"] + b)
        c = b + an / s["c"]
        return F.struct(b.alias("b"), c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

    b0 = x + 1 - a
    fraction = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.struct(b0.alias("b"), F.lit(1 / tiny).alias("c"), (1 / b0).alias("d"), (1 / b0).alias("h")), step, lambda s: s["h"])
    return F.when(x <= 0, 1.0).when(x < a + 1, 1 - front * series).otherwise(front * fraction)


def chi2_upper(x: Column, df: Column) -> Column:
    return gamma_upper(df / 2, x / 2)


def normal_cdf(z: Column) -> Column:
    """The standard normal distribution, through the incomplete gamma."""
    tail = gamma_upper(F.lit(0.5), z * z / 2) / 2
    return F.when(z.isNull(), None).when(z > 0, 1 - tail).otherwise(tail)


def normal_two_sided(z: Column) -> Column:
    return F.when(z.isNotNull(), gamma_upper(F.lit(0.5), z * z / 2))


def wilson(successes: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """The Wilson interval of a share."""
    p = successes / n
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z / (1 + z * z / n) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return middle - half, middle + half
