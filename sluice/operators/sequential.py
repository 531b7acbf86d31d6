"""Looking at a test before it has ended: bounds that keep the error, and looks over the data.

Bounds are worked out on the driver from a few numbers; the looks are counts by look and arm.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.stats import normal_two_sided
from sluice.operators.statistics import quantiles

_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(256)
_ERF = np.vectorize(math.erf)


def _below(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + _ERF(np.asarray(x, float) / math.sqrt(2)))


def crossing_probabilities(bounds: Sequence[float], information: Sequence[float] | None = None, drift: float = 0.0) -> list[float]:
    """The probability that the z of each look is the first at or beyond its bound, on either side.

    The sum of increments stays a normal density between the bounds; from look to look it is carried
    on by numerical integration. ``information`` grows (equal steps by default); ``drift`` is the mean
    of the last look's z.
    """
    info = np.asarray(information if information is not None else range(1, len(bounds) + 1), float)
    if np.any(np.diff(info) <= 0) or info[0] <= 0:
        raise ValueError("information must grow")
    slope = drift / math.sqrt(info[-1])
    out, at, mass = [], np.zeros(1), np.ones(1)
    for k, bound in enumerate(bounds):
        step = info[k] - (info[k - 1] if k else 0.0)
        edge, dev, mean = bound * math.sqrt(info[k]), math.sqrt(step), slope * step
        outside = _below((-edge - at - mean) / dev) + 1 - _below((edge - at - mean) / dev)
        out.append(float((mass * outside).sum()))
        here = edge * _NODES
        density = np.exp(-0.5 * ((here[:, None] - at[None, :] - mean) / dev) ** 2) / (dev * math.sqrt(2 * math.pi))
        at, mass = here, edge * _WEIGHTS * (density @ mass)
    return out


def bounds(looks: int, alpha: float = 0.05, kind: str = "pocock", information: Sequence[float] | None = None) -> list[float]:
    """Two-sided z bounds of ``looks`` looks with an error of ``alpha`` over all.

    ``pocock`` has the same bound at each, ``obrien-fleming`` one that falls with the root of the
    information, ``naive`` that of a single look, which doesn't keep the error.
    """
    info = np.asarray(information if information is not None else range(1, looks + 1), float)
    shape = {"pocock": np.ones(looks), "obrien-fleming": np.sqrt(info[-1] / info), "naive": np.ones(looks)}[kind]
    low, high = 0.5, 10.0
    for _ in range(60):
        middle = (low + high) / 2
        error = sum(crossing_probabilities((middle * shape)[-1:] if kind == "naive" else middle * shape, info[-1:] if kind == "naive" else info))
        low, high = (middle, high) if error > alpha else (low, middle)
    return [float(b) for b in low * shape]


def looks(df: DataFrame, order: Column, arm: Column, success: Column, n: int, limits: Sequence[float]) -> DataFrame:
    """``look, n_a, x_a, n_b, x_b, diff, z, p, bound, crossed, stopped`` of a test read ``n`` times.

    ``arm`` is true for the second arm, ``order`` a number by which rows came; looks are at equal
    shares of the rows, ties in the order together. ``z`` is that of two pooled proportions.
    ``crossed`` tells looks at or beyond their bound, ``stopped`` the first of them. Rows with a
    null take no part. A look without rows of both arms has no z.
    """
    rows = df.select(order.cast("double").alias("o"), arm.alias("b"), success.cast("boolean").alias("x")).where("o is not null and b is not null and x is not null")
    edges = quantiles(rows, "o", [k / n for k in range(1, n)])
    own = (1 + F.size(F.filter(F.array(*map(F.lit, edges)).cast("array<double>"), lambda e: e < F.col("o")))).alias("look")
    counts = rows.groupBy(own).agg(F.count_if(~F.col("b")).alias("n_a"), F.count_if(~F.col("b") & F.col("x")).alias("x_a"), F.count_if(F.col("b")).alias("n_b"), F.count_if(F.col("b") & F.col("x")).alias("x_b"))
    every = df.sparkSession.createDataFrame([(k + 1, float(b)) for k, b in enumerate(limits)], "look int, bound double")
    upto = Window.partitionBy(F.lit(0)).orderBy("look").rowsBetween(Window.unboundedPreceding, 0)  # n rows
    summed = every.join(counts, "look", "left").select("look", "bound", *[F.sum(F.coalesce(c, F.lit(0))).over(upto).alias(c) for c in ("n_a", "x_a", "n_b", "x_b")])
    pa, pb = F.try_divide("x_a", "n_a"), F.try_divide("x_b", "n_b")
    pooled = F.try_divide(F.col("x_a") + F.col("x_b"), F.col("n_a") + F.col("n_b"))
    error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1), "n_a") + F.try_divide(F.lit(1), "n_b")))
    z = F.when(error > 0, (pb - pa) / error)
    marked = summed.select("look", "n_a", "x_a", "n_b", "x_b", (pb - pa).alias("diff"), z.alias("z"), normal_two_sided(z).alias("p"), "bound", F.coalesce(F.abs(z) >= F.col("bound"), F.lit(False)).alias("crossed"))
    first = F.min(F.when(F.col("crossed"), F.col("look"))).over(Window.partitionBy(F.lit(0)))
    return marked.withColumn("stopped", F.coalesce(F.col("look") == first, F.lit(False)))
