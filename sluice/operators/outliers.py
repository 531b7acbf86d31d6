"""Isolation forest over numeric columns, with the features that make a row stand out.

Trees are grown on the driver from a bounded sample of rows (``trees * sample`` at most, chosen by
a hash of the row), and every row of the table is scored in batches where it lies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EULER = 0.5772156649015329


def average_path(n: np.ndarray | float) -> np.ndarray:
    """The mean depth of an unsuccessful search among ``n`` rows, by which path lengths are measured."""
    n = np.asarray(n, float)
    grown = 2 * (np.log(np.maximum(n - 1, 1)) + EULER) - 2 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, grown, np.where(n == 2, 1.0, 0.0))


@dataclass
class Tree:
    """Nodes in arrays; ``feature`` is -1 at a leaf, whose ``value`` is the path length there, else the cut."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    right: np.ndarray

    def depths(self, rows: np.ndarray) -> np.ndarray:
        at = np.zeros(len(rows), np.int64)
        moving = np.arange(len(rows))
        while len(moving):
            node = at[moving]
            inner = self.feature[node] >= 0
            moving, node = moving[inner], node[inner]
            below = rows[moving, self.feature[node]] < self.value[node]
            at[moving] = np.where(below, self.left[node], self.right[node])
        return self.value[at]


def grow(rows: np.ndarray, rng: np.random.Generator) -> Tree:
    """A tree of random cuts on random features that differ, down to single rows or log2 of their number."""
    most = math.ceil(math.log2(max(2, len(rows))))
    feature, value, left, right = [], [], [], []
    todo = [(np.arange(len(rows)), 0, -1, False)]
    while todo:
        own, depth, parent, is_left = todo.pop()
        node = len(feature)
        if parent >= 0:
            (left if is_left else right)[parent] = node
        low, high = rows[own].min(axis=0), rows[own].max(axis=0)
        open_ = np.flatnonzero(high > low)
        left.append(0)
        right.append(0)
        if depth >= most or len(own) <= 1 or not len(open_):
            feature.append(-1)
            value.append(depth + float(average_path(len(own))))
            continue
        f = int(rng.choice(open_))
        # Never at the lowest value, so that both sides have rows.
        cut = float(np.nextafter(low[f], high[f])) if (c := rng.uniform(low[f], high[f])) <= low[f] else float(c)
        below = rows[own, f] < cut
        feature.append(f)
        value.append(cut)
        todo += [(own[~below], depth + 1, node, False), (own[below], depth + 1, node, True)]
    return Tree(np.array(feature), np.array(value), np.array(left), np.array(right))


@dataclass
class Forest:
    features: list[str]
    trees: list[Tree]
    sample: int

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """From 0 to 1; higher stands further apart."""
        total = np.zeros(len(rows))
        for tree in self.trees:
            total += tree.depths(rows)
        scale = float(average_path(self.sample))
        return 2 ** -(total / max(1, len(self.trees)) / scale) if scale else np.full(len(rows), 0.5)


def fit_forest(df: DataFrame, features: list[str], trees: int = 100, sample: int = 256, seed: int = 0) -> Forest:
    """A forest of ``trees`` trees, each of ``sample`` rows drawn from at most ``trees * sample`` rows of the table.

    Rows with a null or not finite feature are not learned from. The draw goes by a hash of the
    features and the seed, so it doesn't depend on how rows are dealt.
    """
    usable = df.select(*[F.col(f).cast("double").alias(f) for f in features]).where(_finite(features))
    drawn = usable.withColumn("draw_", F.xxhash64(F.lit(seed), *features)).orderBy("draw_", *features).limit(trees * sample)
    pool = drawn.select(*features).toPandas().to_numpy(float)
    rng = np.random.default_rng(seed)
    size = min(sample, len(pool))
    return Forest(features, [grow(pool[rng.choice(len(pool), size, replace=False)], rng) for _ in range(trees)] if size else [], size)


def _finite(features: list[str]):
    kept = F.lit(True)
    for f in features:
        kept = kept & F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double")) & (F.abs(F.col(f).cast("double")) != float("inf"))
    return kept


def explained_outliers(df: DataFrame, features: list[str], contamination: float = 0.05, trees: int = 100, sample: int = 256, seed: int = 0, reasons: int = 3, least_z: float = 1.5) -> DataFrame:
    """Rows with ``score``, ``outlier`` and ``reasons``, an array of ``feature, z, direction``.

    ``contamination`` is the share of rows flagged: those that score above the quantile, which is
    taken to one in 100,000. Reasons are the up to three features furthest from their mean, at
    ``least_z`` population deviations or more, furthest first. A row with a null or not finite feature
    has no score, isn't flagged and has no reasons. Equal rows score alike.
    """
    forest = fit_forest(df, features, trees, sample, seed)
    shared = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(columns: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for part in columns:
            rows = part.to_numpy(float)
            fit = np.isfinite(rows).all(axis=1)
            out = np.full(len(rows), np.nan)
            out[fit] = shared.value.scores(rows[fit])
            yield pd.Series(out)

    numbers = F.struct(*[F.col(f).cast("double").alias(f) for f in features])
    scored = df.withColumn("score", F.when(_finite(features), score(numbers)))
    edge = scored.agg(F.percentile_approx("score", 1 - contamination, 100_000).alias("edge_"))
    usable = df.where(_finite(features))
    moments = usable.agg(*[F.avg(F.col(f).cast("double")).alias(f"mean_{f}") for f in features], *[F.stddev_pop(F.col(f).cast("double")).alias(f"dev_{f}") for f in features])
    z = [(F.col(f).cast("double") - F.col(f"mean_{f}")) / F.when(F.col(f"dev_{f}") == 0, 1e-9).otherwise(F.col(f"dev_{f}")) for f in features]
    ranked = F.reverse(F.array_sort(F.array(*[F.struct(F.abs(v).alias("far"), F.lit(f).alias("feature"), F.round(v, 2).alias("z")) for f, v in zip(features, z)])))
    named = F.transform(F.filter(F.slice(ranked, 1, reasons), lambda r: r["far"] >= least_z), lambda r: F.struct(r["feature"].alias("feature"), r["z"].alias("z"), F.when(r["z"] > 0, "high").otherwise("low").alias("direction")))
    # One row of each of the two aggregates.
    whole = scored.join(F.broadcast(edge)).join(F.broadcast(moments))
    return whole.withColumns({"outlier": F.coalesce(F.col("score") > F.col("edge_"), F.lit(False)), "reasons": F.when(F.col("score") > F.col("edge_"), named).otherwise(F.array().cast("array<struct<feature:string,z:double,direction:string>>"))}).select(*df.columns, "score", "outlier", "reasons")
