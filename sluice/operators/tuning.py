"""A search for parameters that goes by the trials it has seen.

Finished trials are parted into good and other ones; for each parameter a density is laid over the
values of either, and of values drawn from the good ones' that of the largest ratio of densities is
tried next. Trials of a wave run side by side, as Spark jobs of their own on folds dealt once.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.operators.learning import auc
from sluice.operators.models import folds


@dataclass(frozen=True)
class Number:
    """From ``low`` to ``high``, on a grid of ``step`` if given, by the logarithm if ``log``."""

    low: float
    high: float
    step: float | None = None
    log: bool = False

    def to_unit(self, value: float) -> float:
        a, b, x = (map(math.log, (self.low, self.high, value))) if self.log else (self.low, self.high, value)
        return (x - a) / (b - a) if b > a else 0.5

    def of_unit(self, u: float) -> float:
        if self.log:
            x = math.exp(math.log(self.low) + u * (math.log(self.high) - math.log(self.low)))
        else:
            x = self.low + u * (self.high - self.low)
        if self.step:
            x = self.low + round((x - self.low) / self.step) * self.step
            x = int(round(x)) if float(self.step).is_integer() and float(self.low).is_integer() else x
        return min(max(x, self.low), self.high)


@dataclass(frozen=True)
class Choice:
    values: tuple


Space = dict[str, Number | Choice]


def _mixture(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and widths of normal bumps at the values, as wide as the gap to a neighbour, and one broad bump for all."""
    order = np.sort(units)
    edges = np.r_[0.0, order, 1.0]
    wide = np.maximum(edges[1:-1] - edges[:-2], edges[2:] - edges[1:-1])
    return np.r_[order, 0.5], np.r_[np.clip(wide, 1.0 / min(100, 1 + len(units)), 1.0), 1.0]


def _log_density(x: np.ndarray, centres: np.ndarray, widths: np.ndarray) -> np.ndarray:
    erf = np.vectorize(math.erf)
    inside = 0.5 * (erf((1 - centres) / widths / math.sqrt(2)) - erf(-centres / widths / math.sqrt(2)))
    bumps = np.exp(-0.5 * ((x[:, None] - centres) / widths) ** 2) / (widths * math.sqrt(2 * math.pi) * inside)
    return np.log(bumps.mean(axis=1) + 1e-300)


def propose(space: Space, seen: list[tuple[dict, float]], rng: np.random.Generator, good_share: float = 0.25, drawn: int = 24) -> dict:
    """Parameters to try next, given those tried and their values (higher is better)."""
    ranked = sorted(range(len(seen)), key=lambda i: (-seen[i][1], i))
    n = max(2, math.ceil(good_share * len(seen)))
    good, other = [seen[i][0] for i in ranked[:n]], [seen[i][0] for i in ranked[n:]]
    out = {}
    for name, kind in space.items():
        if isinstance(kind, Choice):
            share = [(1 + sum(p[name] == v for p in good)) / (len(kind.values) + len(good)) for v in kind.values]
            rest = [(1 + sum(p[name] == v for p in other)) / (len(kind.values) + len(other)) for v in kind.values]
            picks = rng.choice(len(share), drawn, p=np.array(share) / sum(share))
            out[name] = kind.values[max(picks.tolist(), key=lambda i: (share[i] / rest[i], -i))]
            continue
        centres, widths = _mixture(np.array([kind.to_unit(p[name]) for p in good]))
        at = rng.integers(len(centres), size=drawn)
        x = centres[at] + widths[at] * rng.normal(size=drawn)
        x = np.where((x < 0) | (x > 1), rng.random(drawn), x)
        ratio = _log_density(x, centres, widths) - _log_density(x, *_mixture(np.array([kind.to_unit(p[name]) for p in other])))
        out[name] = kind.of_unit(float(x[np.argmax(ratio)]))
    return out


def anywhere(space: Space, rng: np.random.Generator) -> dict:
    return {name: kind.values[int(rng.integers(len(kind.values)))] if isinstance(kind, Choice) else kind.of_unit(float(rng.random())) for name, kind in space.items()}


def search(objective: Callable[[dict], float], space: Space, trials: int, side_by_side: int = 4, startup: int = 8, seed: int = 0) -> list[tuple[dict, float]]:
    """The trials in order with their values; the first ``startup`` lie anywhere.

    A wave of ``side_by_side`` trials is proposed on all that is finished; those of one wave count as
    poor for each other, so that they differ. A trial that isn't a number counts as the worst. The
    same seed and objective give the same trials, whatever ends first.
    """
    rng, seen = np.random.default_rng(seed), []
    with ThreadPoolExecutor(side_by_side) as pool:
        while len(seen) < trials:
            wave: list[dict] = []
            for _ in range(min(side_by_side, trials - len(seen))):
                known = seen + [(p, -math.inf) for p in wave]
                wave.append(anywhere(space, rng) if len(seen) + len(wave) < startup else propose(space, known, rng))
            values = list(pool.map(objective, wave))
            seen += [(p, v if v == v else -math.inf) for p, v in zip(wave, values)]
    return seen


def tune(df: DataFrame, label: str, key: str, model: Callable[[dict], Pipeline], space: Space, trials: int = 20, k: int = 3, side_by_side: int = 4, seed: int = 0) -> tuple[dict, DataFrame]:
    """The best parameters of ``model`` by the mean AUC over stratified folds, and ``trial, value, best_so_far, params``.

    Labels are 0 and 1. Every trial sees the same folds, dealt and kept once. Folds whose rows in or
    outside are all of one label count 0.5, as no order can be told there.
    """
    dealt = folds(df, label, key, k, seed).persist()
    counts = {(r["fold"], r["y"]): r["count"] for r in dealt.groupBy("fold", F.col(label).cast("int").alias("y")).count().collect()}
    told = [f for f in range(k) if all(counts.get((f, y)) and any(g != f for g, z in counts if z == y) for y in (0, 1))]

    def objective(params: dict) -> float:
        each = [auc(model(params).fit(dealt.where(F.col("fold") != f)).transform(dealt.where(F.col("fold") == f)), label) for f in told]
        return (math.fsum(each) + 0.5 * (k - len(told))) / k

    seen = search(objective, space, trials, side_by_side, seed=seed)
    dealt.unpersist()
    rows, top = [], -math.inf
    for i, (params, value) in enumerate(seen, 1):
        top = max(top, value)
        rows.append((i, value, top, json.dumps(params, sort_keys=True)))
    return max(seen, key=lambda t: t[1])[0], df.sparkSession.createDataFrame(rows, "trial int, value double, best_so_far double, params string")
