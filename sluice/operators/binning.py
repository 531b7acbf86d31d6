"""Binning of a number for a yes-or-no target, with weights of evidence that are frozen for reuse.

Spark counts rows and events between exact quantiles; the few counts are then merged on the driver.
Applying a binning is an expression of the column.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.operators.statistics import quantiles


@dataclass(frozen=True)
class Bin:
    """Rows with ``low < x <= high``, or one special value, or missing ones, by ``kind``."""

    kind: str
    low: float
    high: float
    n: int
    events: int
    woe: float = 0.0
    iv: float = 0.0

    def label(self) -> str:
        return {"missing": "missing", "special": f"= {self.low:g}"}.get(self.kind, f"({self.low:g}, {self.high:g}]")


@dataclass(frozen=True)
class Binning:
    column: str
    bins: tuple[Bin, ...]
    direction: str
    unconstrained_iv: float = field(default=0.0)

    @property
    def iv(self) -> float:
        return sum(b.iv for b in self.bins)

    def _each(self, value: Column, of) -> Column:
        """``of`` the bin of a value; null where no bin was seen for it."""
        numbers = [b for b in self.bins if b.kind == "number"]
        out = F.element_at(F.array(*[F.lit(of(b)) for b in numbers]), 1 + F.size(F.filter(F.array(*[F.lit(b.high) for b in numbers[:-1]]).cast("array<double>"), lambda e: e < value)))
        for b in self.bins:
            if b.kind == "special":
                out = F.when(value == b.low, F.lit(of(b))).otherwise(out)
        missing = [F.lit(of(b)) for b in self.bins if b.kind == "missing"]
        return F.when(value.isNull() | F.isnan(value), missing[0] if missing else F.lit(None)).otherwise(out)

    def label(self, value: Column) -> Column:
        return self._each(value.cast("double"), Bin.label)

    def woe(self, value: Column) -> Column:
        """The frozen weight of evidence; zero, no evidence, for a missing value if none was learned from."""
        return F.coalesce(self._each(value.cast("double"), lambda b: float(b.woe)), F.lit(0.0))

    def table(self, spark) -> DataFrame:
        rows = [(self.column, i, b.label(), b.n, b.events, b.woe, b.iv) for i, b in enumerate(self.bins)]
        return spark.createDataFrame(rows, "column string, bin int, label string, n long, events long, woe double, iv double")


Counts = tuple[int, int]


def weight(rows: int, events: int, all_events: int, all_others: int, smoothing: float) -> tuple[float, float]:
    """Weight of evidence and information value of a bin."""
    good = (events + smoothing) / (all_events + 2 * smoothing)
    bad = (rows - events + smoothing) / (all_others + 2 * smoothing)
    return math.log(good / bad), (good - bad) * math.log(good / bad)


class _Merger:
    """Prebins as prefix sums; a solution is the list of its inner cuts."""

    def __init__(self, counts: Sequence[Counts], smoothing: float):
        self.n, self.e, self.smoothing = [0], [0], smoothing
        for n, e in counts:
            self.n.append(self.n[-1] + n)
            self.e.append(self.e[-1] + e)

    def of(self, a: int, b: int) -> Counts:
        return self.n[b] - self.n[a], self.e[b] - self.e[a]

    def weight(self, a: int, b: int) -> tuple[float, float]:
        return weight(*self.of(a, b), self.e[-1], self.n[-1] - self.e[-1], self.smoothing)

    def parts(self, cuts: list[int]) -> list[tuple[int, int]]:
        edges = [0, *cuts, len(self.n) - 1]
        return list(zip(edges, edges[1:]))

    def iv(self, cuts: list[int]) -> float:
        if self.e[-1] in (0, self.n[-1]):
            return 0.0
        return sum(self.weight(a, b)[1] for a, b in self.parts(cuts))

    def large(self, a: int, b: int, least: int, events: int) -> bool:
        n, e = self.of(a, b)
        return n >= least and e >= events and n - e >= events

    def staged(self, most: int, least: int, events: int, monotone: bool) -> tuple[list[int], list[int], str]:
        """Cuts before and after monotony, and its direction.

        First the leftmost bin that is too small joins its right neighbour (the last its left) until
        none is. Then bins beyond ``most`` merge where the information value stays highest. Last, the
        neighbours that break the direction most of the weights have by the most merge, down to two bins.
        """
        cuts = list(range(1, len(self.n) - 1))
        while cuts:
            weak = next((i for i, (a, b) in enumerate(self.parts(cuts)) if not self.large(a, b, least, events)), None)
            if weak is None:
                break
            del cuts[min(weak, len(cuts) - 1)]
        while len(cuts) + 1 > most:
            without = [cuts[:i] + cuts[i + 1 :] for i in range(len(cuts))]
            cuts = max(without, key=self.iv)
        before, direction = list(cuts), "none"
        if monotone and len(cuts) > 1:
            steps = self._steps(cuts)
            direction = "increasing" if 2 * sum(s > 0 for s in steps) >= len(steps) else "decreasing"
            sign = 1 if direction == "increasing" else -1
            while len(cuts) > 1:
                steps = [sign * s for s in self._steps(cuts)]
                if min(steps) >= 0:
                    break
                del cuts[steps.index(min(steps))]
        return before, cuts, direction

    def _steps(self, cuts: list[int]) -> list[float]:
        w = [self.weight(a, b)[0] for a, b in self.parts(cuts)]
        return [b - a for a, b in zip(w, w[1:])]

    def best(self, most: int, least: int, events: int, sign: int) -> tuple[float, list[int]] | None:
        """The cuts of the highest information value among all monotone ones with bins that are large enough.

        ``found[k][a, b]`` is the best of ``k`` bins that end with the bin from ``a`` to ``b``; sums
        go from left to right, as the weights of the last two bins decide whether they may follow.
        """
        last = len(self.n) - 1
        fit = {(a, b): self.weight(a, b) for a in range(last) for b in range(a + 1, last + 1) if self.large(a, b, least, events)}
        found = {(0, b): (v, []) for (a, b), (_, v) in fit.items() if a == 0}
        done = [x for (a, b), x in found.items() if b == last]
        for _ in range(most - 1):
            grown: dict[tuple[int, int], tuple[float, list[int]]] = {}
            for (a, b), (value, cuts) in found.items():
                for c in range(b + 1, last + 1):
                    if (b, c) in fit and sign * (fit[b, c][0] - fit[a, b][0]) >= 0:
                        new = (value + fit[b, c][1], [*cuts, b])
                        if (b, c) not in grown or new[0] > grown[b, c][0]:
                            grown[b, c] = new
            found = grown
            done += [x for (a, b), x in found.items() if b == last]
        return max(done, key=lambda x: x[0], default=None)


def prebin_counts(df: DataFrame, value: Column, label: Column, edges: Sequence[float], specials: Sequence[float]) -> DataFrame:
    """``kind, at, n, events`` of the ranges between edges (``at`` is the range or the special value)."""
    x = value.cast("double")
    special = x.isin([float(s) for s in specials]) if specials else F.lit(False)
    missing = x.isNull() | F.isnan(x)
    place = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]).cast("array<double>"), lambda e: e < x)).cast("double")
    kind = F.when(missing, "missing").when(special, "special").otherwise("number")
    at = F.when(missing, 0.0).when(special, x).otherwise(place)
    return df.groupBy(kind.alias("kind"), at.alias("at")).agg(F.count("*").alias("n"), F.sum(label.cast("long")).alias("events"))


def fit_binning(df: DataFrame, column: str, label: Column, max_bins: int = 6, max_prebins: int = 20, min_bin_share: float = 0.05, min_bin_events: int = 20, smoothing: float = 0.5, monotone: bool = True, specials: Sequence[float] = (), method: str = "staged") -> Binning:
    """A binning of ``column`` for a 0/1 or boolean ``label`` that is never null.

    Prebins lie between exact quantiles. ``staged`` merges them in three passes: size floors, number
    of bins, monotone weights. ``optimal`` takes the merge of the highest information value among all
    that keep floors, number and monotone weights, and falls back to one bin. Missing (null or NaN)
    and special values are bins of their own, outside of the scale. No numbers at all are an error.
    """
    if method not in ("staged", "optimal"):
        raise ValueError("method is staged or optimal")
    x = F.col(column).cast("double")
    scale = df.select(x.alias("x")).where(x.isNotNull() & ~F.isnan(x) & (~x.isin([float(s) for s in specials]) if specials else F.lit(True)))
    edges = sorted(set(quantiles(scale, "x", [i / max_prebins for i in range(1, max_prebins)])))
    if not edges:
        raise ValueError(f"{column} has no numbers")
    rows = prebin_counts(df, F.col(column), label, edges, specials).collect()
    counted = {int(r["at"]): (r["n"], r["events"]) for r in rows if r["kind"] == "number"}
    merger = _Merger([counted.get(i, (0, 0)) for i in range(len(edges) + 1)], smoothing)
    least = max(1, int(min_bin_share * merger.n[-1]))
    before, cuts, direction = merger.staged(max_bins, least, min_bin_events, monotone)
    if method == "optimal":
        signs = (1, -1) if monotone else (0,)
        found = [(x, sign) for sign in signs if (x := merger.best(max_bins, least, min_bin_events, sign))]
        (_, cuts), sign = max(found, key=lambda f: f[0][0], default=((0.0, []), 0))
        direction = {1: "increasing", -1: "decreasing", 0: "none"}[sign if cuts else 0]
    own = [r for kind in ("missing", "special") for r in sorted((r for r in rows if r["kind"] == kind), key=lambda r: r["at"])]
    highs = [*edges, math.inf]

    def made(cuts: list[int]) -> list[Bin]:
        bins = [Bin("number", highs[a - 1] if a else -math.inf, highs[b - 1], *merger.of(a, b)) for a, b in merger.parts(cuts)]
        return bins + [Bin(r["kind"], r["at"], r["at"], r["n"], r["events"]) for r in own]

    def weighed(bins: list[Bin]) -> list[Bin]:
        events = sum(b.events for b in bins)
        others = sum(b.n for b in bins) - events
        if not events or not others:
            return bins
        return [Bin(b.kind, b.low, b.high, b.n, b.events, *weight(b.n, b.events, events, others, smoothing)) for b in bins]

    free = sum(b.iv for b in weighed(made(before)))
    return Binning(column, tuple(weighed(made(cuts))), direction, free)
