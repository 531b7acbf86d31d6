import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.operators import binning, statistics


def merges(n):
    for k in range(n):
        yield from (list(c) for c in itertools.combinations(range(1, n), k))


@pytest.mark.parametrize("seed", range(8))
def test_optimal_is_the_best_of_all_monotone_merges(seed):
    rng = random.Random(seed)
    counts = [(n := rng.randint(0, 60), rng.randint(0, n)) for _ in range(9)]
    m = binning._Merger(counts, 0.5)
    for sign, most in itertools.product((1, -1, 0), (1, 3, 5)):
        want = None
        for cuts in merges(9):
            parts = m.parts(cuts)
            w = [m.weight(*p)[0] for p in parts]
            if len(parts) <= most and all(m.large(a, b, 20, 3) for a, b in parts) and all(sign * (y - x) >= 0 for x, y in zip(w, w[1:])):
                want = max(want or 0.0, m.iv(cuts))
        found = m.best(most, 20, 3, sign)
        assert (found is None) == (want is None) and (want is None or math.isclose(found[0], want, abs_tol=1e-12) and math.isclose(m.iv(found[1]), want, abs_tol=1e-12))


@pytest.mark.parametrize("seed", range(8))
def test_staged_keeps_its_promises(seed):
    rng = random.Random(100 + seed)
    counts = [(n := rng.randint(5, 90), rng.randint(0, n)) for _ in range(15)]
    m = binning._Merger(counts, 0.5)
    before, cuts, direction = m.staged(5, 60, 10, True)
    assert all(m.large(a, b, 60, 10) for a, b in m.parts(cuts)) and len(before) < 5 and set(cuts) <= set(before)
    w = [m.weight(*p)[0] for p in m.parts(cuts)]
    sign = {"increasing": 1, "decreasing": -1, "none": 0}[direction]
    assert len(w) <= 2 or all(sign * (y - x) >= 0 for x, y in zip(w, w[1:]))
    assert m.iv(cuts) <= m.iv(before) + 1e-12


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(1)
    x = np.r_[rng.normal(0, 1, 501).round(2), [7.25] * 300]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double").repartition(5)
    p = [0, 0.05, 0.25, 1 / 3, 0.5, 0.9, 1]
    assert np.allclose(statistics.quantiles(df, "x", p), np.percentile(x, [100 * q for q in p]))
    assert statistics.quantiles(df.where("false"), "x", p) == []


def scores(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, 3000)
    y = rng.random(3000) < 1 / (1 + np.exp(-1.3 * x))
    rows = [(float(v), bool(b)) for v, b in zip(x, y)] + [(None, True)] * 40 + [(float("nan"), False)] * 60 + [(-999.0, True)] * 80
    return spark.createDataFrame(rows, "x double, y boolean").withColumn("bin", F.lit(1))


@pytest.mark.parametrize("method", ["staged", "optimal"])
def test_counts_weights_and_reuse(spark, method):
    df = scores(spark)
    b = binning.fit_binning(df, "x", F.col("y"), specials=[-999.0], method=method)
    assert b.direction == "increasing" and sum(x.n for x in b.bins) == 3180 and sum(x.events for x in b.bins) == df.where("y").count()
    missing = next(x for x in b.bins if x.kind == "missing")
    assert (missing.n, missing.events) == (100, 40) and next(x for x in b.bins if x.kind == "special").n == 80
    counted = df.groupBy(b.label(F.col("x")).alias("label"), b.woe(F.col("x")).alias("woe")).agg(F.count("*").alias("n"), F.sum(F.col("y").cast("int")).alias("events")).collect()
    assert {(r["label"], r["n"], r["events"], round(r["woe"], 9)) for r in counted} == {(x.label(), x.n, x.events, round(x.woe, 9)) for x in b.bins}
    assert b.table(spark).count() == len(b.bins) and 0 < b.iv <= b.unconstrained_iv + (1 if method == "optimal" else 1e-12)
    plain = binning.fit_binning(df.where("x is not null and not isnan(x) and x > -900"), "x", F.col("y"), method=method)
    assert spark.range(1).select(plain.woe(F.lit(None).cast("double"))).first()[0] == 0.0


def test_optimal_is_no_worse_and_empty_is_an_error(spark):
    df = scores(spark).where("x is not null and not isnan(x) and x > -900")
    assert binning.fit_binning(df, "x", F.col("y"), method="optimal").iv >= binning.fit_binning(df, "x", F.col("y")).iv - 1e-12
    with pytest.raises(ValueError, match="no numbers"):
        binning.fit_binning(df.where("false"), "x", F.col("y"))
    one = binning.fit_binning(df.where("y"), "x", F.col("y"))
    assert len(one.bins) == 1 and one.iv == 0.0
