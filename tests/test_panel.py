import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.operators import panel


def made(seed, units=60):
    rng = random.Random(seed)
    rows = []
    for u in range(units):
        adopt = rng.choice([None, 3, 4, 6])
        level = rng.gauss(0, 2)
        for t in range(8):
            if rng.random() < 0.05:
                continue
            rows.append((u, u % 7, t, level + 0.3 * t + (1.5 if adopt is not None and t >= adopt else 0) + rng.gauss(0, 0.5), adopt))
    return rows


def by_hand(rows, clustered):
    y = {(u, t): v for u, _, t, v, _ in rows}
    about = {u: (c, a) for u, c, _, _, a in rows}
    out = {}
    for g in sorted({a for _, a in about.values() if a is not None}):
        for t in range(g, 8):
            arms = {True: {}, False: {}}
            for u, (c, a) in about.items():
                if (u, t) in y and (u, g - 1) in y and (a == g or a is None or a > t):
                    arms[a == g][u] = y[u, t] - y[u, g - 1]
            if arms[True] and arms[False]:
                means = {k: np.mean(list(v.values())) for k, v in arms.items()}
                sums = {}
                for k, v in arms.items():
                    for u, d in v.items():
                        c = about[u][0] if clustered else u
                        sums[c] = sums.get(c, 0) + (1 if k else -1) * (d - means[k]) / len(v)
                out[g, t] = (len(arms[True]), len(arms[False]), means[True] - means[False], math.sqrt(sum(s * s for s in sums.values())))
    return out


@pytest.mark.parametrize("cluster", [None, "cluster"])
def test_group_time_effects_by_hand(spark, cluster):
    rows = made(1)
    df = spark.createDataFrame(rows, "unit long, cluster int, t int, y double, adopt int").withColumn("g", F.lit("x")).repartition(5)
    got = {(r["g"], r["t"]): r for r in panel.group_time_effects(df, "unit", "t", "y", "adopt", cluster).collect()}
    want = by_hand(rows, cluster is not None)
    assert set(got) == set(want)
    for k, (n, m, effect, error) in want.items():
        assert (got[k]["n_treated"], got[k]["n_control"]) == (n, m)
        assert math.isclose(got[k]["effect"], effect, abs_tol=1e-9) and math.isclose(got[k]["error"], error, rel_tol=1e-9) and 0 <= got[k]["p"] <= 1
    effects = panel.group_time_effects(df, "unit", "t", "y", "adopt", cluster)
    whole = panel.overall_effect(effects).first()
    assert math.isclose(whole["effect"], sum(n * e for n, _, e, _ in want.values()) / sum(n for n, *_ in want.values())) and abs(whole["effect"] - 1.5) < 0.3
    assert {r["after"] for r in panel.event_study(effects).collect()} == {t - g for g, t in want}
    assert panel.group_time_effects(df.where("adopt is null"), "unit", "t", "y", "adopt").count() == 0


def plain_f(x, y, p, period):
    n = len(y)
    lag = lambda z: [z[p - k : n - k] for k in range(1, p + 1)]
    a = 2 * np.pi * np.arange(p, n) / (period or 1)
    season = [np.sin(a), np.cos(a), np.sin(2 * a), np.cos(2 * a)] if period else []
    left = lambda columns: np.linalg.lstsq(np.column_stack([np.ones(n - p), *columns]), y[p:], rcond=None)[1].sum()
    less, more = left(lag(y) + season), left(lag(y) + lag(x) + season)
    df2 = n - p - 1 - 2 * p - len(season)
    return ((less - more) / p) / (more / df2), df2


@pytest.mark.parametrize(("lags", "period"), [(4, 12), (2, None), (1, 7)])
def test_granger_equals_numpy(spark, lags, period):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for key in range(4):
        x = rng.normal(0, 1, 140 + key)
        y = np.zeros(len(x))
        for t in range(2, len(x)):
            y[t] = 0.5 * y[t - 1] + (0.8 * x[t - 1] if key % 2 else 0) + rng.normal() + 100 * (key == 3)
        rows += [(key, t, float(a), float(b)) for t, (a, b) in enumerate(zip(x, y))]
        want[key] = plain_f(x, y, lags, period)
    rows += [(9, t, 1.0, 2.0) for t in range(60)] + [(10, 0, 1.0, 2.0), (10, 1, None, 2.0), (9, 70, None, 1.0)]
    df = spark.createDataFrame(rows, "key int, t int, x double, y double").repartition(6)
    got = {r["key"]: r for r in panel.granger(df, ["key"], "t", "x", "y", lags, period).collect()}
    for key, (f, df2) in want.items():
        assert math.isclose(got[key]["f"], f, rel_tol=1e-6) and got[key]["df2"] == df2 and got[key]["df1"] == lags
        assert key == 3 or (got[key]["p"] < 1e-6) == (key == 1)
    assert (got[9]["f"], got[9]["p"]) == (0.0, 1.0) and 10 not in got


def test_a_missing_step_is_not_skipped(spark):
    df = spark.createDataFrame([(1, t, float(t), 0.0) for t in (0, 1, 2, 4, 5, 6)], "key int, t int, x double, y double")
    out = {r["t"]: r["x_lags"] for r in panel.lagged(df, ["key"], "t", ["x", "y"], 2).collect()}
    assert out == {2: [1.0, 0.0], 6: [5.0, 4.0]}
