import math
import random

import numpy as np

from sluice.operators import backtests, models


def by_hand(y, horizon, origins, least, step, period):
    out, n = {}, len(y)
    for o in [n - horizon - i * step for i in range(origins)]:
        if o >= least:
            for h in range(1, horizon + 1):
                back = o - 1 + h - period * math.ceil(h / period)
                drift = (y[o - 1] - y[0]) / (o - 1) if o > 1 else 0.0
                for model, f in (("naive", y[o - 1]), ("seasonal", y[back] if back >= 0 else None), ("drift", y[o - 1] + h * drift), ("mean", np.mean(y[:o]))):
                    if f is not None:
                        out[o, h, model] = y[o - 1 + h] - f
    return out


def test_origins_by_hand(spark):
    rng = random.Random(1)
    series = {k: [rng.random() * 10 + t % 4 for t in range(n)] for k, n in (("a", 40), ("b", 23), ("short", 6), (None, 30))}
    df = spark.createDataFrame([(k, t, v) for k, s in series.items() for t, v in enumerate(s)], "k string, t int, y double").repartition(5)
    for horizon, origins, least, step, period in ((3, 5, 8, 1, 4), (6, 3, 12, 4, 4), (2, 4, 1, 7, 12)):
        errors = backtests.rolling_origins(df, ["k"], "t", "y", horizon, origins, least, step, period)
        got = {(r["k"], r["origin"], r["ahead"], r["model"]): r["error"] for r in errors.collect()}
        want = {(k, *key): e for k, s in series.items() for key, e in by_hand(s, horizon, origins, least, step, period).items()}
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    whole = {r["model"]: r for r in backtests.scores(errors, ["model"]).collect()}
    e = [v for k, v in want.items() if k[3] == "naive"]
    assert abs(whole["naive"]["rmse"] - math.sqrt(np.mean(np.square(e)))) < 1e-9 and whole["naive"]["n"] == len(e)


def test_recommendations_by_hand(spark):
    rng = random.Random(2)
    rows = [(u, i, float(rng.randint(1, 5))) for u in range(12) for i in range(8) if rng.random() < 0.4]
    df = spark.createDataFrame(rows, "u int, i int, r double")
    m = np.zeros((12, 8))
    for u, i, r in rows:
        m[u, i] = r
    norm = np.sqrt((m * m).sum(0))
    sim = np.round((m.T @ m) / np.maximum(np.outer(norm, norm), 1e-12), 9)
    np.fill_diagonal(sim, 0)
    got = [tuple(r) for r in models.recommend(df, models.item_similarity(df, "u", "i", "r", 1000), "u", "i", "r", 3).orderBy("user", "rank").collect()]
    want = []
    for u in range(12):
        scores = sorted(((-round(float(m[u] @ sim[:, j]), 9), j) for j in range(8) if not m[u, j] and m[u] @ sim[:, j] > 0))[:3]
        for k, (s, j) in enumerate(scores, 1):
            want.append((u, k, j, -s, max((i for i in range(8) if m[u, i]), key=lambda i: (m[u, i] * sim[i, j], -i))))
    assert [g[:3] for g in got] == [w[:3] for w in want] and all(abs(g[3] - w[3]) < 1e-6 and g[4] == w[4] for g, w in zip(got, want))


def test_recommended_scores_are_rounded_once(spark):
    rows = spark.createDataFrame([(1, 1, 61.47764999952)], "u int, i int, r double")
    similar = spark.createDataFrame([(1, 2, 1.0)], "item int, other int, score double")
    assert models.recommend(rows, similar, "u", "i", "r", 3).selectExpr("round(score, 4)").first()[0] == 61.4776


def test_rated_at_zero_or_less_is_rated(spark):
    """An item rated 0 isn't recommended, a negative rating counts against, a missing one for nothing."""
    similar = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.4), (1, 4, 0.3), (5, 4, 0.2), (1, 6, 0.1)], "item int, other int, score double")
    rows = spark.createDataFrame([(1, 1, 10.0), (1, 2, 0.0), (1, 5, -20.0), (1, 3, None), (2, 1, 1.0), (3, 5, -1.0)], "u int, i int, r double")
    got = [tuple(r) for r in models.recommend(rows, similar, "u", "i", "r", 3).orderBy("user", "rank").collect()]
    assert got == [(1, 1, 6, 1.0, 1), (2, 1, 2, 0.5, 1), (2, 2, 3, 0.4, 1), (2, 3, 4, 0.3, 1)]


def test_item_pairs_are_summed_where_they_arise(spark):
    import itertools
    import re

    rng = random.Random(5)
    rows = [(u if u else None, i, float(rng.randint(1, 5))) for u in range(30) for i in range(50) if rng.random() < 0.2]
    out = models.item_similarity(spark.createDataFrame(rows, "u int, i int, r double"), "u", "i", "r", 5, 2)
    got = sorted(tuple(r) for r in out.collect())
    of = {}
    for u, i, r in rows:
        of.setdefault(i, {})[u] = r
    want = []
    norm = {i: math.sqrt(sum(r * r for u, r in x.items() if u)) for i, x in of.items()}
    for i in of:
        shared = {j: [(of[i][u], of[j][u]) for u in of[i] if u and u in of[j]] for j in of if j != i}
        scored = sorted((-round(sum(a * b for a, b in s) / (norm[i] * norm[j]), 9), j) for j, s in shared.items() if len(s) >= 2)
        want += [(i, j, -s) for s, j in itertools.islice(scored, 5)]
    assert [g[:2] for g in got] == [w[:2] for w in sorted(want)] and all(abs(g[2] - w[2]) < 1e-8 for g, w in zip(got, sorted(want)))
    # No exchange by the items of a pair.
    assert not re.search(r"hashpartitioning\((cell#\d+, )?\w+#\d+L?, \w+#\d+L?", out._jdf.queryExecution().executedPlan().toString())
