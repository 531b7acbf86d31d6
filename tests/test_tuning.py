import math
import random

import numpy as np
import pytest

from sluice.operators import learning, tuning
from sluice.operators.tuning import Choice, Number

SPACE = {"rate": Number(1e-4, 1.0, log=True), "depth": Number(1, 20, step=1), "share": Number(0.2, 1.0), "kind": Choice(("a", "b", "c"))}


def hill(p):
    return -((math.log10(p["rate"]) + 2.3) ** 2) - ((p["depth"] - 7) / 6) ** 2 - (p["share"] - 0.6) ** 2 + {"a": 0, "b": 0.7, "c": -0.4}[p["kind"]]


def test_beats_random_search_of_equal_size():
    ours, chance = [], []
    for seed in range(12):
        ours.append(max(v for _, v in tuning.search(hill, SPACE, 48, seed=seed)))
        rng = np.random.default_rng(seed)
        chance.append(max(hill(tuning.anywhere(SPACE, rng)) for _ in range(48)))
    assert np.mean(ours) > np.mean(chance) + 0.05 and sum(a > b for a, b in zip(ours, chance)) >= 9


def test_trials_keep_to_the_space_and_the_seed():
    seen = tuning.search(hill, SPACE, 30, side_by_side=7, seed=3)
    assert len(seen) == 30 and seen == tuning.search(hill, SPACE, 30, side_by_side=7, seed=3)
    for p, _ in seen:
        assert 1e-4 <= p["rate"] <= 1 and isinstance(p["depth"], int) and 1 <= p["depth"] <= 20 and 0.2 <= p["share"] <= 1 and p["kind"] in "abc"
    bad = tuning.search(lambda p: float("nan") if p["kind"] == "a" else hill(p), SPACE, 20, seed=1)
    assert any(v == -math.inf for _, v in bad) and max(v for _, v in bad) > -math.inf


@pytest.mark.parametrize("kind", [Number(1e-3, 10, log=True), Number(2, 9), Number(5, 50, step=5)])
def test_units_and_back(kind):
    for u in (0.0, 0.13, 0.5, 1.0):
        x = kind.of_unit(u)
        assert kind.low <= x <= kind.high and (kind.step or abs(kind.to_unit(x) - u) < 1e-9)


def test_tunes_a_model_on_shared_folds(spark):
    rng = random.Random(2)
    rows = [(i, float(y := rng.random() < 0.4), rng.gauss(1.2 * y, 1), rng.gauss(0, 1)) for i in range(300)]
    df = spark.createDataFrame([(i, y, a, b) for i, y, a, b in rows], "id long, y double, a double, b double")
    best, history = tuning.tune(df, "y", "id", lambda p: learning.scaled_logistic(["a", "b"], "y", p["penalty"]), {"penalty": Number(1e-4, 10, log=True)}, trials=5, k=2, side_by_side=3)
    rows = history.orderBy("trial").collect()
    assert len(rows) == 5 and rows[-1]["best_so_far"] == max(r["value"] for r in rows) > 0.7 and 1e-4 <= best["penalty"] <= 10
    assert all(a["best_so_far"] <= b["best_so_far"] for a, b in zip(rows, rows[1:]))
