import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.operators import sequential as S

# Published two-sided bounds for an error of 0.05 at equal steps.
POCOCK = {1: 1.960, 2: 2.178, 3: 2.289, 4: 2.361, 5: 2.413, 10: 2.555}
OBRIEN_FLEMING = {2: 1.977, 3: 2.004, 4: 2.024, 5: 2.040, 10: 2.087}


@pytest.mark.parametrize(("kind", "table"), [("pocock", POCOCK), ("obrien-fleming", OBRIEN_FLEMING)])
def test_published_bounds(kind, table):
    for k, z in table.items():
        assert abs(S.bounds(k, 0.05, kind)[-1] - z) < 6e-4
    assert np.allclose(S.bounds(4, kind="obrien-fleming")[0], 2 * S.bounds(4, kind="obrien-fleming")[-1])
    assert abs(S.bounds(3, 0.05, "naive")[1] - 1.959964) < 1e-5


def test_crossings_against_simulation():
    rng = np.random.default_rng(1)
    info, limits, drift = [1.0, 2.5, 3.0, 5.0], [2.2, 2.0, 2.4, 1.9], 1.4
    steps = rng.normal(size=(400_000, 4)) * np.sqrt(np.diff([0, *info])) + drift / math.sqrt(5) * np.diff([0, *info])
    z = np.cumsum(steps, axis=1) / np.sqrt(info)
    hit = np.abs(z) >= limits
    first = np.where(hit.any(1), hit.argmax(1), -1)
    assert np.allclose(S.crossing_probabilities(limits, info, drift), [(first == k).mean() for k in range(4)], atol=3e-3)
    assert abs(sum(S.crossing_probabilities([1.96] * 5)) - 0.1417) < 1e-3
    with pytest.raises(ValueError, match="grow"):
        S.crossing_probabilities([2, 2], [1, 1])


def test_looks_by_hand(spark):
    rng = random.Random(3)
    rows = [(i, rng.random() < 0.5) for i in range(400)]
    rows = [(i, b, rng.random() < (0.65 if b else 0.35)) for i, b in rows] + [(None, True, True), (5, None, True)]
    df = spark.createDataFrame(rows, "o int, b boolean, x boolean").repartition(5)
    out = {r["look"]: r for r in S.looks(df, F.col("o"), F.col("b"), F.col("x"), 4, S.bounds(4)).collect()}
    stopped = None
    for k in range(1, 5):
        own = [r for r in rows if r[0] is not None and r[1] is not None and r[0] < 100 * k]
        n, x = [sum(r[1] == b for r in own) for b in (False, True)], [sum(r[1] == b and r[2] for r in own) for b in (False, True)]
        p = sum(x) / sum(n)
        z = (x[1] / n[1] - x[0] / n[0]) / math.sqrt(p * (1 - p) * (1 / n[0] + 1 / n[1]))
        assert (out[k]["n_a"], out[k]["x_a"], out[k]["n_b"], out[k]["x_b"]) == (n[0], x[0], n[1], x[1]) and abs(out[k]["z"] - z) < 1e-9
        stopped = stopped or (k if abs(z) >= S.bounds(4)[0] else None)
    assert stopped and [k for k in out if out[k]["stopped"]] == [stopped]
    empty = S.looks(df.where("false"), F.col("o"), F.col("b"), F.col("x"), 2, [2.0, 2.0]).collect()
    assert len(empty) == 2 and all(r["z"] is None and not r["crossed"] for r in empty)
