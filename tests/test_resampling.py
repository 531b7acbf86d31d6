import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.operators import resampling


def frame(spark, seed=1, small=37, large=200):
    rng = np.random.default_rng(seed)
    rows = [(i, "large", float(a), float(b)) for i, (a, b) in enumerate(rng.normal(0, 1, (large, 2)))]
    rows += [(1000 + i, "small", float(a), 100 * float(b)) for i, (a, b) in enumerate(rng.normal(5, 2, (small, 2)))]
    rows += [(2000, "lone", 1.0, 2.0), (3000, "small", None, 1.0), (None, "small", 1.0, 1.0), (3001, None, 1.0, 1.0)]
    return spark.createDataFrame(rows, "id long, kind string, a double, b double").withColumn("label", F.lit(0)).repartition(5)


@pytest.mark.parametrize(("ratio", "block"), [(1.0, 4096), (0.5, 4096), (1.0, 10)])
def test_new_rows_lie_between_neighbours_of_their_class(spark, ratio, block):
    df = frame(spark)
    old = {r["id"]: r for r in df.collect() if None not in (r["id"], r["kind"], r["a"])}
    new = resampling.smote(df, "kind", ["a", "b"], "id", neighbours=3, ratio=ratio, block=block).collect()
    want = math.floor(200 * ratio)
    assert {k: sum(r["label"] == k for r in new) for k in ("small", "lone", "large")} == {"small": want - 37, "lone": want - 1, "large": 0}
    dev = {k: np.std([[r["a"], r["b"]] for r in old.values() if r["kind"] == k], axis=0) for k in ("small", "lone")}
    times = {}
    for r in new:
        s, t = old[r["source"]], old[r["neighbour"]]
        assert s["kind"] == t["kind"] == r["label"]
        times[r["source"]] = times.get(r["source"], 0) + 1
        u = [(r[f] - s[f]) / (t[f] - s[f]) for f in "ab" if t[f] != s[f]]
        assert all(-1e-9 <= v <= 1 + 1e-9 for v in u) and (not u or max(u) - min(u) < 1e-6)
        if block > 100 and r["label"] == "small":
            scale = dev["small"]
            far = sorted(np.hypot((o["a"] - s["a"]) / scale[0], (o["b"] - s["b"]) / scale[1]) for o in old.values() if o["kind"] == "small" and o["id"] != s["id"])
            assert np.hypot((t["a"] - s["a"]) / scale[0], (t["b"] - s["b"]) / scale[1]) <= far[2] + 1e-9
    own = [times.get(i, 0) for i, r in old.items() if r["kind"] == "small"]
    assert max(own) - min(own) <= 1
    again = resampling.smote(df.repartition(3), "kind", ["a", "b"], "id", neighbours=3, ratio=ratio, block=block).collect()
    assert sorted(map(tuple, new)) == sorted(map(tuple, again))


def test_even_classes_and_none(spark):
    df = frame(spark).where("kind = 'large'")
    assert resampling.smote(df, "kind", ["a", "b"], "id").count() == 0
    assert resampling.smote(df.where("false"), "kind", ["a", "b"], "id").count() == 0
