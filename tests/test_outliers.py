import numpy as np
from pyspark.sql import functions as F

from sluice.operators import outliers


def plain(tree, row, node=0):
    if tree.feature[node] < 0:
        return tree.value[node]
    return plain(tree, row, tree.left[node] if row[tree.feature[node]] < tree.value[node] else tree.right[node])


def by_hand(rows, rng, depth, most):
    """Mean path lengths of rows in trees grown by recursion, for the law of scores."""
    if depth >= most or len(rows) <= 1 or (rows == rows[0]).all():
        n = len(rows)
        return lambda r: depth + (0 if n < 2 else 1 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n)
    f = rng.choice([k for k in range(rows.shape[1]) if rows[:, k].min() < rows[:, k].max()])
    cut = rng.uniform(rows[:, f].min(), rows[:, f].max())
    low, high = by_hand(rows[rows[:, f] < cut], rng, depth + 1, most), by_hand(rows[rows[:, f] >= cut], rng, depth + 1, most)
    return lambda r: low(r) if r[f] < cut else high(r)


def test_scores_equal_a_plain_walk_and_rank_like_a_plain_forest(spark):
    rng = np.random.default_rng(5)
    x = np.r_[rng.normal(0, 1, (400, 3)), [[9, 0, 0], [0, -8, 0], [7, 7, 7]]].round(4)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double")
    forest = outliers.fit_forest(df, ["a", "b", "c"], 60, 64, seed=3)
    assert len(forest.trees) == 60 and forest.sample == 64
    want = [2 ** -(np.mean([plain(t, r) for t in forest.trees]) / outliers.average_path(64)) for r in x]
    assert np.allclose(forest.scores(x), want)
    assert all(len(t.feature) <= 2 * 64 - 1 and t.value[t.feature < 0].max() <= 6 + outliers.average_path(64) for t in forest.trees)
    trees = [by_hand(x[rng.choice(len(x), 64, replace=False)], rng, 0, 6) for _ in range(200)]
    other = np.array([2 ** -(np.mean([t(r) for t in trees]) / outliers.average_path(64)) for r in x])
    assert np.corrcoef(other, want)[0, 1] > 0.9
    again = outliers.fit_forest(df.repartition(7), ["a", "b", "c"], 60, 64, seed=3)
    assert all((s.value == t.value).all() for s, t in zip(forest.trees, again.trees))


def test_planted_rows_are_found_with_their_reasons(spark):
    rng = np.random.default_rng(6)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(50, 5, (600, 2)).round(3))]
    rows += [(1000, 500.0, 50.0), (1001, 50.0, -300.0), (1002, None, 50.0), (1003, float("nan"), 1e9), (1004, float("inf"), 1.0)]
    df = spark.createDataFrame(rows, "id long, amount double, items double").withColumn("tag", F.lit("x"))
    out = {r["id"]: r for r in outliers.explained_outliers(df, ["amount", "items"], contamination=0.01).collect()}
    assert len(out) == 605 and 5 <= sum(r["outlier"] for r in out.values()) <= 7
    assert out[1000]["outlier"] and [(r["feature"], r["direction"]) for r in out[1000]["reasons"]][0] == ("amount", "high")
    assert out[1001]["outlier"] and [(r["feature"], r["direction"]) for r in out[1001]["reasons"]][0] == ("items", "low")
    for i in (1002, 1003, 1004):
        assert out[i]["score"] is None and not out[i]["outlier"] and out[i]["reasons"] == []
    assert outliers.explained_outliers(df.where("false"), ["amount"]).count() == 0
