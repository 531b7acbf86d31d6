from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sluice.operators import learning, schedules


def _rows(spark):
    """The label follows ``x``; ``noise`` says nothing."""
    x = (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0).alias("x")
    noise = (F.pmod(F.xxhash64(F.lit(9), "id"), F.lit(1000)) / 1000.0).alias("noise")
    return spark.range(600).select("id", x, noise).withColumn("y", (F.col("x") > 0.4).cast("double"))


def test_a_leaderboard_ranks_models_above_the_prior(spark):
    board = learning.leaderboard(_rows(spark), "y", "id", {"logistic": learning.scaled_logistic(["x", "noise"], "y")}, 3).orderBy("rank").collect()
    assert [r["model"] for r in board] == ["logistic", "prior"]
    assert board[0]["mean_auc"] > 0.98 and board[1]["mean_auc"] == pytest.approx(0.5) and board[1]["std_auc"] == pytest.approx(0)


def test_shuffled_values_occur_as_often_as_before(spark):
    df = _rows(spark)
    out = learning.shuffled(df, "x", "id")
    assert sorted(r["x"] for r in out.collect()) == sorted(r["x"] for r in df.collect())
    assert out.join(df.select("id", F.col("x").alias("was")), "id").where("x <> was").count() > 500


def test_importances_find_the_feature_that_matters(spark):
    out = {r["feature"]: r for r in learning.importances(_rows(spark), ["noise", "x"], "y", "id", F.col("id") % 3 == 0).collect()}
    assert out["x"]["consensus"] == 1 and out["x"]["permutation"] > 0.2 and abs(out["noise"]["permutation"]) < 0.05


def test_risk_bands_have_their_thresholds(spark):
    df = spark.createDataFrame([(0.0,), (0.3,), (0.6,), (None,)], "s double")
    assert [r[0] for r in df.select(learning.risk_band(F.col("s"))).collect()] == ["low", "medium", "high", None]


def test_cron_lines_that_do_not_read(spark):
    lines = ["60 * * * *", "* * * *", "5-1 * * * *", "*/0 * * * *", "a * * * *", "", None, "* * 0 * *", "1,,2 * * * *"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    assert df.where(schedules.parse_cron(F.col("line")).isNotNull()).count() == 0
    assert schedules.fires(df, "line", "2024-01-01", "2024-01-02").count() == 0


def test_cron_against_plain_days(spark):
    want = {
        "0 0 29 2 *": [datetime(2024, 2, 29)],
        "30 6 1 * 7": [datetime(2024, 2, 25, 6, 30), datetime(2024, 3, 1, 6, 30), datetime(2024, 3, 3, 6, 30)],
        "50/5 23 28 * *": [datetime(2024, 2, 28, 23, 50), datetime(2024, 2, 28, 23, 55)],
        "0 12 */2 * mon": [],
        "0 1-5/2 * mar sat,SUN": [datetime(2024, 3, d, h) for d in (2, 3) for h in (1, 3, 5)],
    }
    df = spark.createDataFrame([(x,) for x in want], "line string")
    got = {x: [] for x in want}
    for r in schedules.fires(df, "line", "2024-02-25", "2024-03-03").collect():
        got[r["line"]].append(r["fires_at"])
    want["0 12 */2 * mon"] = []
    assert {k: sorted(v) for k, v in got.items()} == want


def test_each_cron_line_is_read_once(spark):
    """Rows join what their line gave; the parser was written out for every use of a field."""
    df = spark.range(6).select("id", F.when(F.col("id") % 3 == 0, "0 6 * * MON").when(F.col("id") % 3 == 1, "*/30 5 1 * *").alias("line"))
    out = schedules.fires(df, "line", "2024-01-01", "2024-01-08")
    assert "regexp_replace" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["id"], str(r["fires_at"])) for r in out.collect()) == sorted([(i, f"2024-01-0{d} 06:00:00") for i in (0, 3) for d in (1, 8)] + [(i, f"2024-01-01 05:{m}:00") for i in (1, 4) for m in ("00", "30")])
