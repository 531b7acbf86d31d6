"""Churn models and schedules over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.core.session import table
from sluice.operators import learning as L
from sluice.operators import schedules, tuning
from sluice.queries import query

FEATURES = ["frequency", "monetary", "recency", "mean_value"]
CUTOFF = "2000-06-01"


def _churn(spark, sf_dir):
    """Customers with orders before the cutoff: features from before it, and whether no order follows."""
    at, date = F.lit(CUTOFF).cast("date"), F.to_date("o_orderdate")
    past = F.when(date < at, F.col("o_totalprice"))
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count(past).cast("double").alias("frequency"),
        F.sum(past).cast("double").alias("monetary"),
        F.datediff(at, F.max(F.when(date < at, date))).cast("double").alias("recency"),
        F.avg(past).cast("double").alias("mean_value"),
        (F.count_if(date >= at) == 0).cast("double").alias("churned"),
    )
    return orders.where("frequency > 0")


@query()
def churn_leaderboard(spark, sf_dir):
    models = {"boosted_trees": L.boosted_trees(FEATURES, "churned", 8), "logistic": L.scaled_logistic(FEATURES, "churned")}
    return L.leaderboard(_churn(spark, sf_dir), "churned", "o_custkey", models, 3)


@query()
def churn_importances(spark, sf_dir):
    return L.importances(_churn(spark, sf_dir), FEATURES, "churned", "o_custkey", F.pmod(F.xxhash64("o_custkey"), F.lit(4)) == 0)


@query("""
WITH c AS (SELECT c_custkey, c_custkey % 60 AS m, c_custkey % 24 AS h, 1 + c_custkey % 28 AS d, c_custkey % 7 AS w, c_custkey % 3 AS rule FROM customer),
days AS (SELECT CAST(t AS DATE) AS day FROM generate_series(TIMESTAMP '2024-01-15', TIMESTAMP '2024-03-14', INTERVAL 1 DAY) AS g(t))
SELECT c_custkey, CAST(day AS TIMESTAMP) + to_hours(h) + to_minutes(CAST(i AS BIGINT)) AS fires_at
FROM c CROSS JOIN days CROSS JOIN generate_series(0, 59) AS s(i)
WHERE CASE rule WHEN 0 THEN i = m AND (day(day) = d OR dayofweek(day) = w) WHEN 1 THEN i = m AND dayofweek(day) BETWEEN 1 AND 5 AND month(day) = 2 ELSE i % 15 = 0 AND day(day) = d END
""")
def cron_fires_customers(spark, sf_dir):
    k = F.col("c_custkey")
    both = F.format_string("%d %d %d * %d", k % 60, k % 24, 1 + k % 28, k % 7)
    line = F.when(k % 3 == 0, both).when(k % 3 == 1, F.format_string("%d %d * feb MON-FRI", k % 60, k % 24)).otherwise(F.format_string("*/15 %d %d * *", k % 24, 1 + k % 28))
    lines = table(spark, sf_dir, "customer").select("c_custkey", line.alias("line"))
    return schedules.fires(lines, "line", "2024-01-15", "2024-03-14").select("c_custkey", "fires_at")


@query()
def tuned_churn(spark, sf_dir):
    """Trials of the logistic model's penalty and features' number of the churn model."""
    model = lambda p: L.scaled_logistic(FEATURES[: p["features"]], "churned", p["penalty"])
    space = {"penalty": tuning.Number(1e-4, 10.0, log=True), "features": tuning.Number(1, len(FEATURES), step=1)}
    return tuning.tune(_churn(spark, sf_dir), "churned", "o_custkey", model, space, trials=6, k=2)[1]
