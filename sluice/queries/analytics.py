"""Metric layer, exploration and product analytics over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.core.session import table
from sluice.operators import analytics as A
from sluice.plans import metrics as M
from sluice.queries import query

REVENUE = M.Metric("revenue", "sum(l_extendedprice)", ("l_returnflag", "l_linestatus"), (), "finance")


@query("SELECT l_returnflag, round(sum(l_extendedprice), 2) AS revenue FROM lineitem GROUP BY 1")
def metric_revenue_by_flag(spark, sf_dir):
    return M.compute(REVENUE, table(spark, sf_dir, "lineitem"), ["l_returnflag"]).withColumn("revenue", F.round("revenue", 2))


@query("SELECT o_orderpriority, count(DISTINCT o_custkey) AS buyers FROM orders WHERE o_totalprice > 100000 AND o_orderstatus != 'P' GROUP BY 1")
def metric_filtered_distinct(spark, sf_dir):
    metric = M.Metric("buyers", "count_distinct(o_custkey)", ("o_orderpriority",), ("o_totalprice > 100000", "o_orderstatus != 'P'", "no_such_column = 1"), "sales")
    return M.compute(metric, table(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"])


@query("SELECT l_linestatus, AVG(l_discount) AS avg_discount FROM (SELECT l_linestatus, l_discount FROM lineitem WHERE l_quantity >= 25) GROUP BY l_linestatus".replace("AVG(l_discount)", "round(AVG(l_discount), 8)"))
def metric_sql_backend(spark, sf_dir):
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("metric_lineitem")
    metric = M.Metric("avg_discount", "mean(l_discount)", ("l_linestatus",), ("l_quantity >= 25",), "pricing")
    return spark.sql(M.to_sql(metric, ["l_linestatus"], "metric_lineitem")).withColumn("avg_discount", F.round("avg_discount", 8))


@query(
    "SELECT o_orderpriority, round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 0), 2) AS \"F\", "
    "round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 0), 2) AS \"O\", round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 0), 2) AS \"P\" "
    "FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW') GROUP BY 1"
)
def explore_pivot_status(spark, sf_dir):
    q = M.Explore(("o_orderpriority",), "o_totalprice", "sum", {"o_orderpriority": ["1-URGENT", "2-HIGH", "5-LOW"], "missing": [1]}, "o_orderstatus")
    out = M.explore(table(spark, sf_dir, "orders"), q, ["F", "O", "P"])
    return out.select("o_orderpriority", *[F.round(c, 2).alias(c) for c in "FOP"])


@query("SELECT p_brand, count(p_partkey) AS value FROM part GROUP BY 1 ORDER BY value DESC, p_brand LIMIT 5")
def explore_top_n(spark, sf_dir):
    return M.explore(table(spark, sf_dir, "part"), M.Explore(("p_brand",), "p_partkey", "count", top_n=5))


@query("SELECT c_mktsegment, COUNT(*) AS n FROM customer GROUP BY c_mktsegment ORDER BY n DESC LIMIT 3")
def nl_question(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    customers.createOrReplaceTempView("nl_customer")
    sql = M.translate("how many customers, top 3 by c_mktsegment", "nl_customer", customers.columns)
    allowed, issues = M.guard_sql(spark, sql, {"nl_customer": customers.columns})
    if allowed is None:
        raise ValueError(issues)
    return spark.sql(allowed)


FUNNEL = ["view", "click", "signup", "purchase"]
_FUNNEL_SQL = """
WITH u AS (SELECT user_id, {flags} FROM events GROUP BY 1),
c AS (SELECT {counts} FROM u)
SELECT step, position, users, round(100.0 * users / greatest(top, 1), 1) AS pct_of_top, round(100.0 * users / greatest(prev, 1), 1) AS step_conversion,
CASE WHEN position = 1 THEN 0.0 ELSE round(100.0 - round(100.0 * users / greatest(prev, 1), 1), 1) END AS drop_off_pct FROM ({rows})
""".format(
    flags=", ".join(f"max(CASE WHEN event_type = '{s}' THEN 1 ELSE 0 END) AS s{i}" for i, s in enumerate(FUNNEL)),
    counts=", ".join(f"CAST(sum({' * '.join(f's{j}' for j in range(i + 1))}) AS BIGINT) AS n{i}" for i in range(len(FUNNEL))),
    rows=" UNION ALL ".join(f"SELECT '{s}' AS step, {i + 1} AS position, n{i} AS users, n0 AS top, n{max(0, i - 1)} AS prev FROM c" for i, s in enumerate(FUNNEL)),
)


@query(_FUNNEL_SQL)
def funnel_events(spark, sf_dir):
    return A.funnel(table(spark, sf_dir, "events"), FUNNEL)


@query("""
WITH m AS (SELECT DISTINCT user_id, date_trunc('month', ts)::DATE AS month FROM events),
c AS (SELECT user_id, month, min(month) OVER (PARTITION BY user_id) AS cohort FROM m),
n AS (SELECT cohort, CAST(datediff('month', cohort, month) AS INTEGER) AS period, count(*) AS users FROM c GROUP BY 1, 2)
SELECT cohort, period, users, max(CASE WHEN period = 0 THEN users END) OVER (PARTITION BY cohort) AS cohort_users,
round(100.0 * users / max(CASE WHEN period = 0 THEN users END) OVER (PARTITION BY cohort), 1) AS retention FROM n
""")
def cohort_retention(spark, sf_dir):
    return A.cohort_retention(table(spark, sf_dir, "events"))


@query("""
WITH d AS (SELECT event_type AS metric, ts::DATE AS date, round(sum(value), 6) AS value FROM events GROUP BY 1, 2),
m AS (SELECT *, max(date) OVER (PARTITION BY metric) AS as_of, row_number() OVER (PARTITION BY metric ORDER BY date DESC) AS back FROM d),
a AS (SELECT metric, max(as_of) AS as_of, arg_max(value, date) AS latest, arg_max(value, date) FILTER (date <= as_of - 7) AS week_ago,
  arg_max(value, date) FILTER (date <= as_of - 30) AS month_ago, regr_slope(value, -back::DOUBLE) FILTER (back <= 8) AS slope FROM m GROUP BY 1)
SELECT metric, as_of, latest, week_ago, month_ago, round(slope, 4) AS slope,
CASE WHEN week_ago != 0 THEN round(100.0 * (latest - week_ago) / abs(week_ago), 1) END AS wow_pct,
CASE WHEN month_ago != 0 THEN round(100.0 * (latest - month_ago) / abs(month_ago), 1) END AS mom_pct FROM a
""")
def kpi_asof(spark, sf_dir):
    daily = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("metric"), F.to_date("ts").alias("date")).agg(F.round(F.sum("value"), 6).alias("value"))
    return A.kpi_status(daily)


@query("""
WITH d AS (SELECT o_orderdate::DATE AS date, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY 1),
w AS (SELECT date, value, CASE WHEN count(value) OVER p = 7 AND stddev_pop(value) OVER p > 0 THEN (value - avg(value) OVER p) / stddev_pop(value) OVER p END AS z,
  CASE WHEN lag(value) OVER (ORDER BY date) != 0 THEN (value - lag(value) OVER (ORDER BY date)) / abs(lag(value) OVER (ORDER BY date)) END AS change
  FROM d WINDOW p AS (ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
SELECT date, value, 'zscore' AS kind, CASE WHEN abs(z) >= 6 THEN 'critical' ELSE 'warning' END AS severity, round(z, 4) AS score FROM w WHERE abs(z) >= 3
UNION ALL SELECT date, value, 'trend', CASE WHEN abs(change) >= 2.0 THEN 'critical' ELSE 'warning' END, round(change, 4) FROM w WHERE abs(change) >= 1.0
UNION ALL SELECT date, value, 'floor', 'critical', round(value, 4) FROM w WHERE value < 2
""")
def alert_rolling_z(spark, sf_dir):
    daily = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count("*").cast("double").alias("value"))
    return A.metric_alerts(daily, window=7, z=3.0, floor=2, trend_pct=1.0)


@query("""
WITH p AS (SELECT l_returnflag AS segment, CASE WHEN l_shipdate < TIMESTAMP '1995-06-17' THEN 0 ELSE 1 END AS period, sum(l_quantity) AS volume, sum(l_extendedprice) / sum(l_quantity) AS price
  FROM lineitem GROUP BY 1, 2),
w AS (SELECT segment, max(volume) FILTER (period = 0) AS v0, max(volume) FILTER (period = 1) AS v1, max(price) FILTER (period = 0) AS p0, max(price) FILTER (period = 1) AS p1 FROM p GROUP BY 1
  HAVING max(volume) FILTER (period = 0) > 0 AND max(volume) FILTER (period = 1) > 0)
SELECT segment, round((v1 * p1 - v0 * p0) / (ln(v1 * p1) - ln(v0 * p0)) * ln(v1 / v0), 2) AS volume_effect, round((v1 * p1 - v0 * p0) / (ln(v1 * p1) - ln(v0 * p0)) * ln(p1 / p0), 2) AS price_effect, round(v1 * p1 - v0 * p0, 2) AS delta FROM w
""")
def lmdi_revenue(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("segment"), F.when(F.col("l_shipdate") < "1995-06-17", 0).otherwise(1).alias("period"), "l_quantity", "l_extendedprice")
    wide = rows.groupBy("segment").agg(*[x for p in (0, 1) for x in (F.sum(F.when(F.col("period") == p, F.col("l_quantity"))).alias(f"v{p}"), (F.sum(F.when(F.col("period") == p, F.col("l_extendedprice"))) / F.sum(F.when(F.col("period") == p, F.col("l_quantity")))).alias(f"p{p}"))]).where("v0 > 0 and v1 > 0")
    k0, k1 = F.col("v0") * F.col("p0"), F.col("v1") * F.col("p1")
    return wide.select("segment", F.round(A.lmdi(F.col("v0"), F.col("v1"), k0, k1), 2).alias("volume_effect"), F.round(A.lmdi(F.col("p0"), F.col("p1"), k0, k1), 2).alias("price_effect"), F.round(k1 - k0, 2).alias("delta"))


@query("""
WITH w AS (SELECT c_mktsegment, count(*) AS weight FROM customer GROUP BY 1), q AS (SELECT *, weight * 100 / sum(weight) OVER () AS quota FROM (SELECT c_mktsegment, weight::DOUBLE AS weight FROM w)),
f AS (SELECT *, floor(quota) AS fl, row_number() OVER (ORDER BY quota - floor(quota) DESC, c_mktsegment) AS place FROM q)
SELECT c_mktsegment, CAST(weight AS BIGINT) AS weight, CAST(fl + CASE WHEN place <= 100 - sum(fl) OVER () THEN 1 ELSE 0 END AS BIGINT) AS seats FROM f
""")
def apportion_segment(spark, sf_dir):
    weights = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("weight"))
    return A.apportion(weights, "weight", 100, ["c_mktsegment"])


def _divisor_sql(divisor: str, free: int) -> str:
    return f"""
WITH w AS (SELECT n_name, count(*)::DOUBLE AS weight FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
c AS (SELECT n_name, weight, k, weight / ({divisor}) AS claim FROM w, (SELECT unnest(range({free}, 101))::DOUBLE AS k)),
r AS (SELECT *, row_number() OVER (ORDER BY claim DESC, n_name, k) AS place FROM c)
SELECT n_name, CAST(max(weight) AS BIGINT) AS weight, CAST(sum(CASE WHEN place <= 100 - {free} * (SELECT count(*) FROM w) THEN 1 ELSE 0 END) + {free} AS BIGINT) AS seats FROM r GROUP BY 1
"""


def _nations(spark, sf_dir):
    nations = table(spark, sf_dir, "nation")
    return table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("weight"))


@query(_divisor_sql("k + 0.5", 0))
def apportion_webster(spark, sf_dir):
    return A.apportion(_nations(spark, sf_dir), "weight", 100, ["n_name"], "webster")


@query(_divisor_sql("k + 1", 0))
def apportion_jefferson(spark, sf_dir):
    return A.apportion(_nations(spark, sf_dir), "weight", 100, ["n_name"], "jefferson")


@query(_divisor_sql("CASE WHEN k = 0 THEN 1e-300 ELSE sqrt(k * (k + 1)) END", 1))
def apportion_huntington(spark, sf_dir):
    return A.apportion(_nations(spark, sf_dir), "weight", 100, ["n_name"], "huntington")


@query("""
WITH c AS (SELECT o_orderstatus AS "row", o_orderpriority AS "column", sum(o_totalprice) AS total FROM orders GROUP BY 1, 2),
e AS (SELECT *, sum(total) OVER (PARTITION BY "row") * sum(total) OVER (PARTITION BY "column") / sum(total) OVER () AS expected, total / sum(total) OVER () AS share FROM c)
SELECT "row", "column", round(total, 2) AS total, round(expected, 2) AS expected, round(share, 6) AS share, round(total / expected - 1, 6) AS lift FROM e
""")
def pivot_lift(spark, sf_dir):
    out = A.lift_matrix(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority", "o_totalprice")
    return out.select("row", "column", F.round("total", 2).alias("total"), F.round("expected", 2).alias("expected"), F.round("share", 6).alias("share"), F.round("lift", 6).alias("lift"))


@query("""
WITH s AS (SELECT n_name AS key, sum(c_acctbal) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
SELECT key, round(total, 2) AS total, round(total / sum(total) OVER (), 6) AS share, round(sum(total) OVER (ORDER BY total DESC, key ROWS UNBOUNDED PRECEDING) / sum(total) OVER (), 6) AS cumulative_share FROM s
""")
def concentration_nation(spark, sf_dir):
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    out = A.concentration(joined, "n_name", "c_acctbal")
    return out.select("key", F.round("total", 2).alias("total"), F.round("share", 6).alias("share"), F.round("cumulative_share", 6).alias("cumulative_share"))


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 86400000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) + 1 AS session FROM g)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(ts) AS began, max(ts) AS ended FROM s GROUP BY 1, 2
""")
def sessionize_events(spark, sf_dir):
    marked = A.sessionize(table(spark, sf_dir, "events"), "user_id", "ts", 86400)
    return marked.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("began"), F.max("ts").alias("ended"))


@query("""
WITH r AS (SELECT user_id, ts, min(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT e.event_id, e.user_id, e.ts, r.value AS asof_value FROM (SELECT * FROM events WHERE event_type = 'click') e ASOF LEFT JOIN
(SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) r ON e.user_id = r.user_id AND e.ts >= r.ts
""".strip().split("\n", 1)[1])
def asof_last_purchase(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    clicks = events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    return A.asof_join(clicks, events.where("event_type = 'purchase'"), "ts", ["user_id"], ["value"])


@query("""
WITH v AS (SELECT o_custkey, o_orderdate AS valid_from, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to, o_orderpriority AS tier FROM orders),
f AS (SELECT o_custkey, o_orderkey, o_orderdate + INTERVAL 30 DAY AS moment FROM orders WHERE o_orderstatus = 'F')
SELECT o_orderkey, tier FROM f LEFT JOIN v ON f.o_custkey = v.o_custkey AND moment >= valid_from AND (valid_to IS NULL OR moment < valid_to)
""")
def scd2_asof_lookup(spark, sf_dir):
    from pyspark.sql import Window

    orders = table(spark, sf_dir, "orders")
    next_ = F.lead("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    versions = orders.select("o_custkey", F.col("o_orderdate").alias("valid_from"), next_.alias("valid_to"), F.col("o_orderpriority").alias("tier"))
    facts = orders.where("o_orderstatus = 'F'").select("o_custkey", "o_orderkey", F.expr("o_orderdate + interval 30 days").alias("at"))
    return A.range_join(facts, versions, "o_custkey", "at").select("o_orderkey", "tier")


@query("""
SELECT p_partkey, round(CASE WHEN p_size > 0 THEN p_retailprice * 2 * 0.8 / p_size ELSE 0.0 END, 6) AS rice, rank() OVER (ORDER BY CASE WHEN p_size > 0 THEN p_retailprice * 2 * 0.8 / p_size ELSE 0.0 END DESC) AS rank FROM part
""")
def rice_rank(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size", F.lit(2).alias("impact"), F.lit(0.8).alias("confidence"))
    return A.rice(parts, "p_retailprice", "impact", "confidence", "p_size").select("p_partkey", F.round("rice", 6).alias("rice"), "rank")
