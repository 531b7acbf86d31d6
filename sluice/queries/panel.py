"""Staggered adoption and leading series over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.core.session import table
from sluice.operators import panel as P
from sluice.operators import sequential as Q
from sluice.queries import query
from sluice.queries.statistics import rounded

_PANEL = """
WITH y AS (SELECT unnest(range(1992, 1999)) AS t), p AS (SELECT c_custkey AS unit, c_nationkey AS cluster, CASE WHEN c_custkey % 5 != 0 THEN 1994 + c_custkey % 4 END AS adopt FROM customer),
o AS (SELECT o_custkey AS unit, year(o_orderdate) AS t, sum(o_totalprice) AS y FROM orders GROUP BY 1, 2),
cells AS (SELECT unit, cluster, adopt, t, coalesce(o.y, 0) AS y FROM p CROSS JOIN y LEFT JOIN o USING (unit, t)),
d AS (SELECT g.g, c.t, c.unit, c.cluster, coalesce(c.adopt = g.g, false) AS treated, c.y - b.y AS change FROM (SELECT DISTINCT adopt AS g FROM p WHERE adopt IS NOT NULL) AS g JOIN cells AS c ON c.t >= g.g AND (c.adopt = g.g OR c.adopt IS NULL OR c.adopt > c.t) JOIN cells AS b ON b.unit = c.unit AND b.t = g.g - 1),
k AS (SELECT g, t, cluster, count(*) FILTER (treated) AS nt, coalesce(sum(change) FILTER (treated), 0) AS st, count(*) FILTER (NOT treated) AS nc, coalesce(sum(change) FILTER (NOT treated), 0) AS sc FROM d GROUP BY 1, 2, 3),
w AS (SELECT *, sum(nt) OVER v AS n_treated, sum(st) OVER v AS a, sum(nc) OVER v AS n_control, sum(sc) OVER v AS b FROM k WINDOW v AS (PARTITION BY g, t)),
e AS (SELECT g, t, n_treated, n_control, a / n_treated - b / n_control AS effect, sqrt(sum(((st - nt * a / n_treated) / n_treated - (sc - nc * b / n_control) / n_control) ** 2)) AS error FROM w WHERE n_treated > 0 AND n_control > 0 GROUP BY 1, 2, 3, 4, 5)
"""


def _effects(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("unit"), F.col("c_nationkey").alias("cluster"), F.when(F.col("c_custkey") % 5 != 0, 1994 + F.col("c_custkey") % 4).alias("adopt"))
    years = people.withColumn("t", F.explode(F.sequence(F.lit(1992), F.lit(1998))))
    spent = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("unit"), F.year("o_orderdate").alias("t")).agg(F.sum("o_totalprice").alias("y"))
    rows = years.join(spent, ["unit", "t"], "left").withColumn("y", F.coalesce("y", F.lit(0.0)))
    return P.group_time_effects(rows, "unit", "t", "y", "adopt", "cluster")


@query(f"{_PANEL} SELECT g::BIGINT AS g, t::BIGINT AS t, n_treated::BIGINT AS n_treated, n_control::BIGINT AS n_control, round(effect, 1) AS effect, round(error, 1) AS error, round(effect / nullif(error, 0), 4) AS z FROM e")
def group_time_orders(spark, sf_dir):
    out = _effects(spark, sf_dir)
    return out.select("g", "t", "n_treated", "n_control", F.round("effect", 1).alias("effect"), F.round("error", 1).alias("error"), F.round("z", 4).alias("z"))


@query(f"{_PANEL} SELECT (t - g)::BIGINT AS after, round(sum(n_treated * effect) / sum(n_treated), 1) AS effect, sum(n_treated)::BIGINT AS n FROM e GROUP BY 1")
def event_study_orders(spark, sf_dir):
    return rounded(P.event_study(_effects(spark, sf_dir)), 1)


@query()
def leading_event_types(spark, sf_dir):
    """For each user, whether the errors of an hour lead the clicks of later ones."""
    hour = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 21600)
    hours = table(spark, sf_dir, "events").groupBy("user_id", hour.alias("t")).agg(F.count_if(F.col("event_type") == "error").cast("double").alias("errors"), F.count_if(F.col("event_type") == "click").cast("double").alias("clicks"))
    ends = table(spark, sf_dir, "events").agg(F.min(hour).alias("low"), F.max(hour).alias("high"))
    grid = hours.select("user_id").distinct().join(F.broadcast(ends)).select("user_id", F.explode(F.sequence("low", "high")).alias("t"))
    series = grid.join(hours, ["user_id", "t"], "left").fillna(0.0, ["errors", "clicks"])
    return rounded(P.granger(series, ["user_id"], "t", "errors", "clicks", 3, 28))


@query("""
WITH r AS (SELECT epoch_us(ts) / 1000 AS o, user_id % 2 = 1 AS b, event_type = 'purchase' AS x FROM events), e AS (SELECT quantile_cont(o, [0.2, 0.4, 0.6, 0.8]) AS e FROM r),
c AS (SELECT 1 + len(list_filter(e, lambda y: y < o)) AS look, count(*) FILTER (NOT b) AS na, count(*) FILTER (NOT b AND x) AS xa, count(*) FILTER (b) AS nb, count(*) FILTER (b AND x) AS xb FROM r, e GROUP BY 1),
s AS (SELECT look, sum(na) OVER w AS n_a, sum(xa) OVER w AS x_a, sum(nb) OVER w AS n_b, sum(xb) OVER w AS x_b FROM c WINDOW w AS (ORDER BY look)), q AS (SELECT *, (x_a + x_b) / (n_a + n_b) AS q FROM s),
z AS (SELECT *, (x_b / n_b - x_a / n_a) / sqrt(q * (1 - q) * (1 / n_a + 1 / n_b)) AS z FROM q)
SELECT look, n_a::BIGINT AS n_a, x_a::BIGINT AS x_a, n_b::BIGINT AS n_b, x_b::BIGINT AS x_b, round(z, 5) AS z, 2.413 AS bound, abs(z) >= 2.4132 AS crossed FROM z
""")
def sequential_looks(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    order = F.unix_micros(F.col("ts").cast("timestamp")) / 1000
    out = Q.looks(rows, order, F.col("user_id") % 2 == 1, F.col("event_type") == "purchase", 5, Q.bounds(5))
    return out.select("look", "n_a", "x_a", "n_b", "x_b", F.round("z", 5).alias("z"), F.round("bound", 3).alias("bound"), "crossed")
