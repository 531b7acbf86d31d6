"""Amounts that add up, forecasts held against what came, and recommendations, over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.core.session import table
from sluice.operators import backtests as K
from sluice.operators import models as M
from sluice.operators import money
from sluice.queries import query
from sluice.queries.statistics import rounded

#: Lines that one task joins and sorts, about; there are as many tasks as that takes.
LINES = 250_000


@query("""
WITH r AS (SELECT o_orderkey, l_linenumber, CAST(round(o_totalprice * 100) AS HUGEINT) AS u, CAST(round(l_quantity * 10000) AS HUGEINT) AS w, row_number() OVER (PARTITION BY o_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS copy FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
f AS (SELECT *, sum(w) OVER (PARTITION BY o_orderkey) AS a FROM r), g AS (SELECT *, (u * w) // a AS part, (u * w) % a AS rest FROM f),
p AS (SELECT *, u - sum(part) OVER (PARTITION BY o_orderkey) AS short, row_number() OVER (PARTITION BY o_orderkey ORDER BY rest DESC, l_linenumber, copy) AS place FROM g)
SELECT o_orderkey, l_linenumber, copy::INTEGER AS copy, (part + (place <= short)::INT)::DOUBLE / 100 AS share FROM p
""")
def allocated_order_totals(spark, sf_dir):
    """Each order's price dealt to its lines by quantity, to the cent."""
    from pyspark.sql import Window

    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    parts = 1 + lines.count() // LINES
    prices = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    lines = lines.repartition(parts, "o_orderkey").join(prices.repartition(parts, "o_orderkey"), "o_orderkey")
    copy = F.row_number().over(Window.partitionBy("o_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice"))
    rows = lines.select("o_orderkey", "l_linenumber", F.round(F.col("o_totalprice").cast("decimal(18,4)"), 2).alias("total"), F.col("l_quantity").cast("decimal(18,4)").alias("w"), copy.alias("copy"))
    return money.allocate(rows, ["o_orderkey"], "total", "w", ["l_linenumber", "copy"]).select("o_orderkey", "l_linenumber", "copy", F.col("share").cast("double").alias("share"))


_MONTHS = "SELECT o_orderpriority AS k, (year(o_orderdate) - 1992) * 12 + month(o_orderdate) - 1 AS t, round(sum(o_totalprice), 2) AS y FROM orders GROUP BY 1, 2"


@query(f"""
WITH m AS ({_MONTHS}), s AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY t) - 1 AS t, y FROM m),
z AS (SELECT *, avg(y) OVER w AS mean, first(y) OVER w AS first FROM s WINDOW w AS (PARTITION BY k ORDER BY t ROWS UNBOUNDED PRECEDING)),
o AS (SELECT k, unnest([n - 3, n - 5, n - 7, n - 9]) AS o FROM (SELECT k, count(*) AS n FROM s GROUP BY 1)),
a AS (SELECT z.k, o.o, h, z.y, z.mean, z.first FROM o JOIN z ON z.k = o.k AND z.t = o.o - 1, (SELECT unnest(range(1, 4)) AS h) WHERE o.o >= 24),
e AS (SELECT a.k, a.h AS ahead, b.y - a.y AS naive, b.y - c.y AS seasonal, b.y - (a.y + h * (a.y - a.first) / (o - 1)) AS drift, b.y - a.mean AS mean FROM a JOIN s b ON b.k = a.k AND b.t = a.o - 1 + h LEFT JOIN s c ON c.k = a.k AND c.t = a.o - 1 + h - 12)
SELECT model, ahead, count(*) AS n, round(avg(abs(error)), 2) AS mae, round(sqrt(avg(error ** 2)), 2) AS rmse, round(avg(error), 2) AS bias FROM (UNPIVOT e ON naive, seasonal, drift, mean INTO NAME model VALUE error) GROUP BY 1, 2
""")
def backtested_orders(spark, sf_dir):
    from pyspark.sql import Window

    d = F.col("o_orderdate")
    months = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("k"), ((F.year(d) - 1992) * 12 + F.month(d) - 1).alias("m")).agg(F.round(F.sum("o_totalprice"), 2).alias("y"))
    series = months.withColumn("t", F.row_number().over(Window.partitionBy("k").orderBy("m")) - 1)
    return rounded(K.scores(K.rolling_origins(series, ["k"], "t", "y", 3, 4, 24, 2, 12), ["model", "ahead"]), 2).withColumn("ahead", F.col("ahead").cast("long"))


@query("""
WITH e AS (SELECT user_id AS u, CAST(event_id % 40 AS BIGINT) AS i, avg(value) AS r FROM events WHERE event_type = 'purchase' GROUP BY 1, 2), n AS (SELECT i, sqrt(sum(r ** 2)) AS norm FROM e GROUP BY 1),
p AS (SELECT a.i AS item, b.i AS other, sum(a.r * b.r) AS dot FROM e a JOIN e b ON a.u = b.u AND a.i != b.i GROUP BY 1, 2), s AS (SELECT item, other, round(dot / (x.norm * y.norm), 9) AS score FROM p JOIN n x ON x.i = item JOIN n y ON y.i = other),
k AS (SELECT item, other, score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, other) AS r FROM s) WHERE r <= 10),
c AS (SELECT u, other AS item, sum(r * score) AS score FROM e JOIN k ON k.item = e.i GROUP BY 1, 2), f AS (SELECT c.* FROM c ANTI JOIN e ON e.u = c.u AND e.i = c.item WHERE score > 0)
SELECT u AS "user", rank::INTEGER AS rank, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY round(score, 9) DESC, item) AS rank FROM f) WHERE rank <= 3
""")
def recommended_items(spark, sf_dir):
    bought = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("u"), (F.col("event_id") % 40).alias("i"), "value")
    similar = M.item_similarity(bought, "u", "i", "value", 10, unowned=True)
    return M.recommend(bought, similar, "u", "i", "value", 3).select("user", "rank", F.round("score", 4).alias("score"))
