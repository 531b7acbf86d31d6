"""Models and series over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.core.session import table
from sluice.operators import models as M
from sluice.queries import query


@query()
def customer_segments(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").cast("double").alias("frequency"), F.sum("o_totalprice").alias("monetary"), F.datediff(F.lit("2000-01-01").cast("date"), F.max("o_orderdate").cast("date")).cast("double").alias("recency"))
    rows, _ = M.segments(orders, ["recency", "frequency", "monetary"], range(2, 5))
    return rows.groupBy("segment").agg(F.count("*").alias("customers"), F.round(F.avg("monetary"), 2).alias("monetary"))


@query()
def text_classifier_quality(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "text", F.col("quality").cast("double").alias("label"))
    model = M.text_classifier(rows.where("doc_id % 4 <> 0"), "text", "label", vocabulary=5000)
    return model.transform(rows.where("doc_id % 4 = 0")).select("doc_id", "label", "prediction")


@query("""
WITH r AS (SELECT o_custkey AS u, l_suppkey AS i, avg(l_quantity) AS r FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2), n AS (SELECT i, sqrt(sum(r ** 2)) AS norm FROM r GROUP BY 1),
p AS (SELECT a.i AS item, b.i AS other, sum(a.r * b.r) AS dot, count(*) AS shared FROM r a JOIN r b ON a.u = b.u AND a.i != b.i GROUP BY 1, 2),
s AS (SELECT item, other, round(dot / (n1.norm * n2.norm), 9) AS score FROM p JOIN n n1 ON item = n1.i JOIN n n2 ON other = n2.i WHERE shared >= 2)
SELECT item, other, score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, other) AS rank FROM s) WHERE rank <= 3
""")
def item_similarity(spark, sf_dir):
    bought = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return M.item_similarity(bought, "o_custkey", "l_suppkey", "l_quantity", 3, 2, unowned=True)


@query("""
WITH m AS (SELECT o_orderpriority AS k, CAST((year(o_orderdate) - 1990) * 12 + month(o_orderdate) AS DOUBLE) AS x, round(sum(o_totalprice), 2) AS y FROM orders GROUP BY 1, 2)
SELECT a.k AS key, round(median((b.y - a.y) / (b.x - a.x)), 4) AS slope FROM m a JOIN m b ON a.k = b.k AND a.x < b.x GROUP BY 1
""")
def theil_sen_trend(spark, sf_dir):
    x = ((F.year("o_orderdate") - 1990) * 12 + F.month("o_orderdate")).alias("x")
    monthly = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("key"), x).agg(F.round(F.sum("o_totalprice"), 2).alias("y"))
    return M.theil_sen(monthly, ["key"], "x", "y").withColumn("slope", F.round("slope", 4))


@query()
def sales_forecast(spark, sf_dir):
    monthly = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("key"), F.trunc("o_orderdate", "MM").alias("date")).agg(F.sum("o_totalprice").alias("value"))
    return M.forecast(monthly, "key", "date", "value", 12, 6).withColumn("forecast", F.round("forecast", 2))


@query("""
WITH p AS (SELECT event_type AS unit, ts::DATE AS day, avg(value) AS v FROM events GROUP BY 1, 2)
SELECT unit, day, round(v - avg(v) OVER (PARTITION BY unit) - avg(v) OVER (PARTITION BY day) + avg(v) OVER (), 6) AS demeaned FROM p
""")
def two_way_demean(spark, sf_dir):
    panel = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("unit"), F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    return M.two_way_demean(panel, "unit", "day", "v").select("unit", "day", F.round("demeaned", 6).alias("demeaned"))


@query("SELECT round(greatest(avg(toxic), 1 - avg(toxic)), 6) AS majority, round(avg(CAST((toxic = 1) = (n_chars > 3000) AS INTEGER)), 6) AS one_rule FROM labels JOIN documents USING (doc_id)")
def baseline_ladder(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    out = M.naive_baselines(rows, F.col("toxic") == 1, F.col("n_chars") > 3000)
    return out.select(F.round("majority", 6).alias("majority"), F.round("one_rule", 6).alias("one_rule"))


@query()
def balanced_labels(spark, sf_dir):
    thin = M.undersample(table(spark, sf_dir, "labels"), "toxic", "doc_id", 2.0)
    return M.folds(thin, "toxic", "doc_id", 5).groupBy("toxic", "fold").agg(F.count("*").alias("n"))
