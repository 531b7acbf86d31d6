"""Outliers, binning, schemas and topics over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.core.session import table
from sluice.operators import binning as B
from sluice.operators import outliers as O
from sluice.operators import resampling as R
from sluice.operators import schemas as J
from sluice.operators import topics as T
from sluice.queries import query


@query()
def outlier_lineitems(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    out = O.explained_outliers(rows, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], contamination=0.01)
    return out.where("outlier").select("l_orderkey", "l_linenumber", F.round("score", 6).alias("score"), F.array_join(F.transform("reasons", lambda r: F.concat_ws(" ", r["feature"], r["direction"])), ", ").alias("reasons"))


def _priced(spark, sf_dir):
    """Whether an order is urgent, by its price and the age of its date in days; some prices stand for none."""
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 17 != 0, F.when(F.col("o_orderkey") % 19 == 0, -1.0).otherwise(F.col("o_totalprice"))).alias("price"), (F.col("o_totalprice") + (F.col("o_orderkey") * 7919) % 300_000 > 300_000).alias("large"))


@query("""
WITH p AS (SELECT CASE WHEN o_orderkey % 17 != 0 THEN CASE WHEN o_orderkey % 19 = 0 THEN -1.0 ELSE o_totalprice END END AS price, o_totalprice + (o_orderkey * 7919) % 300000 > 300000 AS large FROM orders),
q AS (SELECT list_distinct(quantile_cont(price, [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95])) AS edges FROM p WHERE price <> -1)
SELECT CASE WHEN price IS NULL THEN 'missing' WHEN price = -1 THEN 'special' ELSE 'number' END AS kind, CASE WHEN price IS NULL THEN 0 WHEN price = -1 THEN -1 ELSE len(list_filter(edges, lambda e: e < price)) END::DOUBLE AS at, count(*) AS n, sum(large::INT)::BIGINT AS events FROM p, q GROUP BY 1, 2
""")
def prebins_of_prices(spark, sf_dir):
    from sluice.operators.statistics import quantiles

    rows = _priced(spark, sf_dir)
    edges = quantiles(rows.where("price <> -1"), "price", [i / 20 for i in range(1, 20)])
    return B.prebin_counts(rows, F.col("price"), F.col("large"), edges, [-1.0])


@query()
def binned_prices(spark, sf_dir):
    """The optimal bins, as their frozen weights apply to every order."""
    rows = _priced(spark, sf_dir)
    best = B.fit_binning(rows, "price", F.col("large"), specials=[-1.0], method="optimal")
    out = rows.groupBy(best.label(F.col("price")).alias("label"), F.round(best.woe(F.col("price")), 6).alias("woe"))
    return out.agg(F.count("*").alias("n"), F.sum(F.col("large").cast("long")).alias("events"))


@query("""
WITH e AS (SELECT event_id, user_id, event_type, value, props FROM events),
t AS (SELECT event_type AS v, count(*) AS n FROM e GROUP BY 1), s AS (SELECT count(*) AS n FROM e),
f AS (
  SELECT '$' AS path, 'object' AS types, (SELECT n FROM s) AS seen, (SELECT n FROM s) AS of, 0 AS distinct_values
  UNION ALL SELECT '$.id', 'integer', (SELECT n FROM s), (SELECT n FROM s), (SELECT count(DISTINCT event_id) FROM e)
  UNION ALL SELECT '$.type', 'string', (SELECT n FROM s), (SELECT n FROM s), (SELECT count(*) FROM t)
  UNION ALL SELECT '$.props', 'object', (SELECT n FROM s), (SELECT n FROM s), 0
  UNION ALL SELECT '$.props.k', 'integer', (SELECT n FROM s), (SELECT n FROM s), (SELECT count(DISTINCT json_extract(props, '$.k')) FROM e)
  UNION ALL SELECT '$.user', 'object', count(*), (SELECT n FROM s), 0 FROM e WHERE value > 20
  UNION ALL SELECT '$.user.name', 'string', count(*), count(*), count(DISTINCT user_id) FROM e WHERE value > 20
  UNION ALL SELECT '$.tags', 'array', (SELECT n FROM s), (SELECT n FROM s), 0
  UNION ALL SELECT '$.tags[]', 'string', count(*), count(*), count(DISTINCT event_type) FROM e WHERE value > 60)
SELECT path, types, seen, of, distinct_values::BIGINT AS distinct_values, CASE WHEN seen >= 0.98 * of THEN 'required' WHEN seen < 0.2 * of THEN 'rare' ELSE 'optional' END AS decision FROM f WHERE seen > 0
""")
def schema_of_events(spark, sf_dir):
    event = F.struct(
        F.col("event_id").alias("id"), F.col("event_type").alias("type"), F.from_json("props", "k long").alias("props"),
        F.when(F.col("value") > 20, F.struct(F.concat(F.lit("u"), "user_id").alias("name"))).alias("user"),
        F.when(F.col("value") > 60, F.array("event_type")).otherwise(F.array().cast("array<string>")).alias("tags"),
    )
    found = J.fields(J.evidence(table(spark, sf_dir, "events").select(F.to_json(event).alias("text")), "text"))
    return found.select("path", "types", "seen", "of", F.col("distinct").alias("distinct_values"), F.when(F.col("decision").startswith("optional - rare"), "rare").otherwise(F.col("decision")).alias("decision"))


@query("""
SELECT '$.' || key AS path, types, n AS seen, d AS distinct_values FROM (
  SELECT 'conv' AS key, 'integer' AS types, count(*) AS n, count(DISTINCT conv_id) AS d FROM conversations
  UNION ALL SELECT 'turn', 'integer', count(*), count(DISTINCT turn) FROM conversations
  UNION ALL SELECT 'role', 'string', count(*), count(DISTINCT role) FROM conversations
  UNION ALL SELECT 'text', 'string', count(*), count(DISTINCT text) FROM conversations)
""")
def schema_of_conversations(spark, sf_dir):
    turn = F.to_json(F.struct(F.col("conv_id").alias("conv"), "turn", "role", "text"))
    found = J.fields(J.evidence(table(spark, sf_dir, "conversations").select(turn.alias("t")), "t"))
    return found.where("parent = '$'").select("path", "types", "seen", F.col("distinct").alias("distinct_values"))


def _labelled(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").groupBy("doc_id").agg(F.max("n_chars").cast("double").alias("n_chars"), F.max(F.size(F.split("text", " "))).cast("double").alias("n_words"))
    return table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).join(docs, "doc_id")


@query("""
WITH l AS (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1), d AS (SELECT toxic, count(*) AS n FROM l WHERE doc_id IN (SELECT doc_id FROM documents WHERE text IS NOT NULL) GROUP BY 1)
SELECT toxic, n, max(n) OVER () - n AS made FROM d
""")
def smote_labels(spark, sf_dir):
    rows = _labelled(spark, sf_dir)
    made = R.smote(rows, "toxic", ["n_chars", "n_words"], "doc_id").groupBy(F.col("label").alias("toxic")).agg(F.count("*").alias("made"))
    return rows.groupBy("toxic").agg(F.count("*").alias("n")).join(made, "toxic", "left").select("toxic", "n", F.coalesce("made", F.lit(0)).alias("made"))


@query()
def document_topics(spark, sf_dir):
    return T.fit_topics(table(spark, sf_dir, "documents"), "doc_id", "text", 4, rounds=10)[1].select(F.col("id").alias("doc_id"), "topic", F.round("confidence", 4).alias("confidence"))
