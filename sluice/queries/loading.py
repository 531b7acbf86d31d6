"""Files of many dialects and loads in increments, over the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sluice.core.session import shared_dir, table
from sluice.operators import loads as L
from sluice.queries import query
from sluice.sources import csv_dialect as D

STYLES = {
    0: {"sep": ",", "encoding": "UTF-8", "header": "true"},
    1: {"sep": ";", "encoding": "ISO-8859-1", "header": "true", "quoteAll": "true"},
    2: {"sep": "\t", "encoding": "UTF-16", "header": "false", "quoteAll": "true"},
    3: {"sep": "|", "encoding": "UTF-8", "header": "true", "quote": "'", "escape": "'", "quoteAll": "true"},
}


def _files(spark, sf_dir):
    """Customers in files of four dialects; notes hold delimiters, quotes, line ends and letters beyond ASCII."""
    home = f"{shared_dir(spark)}/dialects-{uuid.uuid4().hex}"
    k = F.col("c_custkey")
    note = F.concat(F.lit("né "), "c_mktsegment", F.when(k % 3 == 0, F.lit("; it's, \"so\"")).otherwise(F.lit("")))
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.round("c_acctbal", 2).alias("c_acctbal"), note.alias("note"))
    for i, style in STYLES.items():
        rows.where(k % 4 == i).write.options(**({"escape": '"'} | style)).csv(f"{home}/style={i}")
    return home


@query("SELECT c_custkey, c_name, round(c_acctbal, 2) AS c_acctbal, 'né ' || c_mktsegment || CASE WHEN c_custkey % 3 = 0 THEN '; it''s, \"so\"' ELSE '' END AS note FROM customer")
def csv_of_many_dialects(spark, sf_dir):
    return D.read_csv(spark, _files(spark, sf_dir), "c_custkey long, c_name string, c_acctbal double, note string", "*.csv", doubtful="preferred")


@query("""
SELECT * FROM (VALUES (0, ',', '"', 'utf-8', 'header'), (1, ';', '"', 'cp1252', 'header'), (2, chr(9), '"', 'utf-16-be', 'undetermined'), (3, '|', '''', 'utf-8', 'header')) AS v(style, delimiter, quote, encoding, header), (SELECT count(*) AS n FROM customer) AS c
""")
def csv_dialects(spark, sf_dir):
    found = D.dialects(spark, _files(spark, sf_dir), "*.csv").where(F.col("records") > (F.col("header") == "header").cast("int"))
    style = F.regexp_extract("path", r"style=(\d)", 1).cast("int")
    each = found.groupBy(style.alias("style"), "delimiter", "quote", "encoding", "header").agg(F.sum(F.col("records") - (F.col("header") == "header").cast("int")).alias("own"))
    return each.select("style", "delimiter", "quote", "encoding", "header", F.lit(table(spark, sf_dir, "customer").count()).alias("n"))


_CYCLES = """
WITH s AS (SELECT o_orderkey AS k, o_totalprice AS price, epoch_ms(o_orderdate) AS at, false AS gone FROM orders
  UNION ALL SELECT o_orderkey, o_totalprice + 1, epoch_ms(TIMESTAMP '2031-01-01') + o_orderkey, false FROM orders WHERE o_orderkey % 7 = 0
  UNION ALL SELECT o_orderkey, o_totalprice, epoch_ms(TIMESTAMP '2032-01-01') + o_orderkey, true FROM orders WHERE o_orderkey % 11 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY "at" DESC) AS place FROM s)
"""


def _cycles(spark, sf_dir):
    """Orders, later changes of some and tombstones of others, loaded as they come to be known."""
    o = table(spark, sf_dir, "orders")
    key, price = F.col("o_orderkey").alias("k"), F.col("o_totalprice")
    ms = lambda day: F.unix_millis(F.lit(day).cast("timestamp")) + F.col("o_orderkey")
    first = o.select(key, price.alias("price"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("at"), F.lit(False).alias("gone"))
    changed = o.where("o_orderkey % 7 = 0").select(key, (price + 1).alias("price"), ms("2031-01-01").alias("at"), F.lit(False).alias("gone"))
    removed = o.where("o_orderkey % 11 = 0").select(key, price.alias("price"), ms("2032-01-01").alias("at"), F.lit(True).alias("gone"))
    target = L.Target(spark, f"{shared_dir(spark)}/loaded-{uuid.uuid4().hex}", "k long, price double, at long, gone boolean", "k", "at", "gone")
    source = first
    for more in (changed, removed, None):
        target.load(source)
        source = source.union(more) if more is not None else source
    return target


@query(f'{_CYCLES} SELECT k, round(price, 2) AS price, "at" FROM r WHERE place = 1 AND NOT gone')
def loaded_orders(spark, sf_dir):
    return _cycles(spark, sf_dir).read().select("k", F.round("price", 2).alias("price"), "at")


@query("""
WITH n AS (SELECT count(*) AS n, count(*) FILTER (o_orderkey % 7 = 0) AS c, count(*) FILTER (o_orderkey % 11 = 0) AS d FROM orders)
SELECT 1 AS number, n AS extracted, n AS inserted, 0 AS updated, 0 AS deleted FROM n UNION ALL SELECT 2, c, 0, c, 0 FROM n UNION ALL SELECT 3, d, 0, 0, d FROM n
""")
def load_log(spark, sf_dir):
    return _cycles(spark, sf_dir).log().select("number", "extracted", "inserted", "updated", "deleted")
