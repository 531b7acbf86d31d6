"""Data quality over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.core.session import table
from sluice.operators import quality as Q
from sluice.queries import query

RULES = [
    {"name": "price present", "type": "not_null", "column": "l_extendedprice"},
    {"name": "quantity range", "type": "in_range", "column": "l_quantity", "min": 1, "max": 49},
    {"name": "flags", "type": "allowed_values", "column": "l_returnflag", "values": ["A", "N"], "severity": "warn"},
    {"name": "status letter", "type": "regex_match", "column": "l_linestatus", "pattern": "[OF]$"},
    {"name": "discount sane", "type": "expression", "expr": "l_discount < 0.1 or l_tax < 0.05"},
    {"name": "order unique", "type": "unique", "column": "l_orderkey"},
    {"name": "order known", "type": "foreign_key", "column": "l_orderkey", "reference": "orders", "reference_column": "o_orderkey"},
    {"name": "enough rows", "type": "row_count", "min": 1},
    {"name": "ghost", "type": "not_null", "column": "l_ghost"},
]
_ROW = "SELECT '{}' AS rule, '{}' AS type, '{}' AS severity, {} AS n_checked, {} AS n_violations, {} = 0 AS passed FROM lineitem"


def _row(name, kind, severity, checked, bad):
    return _ROW.format(name, kind, severity, checked, bad, bad)


@query(
    " UNION ALL ".join(
        [
            _row("price present", "not_null", "error", "count(*)", "count(*) FILTER (l_extendedprice IS NULL)"),
            _row("quantity range", "in_range", "error", "count(l_quantity)", "count(*) FILTER (l_quantity < 1 OR l_quantity > 49)"),
            _row("flags", "allowed_values", "warn", "count(l_returnflag)", "count(*) FILTER (l_returnflag NOT IN ('A', 'N'))"),
            _row("status letter", "regex_match", "error", "count(l_linestatus)", "count(*) FILTER (l_linestatus NOT IN ('O', 'F'))"),
            _row("discount sane", "expression", "error", "count(*)", "count(*) FILTER (NOT (l_discount < 0.1 OR l_tax < 0.05))"),
            "SELECT 'order unique', 'unique', 'error', CAST(sum(n) AS BIGINT), CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT), coalesce(sum(n) FILTER (n > 1), 0) = 0 FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)",
            "SELECT 'order known', 'foreign_key', 'error', count(*), count(*) FILTER (o_orderkey IS NULL), count(*) FILTER (o_orderkey IS NULL) = 0 FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey",
            "SELECT 'enough rows', 'row_count', 'error', count(*), CAST(count(*) < 1 AS BIGINT), count(*) >= 1 FROM lineitem",
            "SELECT 'ghost', 'not_null', 'error', CAST(0 AS BIGINT), CAST(0 AS BIGINT), false",
        ]
    )
)
def dq_rules_lineitem(spark, sf_dir):
    return Q.run_rules(table(spark, sf_dir, "lineitem"), RULES, {"orders": table(spark, sf_dir, "orders")})


@query("SELECT 'FAIL' AS verdict, CAST(2 AS BIGINT) AS rules, CAST(1 AS BIGINT) AS passed_rules")
def dq_rollup(spark, sf_dir):
    rules = [{"name": "key", "type": "not_null", "column": "o_orderkey"}, {"name": "gone", "type": "unique", "column": "nothing"}]
    return Q.rollup(Q.run_rules(table(spark, sf_dir, "orders"), rules))


def _profile_sql(table_name, columns, numeric):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) FILTER ({c} IS NULL) AS nulls, count(DISTINCT {c}) AS distinct_values, CAST(min({c}) AS VARCHAR) AS low, CAST(max({c}) AS VARCHAR) AS high, {f'round(avg({c}), 6)' if c in numeric else 'CAST(NULL AS DOUBLE)'} AS mean FROM {table_name}"
        for c in columns
    )


@query(_profile_sql("part", ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"], {"p_partkey", "p_size", "p_retailprice"}))
def profile_part(spark, sf_dir):
    return Q.profile(table(spark, sf_dir, "part")).withColumn("mean", F.round("mean", 6))


@query("""
WITH p AS (SELECT 'event_id' AS c, count(DISTINCT event_id) AS d, count(event_id) AS n FROM events UNION ALL SELECT 'user_id', count(DISTINCT user_id), count(user_id) FROM events UNION ALL SELECT 'event_type', count(DISTINCT event_type), count(event_type) FROM events)
SELECT c AS "column", 'not_null' AS test FROM p UNION ALL SELECT c, 'unique' FROM p WHERE d >= 0.99 * n UNION ALL SELECT c, 'accepted_values' FROM p WHERE c = 'event_type' AND d BETWEEN 2 AND 12 UNION ALL SELECT c, 'relationships' FROM p WHERE c LIKE '%\\_id' ESCAPE '\\'
""")
def infer_tests_events(spark, sf_dir):
    return Q.infer_tests(Q.profile(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")))


@query("""
WITH v AS (SELECT event_id AS key, value FROM events WHERE value IS NOT NULL), s AS (SELECT avg(value) AS mean, stddev_pop(value) AS sd, quantile_cont(value, 0.25) AS q1, median(value) AS q2, quantile_cont(value, 0.75) AS q3, count(*) AS n FROM v),
m AS (SELECT median(abs(value - q2)) AS mad FROM v, s),
f AS (SELECT key, value, (value - mean) / sd AS z, 0.6745 * (value - q2) / mad AS mz, value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS iqr FROM v, s, m),
g AS (SELECT *, CAST(abs(z) > 3 AS INTEGER) + CAST(iqr AS INTEGER) + CAST(abs(mz) > 3.5 AS INTEGER) AS methods, CASE WHEN abs(z) >= 5 THEN 'high' WHEN abs(z) >= 4 THEN 'medium' ELSE 'low' END AS base FROM f)
SELECT key, value, round(z, 6) AS zscore, round(mz, 6) AS modified_z, methods, CASE WHEN methods >= 2 AND base != 'low' THEN 'high' ELSE base END AS severity FROM g WHERE methods > 0
""")
def anomaly_iqr(spark, sf_dir):
    out = Q.numeric_anomalies(table(spark, sf_dir, "events"), "event_id", "value")
    return out.withColumn("zscore", F.round("zscore", 6)).withColumn("modified_z", F.round("modified_z", 6))


@query("""
WITH c AS (SELECT doc_kind AS value, count(*) AS n FROM (SELECT CASE WHEN n_chars > 20000 THEN 'huge' WHEN n_chars < 12 THEN 'tiny' ELSE lang END AS doc_kind FROM documents) GROUP BY 1), t AS (SELECT *, sum(n) OVER () AS rows, count(*) OVER () AS kinds FROM c)
SELECT value, n, round(n / rows, 8) AS share, CASE WHEN n = 1 THEN 'high' WHEN n / rows < 0.005 THEN 'medium' ELSE 'low' END AS severity FROM t WHERE rows >= 20 AND kinds <= 0.5 * rows AND n <= greatest(1, floor(0.01 * rows))
""")
def rare_document_kinds(spark, sf_dir):
    kind = F.when(F.col("n_chars") > 20000, "huge").when(F.col("n_chars") < 12, "tiny").otherwise(F.col("lang"))
    return Q.rare_categories(table(spark, sf_dir, "documents").select(kind.alias("kind")), "kind").withColumn("share", F.round("share", 8))


def _holes(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("customer"), F.when(F.col("o_orderkey") % 6 != 0, F.col("o_totalprice")).alias("price"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("priority"))


_HOLES = "(SELECT o_orderkey, CASE WHEN o_orderkey % 3 != 0 THEN o_custkey END AS customer, CASE WHEN o_orderkey % 6 != 0 THEN o_totalprice END AS price, CASE WHEN o_orderstatus != 'P' THEN o_orderpriority END AS priority FROM orders)"


@query(f"SELECT concat_ws(', ', CASE WHEN customer IS NULL THEN 'customer' END, CASE WHEN price IS NULL THEN 'price' END, CASE WHEN priority IS NULL THEN 'priority' END) AS pattern, count(*) AS n FROM {_HOLES} GROUP BY 1")
def null_patterns(spark, sf_dir):
    return Q.null_patterns(_holes(spark, sf_dir), ["customer", "price", "priority"])


@query(" UNION ALL ".join(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", round(count(*) FILTER ({a} IS NULL AND {b} IS NULL) / count(*) FILTER ({a} IS NULL OR {b} IS NULL), 8) AS jaccard FROM {_HOLES}" for a, b in (("customer", "price"), ("customer", "priority"), ("price", "priority"))))
def null_overlap(spark, sf_dir):
    return Q.null_overlap(_holes(spark, sf_dir), ["customer", "price", "priority"]).withColumn("jaccard", F.round("jaccard", 8))


@query("""
WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events),
s AS (SELECT round(100.0 * (count(event_id) + count(ts) + count(user_id) + count(event_type) + count(value) + count(props)) / (count(*) * 6), 1) AS completeness, round(100.0 * count(DISTINCT event_id) / count(*), 1) AS uniqueness,
round(greatest(0.0, 100 - 100.0 * count(*) FILTER (ts > TIMESTAMP '2024-01-20') / count(*) - 50.0 * count(*) FILTER (ts < TIMESTAMP '2024-01-10') / count(*)), 1) AS timeliness,
round(greatest(0.0, 100 - 400.0 * count(*) FILTER (value < a - 3 * (b - a) OR value > b + 3 * (b - a)) / count(*)), 1) AS distribution FROM events, q)
SELECT 'completeness' AS dimension, completeness AS score FROM s UNION ALL SELECT 'uniqueness', uniqueness FROM s UNION ALL SELECT 'timeliness', timeliness FROM s UNION ALL SELECT 'distribution', distribution FROM s
""")
def scorecard_events(spark, sf_dir):
    return Q.scorecard(table(spark, sf_dir, "events"), "event_id", "value", "ts", "2024-01-20", 10)


def _snapshots(spark, sf_dir):
    before = table(spark, sf_dir, "customer").where("c_custkey % 50 <> 1").select("c_custkey", "c_acctbal", "c_mktsegment")
    after = table(spark, sf_dir, "customer").where("c_custkey % 50 <> 2").select("c_custkey", F.when(F.col("c_custkey") % 7 == 0, F.lit(0.0)).otherwise(F.col("c_acctbal")).alias("c_acctbal"), F.when(F.col("c_custkey") % 11 == 0, F.lit("NEW")).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    return before, after


@query("""
WITH b AS (SELECT c_custkey AS key, c_acctbal AS x, c_mktsegment AS y FROM customer WHERE c_custkey % 50 != 1),
a AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 7 = 0 THEN 0.0 ELSE c_acctbal END AS x, CASE WHEN c_custkey % 11 = 0 THEN 'NEW' ELSE c_mktsegment END AS y FROM customer WHERE c_custkey % 50 != 2)
SELECT 'added' AS change, key, CAST(NULL AS VARCHAR) AS "column", CAST(NULL AS VARCHAR) AS before, CAST(NULL AS VARCHAR) AS after FROM a WHERE key NOT IN (SELECT key FROM b)
UNION ALL SELECT 'removed', key, NULL, NULL, NULL FROM b WHERE key NOT IN (SELECT key FROM a)
UNION ALL SELECT 'modified', a.key, 'c_acctbal', CAST(b.x AS VARCHAR), CAST(a.x AS VARCHAR) FROM a JOIN b USING (key) WHERE a.x != b.x
UNION ALL SELECT 'modified', a.key, 'c_mktsegment', b.y, a.y FROM a JOIN b USING (key) WHERE a.y != b.y
""")
def diff_customers(spark, sf_dir):
    return Q.snapshot_diff(*_snapshots(spark, sf_dir), "c_custkey")


@query("""
WITH s AS (SELECT o_orderkey AS key, o_totalprice AS p, o_orderstatus AS t FROM orders), g AS (SELECT o_orderkey AS key, CASE WHEN o_orderkey % 40 = 3 THEN o_totalprice + 5 ELSE o_totalprice END AS p, o_orderstatus AS t FROM orders WHERE o_orderkey % 100 != 7)
SELECT (SELECT count(*) FROM s) AS source_rows, (SELECT count(*) FROM g) AS target_rows, (SELECT count(*) FROM s WHERE key NOT IN (SELECT key FROM g)) AS missing, CAST(0 AS BIGINT) AS extra,
(SELECT count(*) FROM s JOIN g USING (key) WHERE abs(s.p - g.p) > 0.01) AS mismatched_cells, round((SELECT count(*) FROM s JOIN g USING (key) WHERE abs(s.p - g.p) <= 0.01) / (SELECT count(*) FROM s), 4) AS match_rate, false AS sums_agree
""")
def reconcile_sum(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    target = orders.where("o_orderkey % 100 <> 7").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 40 == 3, F.col("o_totalprice") + 5).otherwise(F.col("o_totalprice")))
    return Q.reconcile(orders, target, "o_orderkey", "o_orderkey", ["o_totalprice", "o_orderstatus"])


@query("""
WITH h AS (SELECT CAST(('0x' || substr(md5(concat('integer:', length(n_nationkey::VARCHAR), ':', n_nationkey, ';string:', length(n_name), ':', n_name, ';integer:', length(n_regionkey::VARCHAR), ':', n_regionkey, ';')), 1, 15)) AS BIGINT) AS h FROM nation)
SELECT count(*) AS rows, bit_xor(h) AS xor_hash, CAST(sum(h) % 1152921504606846976 AS BIGINT) AS sum_hash FROM h
""")
def table_fingerprint(spark, sf_dir):
    return Q.fingerprint(table(spark, sf_dir, "nation"))


@query("""
WITH d AS (SELECT c_custkey AS k FROM customer UNION ALL SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0), c AS (SELECT k, count(*) AS n FROM d GROUP BY 1), j AS (SELECT o_totalprice AS m, coalesce(n, 1) AS n FROM orders LEFT JOIN c ON o_custkey = k)
SELECT count(*) AS rows_before, CAST(sum(n) AS BIGINT) AS rows_after, round(sum(m), 2) AS measure_before, round(sum(m * n), 2) AS measure_after, max(n) <= 1 AS referenced_key_unique, false AS declared_unique, count(*) = sum(n) AS pk_preserved FROM j
""")
def fanout_checks(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    out = Q.fanout_audit(table(spark, sf_dir, "orders"), customers.unionByName(customers.where("c_custkey % 10 = 0")), "o_custkey", "c_custkey", "o_totalprice")
    return out.withColumn("measure_before", F.round("measure_before", 2)).withColumn("measure_after", F.round("measure_after", 2))


@query("""
SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 10 != 0 UNION ALL SELECT o_orderkey, o_totalprice + 1 FROM orders WHERE o_orderkey % 10 = 5 OR (o_orderkey % 10 = 0 AND o_orderkey % 20 != 0)
""")
def upsert_orders(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    increment = orders.where("o_orderkey % 5 = 0").select("o_orderkey", (F.col("o_totalprice") + 1).alias("o_totalprice"), (F.col("o_orderkey") % 20 == 0).alias("deleted"))
    return Q.upsert(orders.where("o_orderkey % 2 = 0"), increment, "o_orderkey")


@query("SELECT event_type, count(*) AS n, max(ts) AS watermark FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1")
def incremental_events(spark, sf_dir):
    rows = Q.since_watermark(table(spark, sf_dir, "events"), "ts", "2024-01-15 00:00:00")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.max("ts").alias("watermark"))


@query("""
WITH r AS (SELECT o_custkey AS key, o_orderdate AS updated, CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS p, o_orderstatus AS s FROM orders)
SELECT key, arg_max(p, (updated, p)) AS latest, arg_max(s, (-CASE WHEN s = 'F' THEN 0 WHEN s = 'O' THEN 1 ELSE 2 END, updated, s)) AS trusted, arg_max(id, (length(id), updated, id)) AS longest_id, count(*) AS merged FROM r GROUP BY 1
""")
def survivorship(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", F.col("o_orderpriority").alias("latest"), F.col("o_orderstatus").alias("trusted"), F.col("o_orderkey").cast("string").alias("longest_id"))
    rank = F.when(F.col("trusted") == "F", 0).when(F.col("trusted") == "O", 1).otherwise(2)
    return Q.survivors(rows, "o_custkey", {"latest": "most_recent", "trusted": "source_priority", "longest_id": "longest"}, "o_orderdate", rank)


@query("SELECT 'key' AS \"column\", CASE WHEN (SELECT max(c_custkey) FROM customer) <= 32767 THEN 'SMALLINT' ELSE 'INTEGER' END AS inferred UNION ALL SELECT 'padded', 'VARCHAR(9)' UNION ALL SELECT 'flag', 'BOOLEAN' UNION ALL SELECT 'day', 'DATE' UNION ALL SELECT 'price', 'NUMERIC(6,2)' UNION ALL SELECT 'big', 'BIGINT'")
def infer_text_types(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.cast("string").alias("key"), F.lpad(k.cast("string"), 9, "0").alias("padded"), F.when(k % 2 == 0, "Yes").otherwise("no").alias("flag"), F.date_add(F.lit("2024-01-01").cast("date"), (k % 300).cast("int")).cast("string").alias("day"), F.concat(((k % 900) + 100).cast("string"), F.lit(".25")).alias("price"), F.lit("9000000000").alias("big"))
    return Q.type_ladder(rows, ["key", "padded", "flag", "day", "price", "big"])


CONTRACT = {"o_orderkey": {"type": "number", "unique": True, "nullable": False}, "o_totalprice": {"type": "number", "min": 5000}, "o_orderstatus": {"type": "text", "allowed": ["O", "F"]}, "o_orderdate": {"type": "text", "unique": True}, "o_clerk": {"type": "text"}}


@query("""
SELECT 'o_custkey' AS "column", 'undeclared' AS "check", 'warning' AS severity, CAST(1 AS BIGINT) AS n UNION ALL SELECT 'o_orderpriority', 'undeclared', 'warning', 1 UNION ALL SELECT 'o_orderdate', 'type', 'error', 1 UNION ALL SELECT 'o_clerk', 'missing', 'error', 1
UNION ALL SELECT * FROM (SELECT 'o_totalprice', 'min', 'error', count(*) AS n FROM orders WHERE o_totalprice < 5000) WHERE n > 0 UNION ALL SELECT * FROM (SELECT 'o_orderstatus', 'allowed', 'error', count(*) AS n FROM orders WHERE o_orderstatus NOT IN ('O', 'F')) WHERE n > 0
""")
def contract_orders(spark, sf_dir):
    return Q.contract_check(table(spark, sf_dir, "orders"), CONTRACT)
