"""Ingest and parsing over the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sluice.core.session import table
from sluice.functions import parse as P
from sluice.operators import ingest as I
from sluice.queries import query
from sluice.sources import files
from sluice.sources.fixed_width import Field, parse_records


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS \"props.k\" FROM events")
def json_flatten_events(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long").alias("props"))
    return I.flatten(rows)


@query("SELECT o_custkey AS key, o_orderkey AS \"items.order\", 'x' AS \"items.tags\" FROM orders UNION ALL SELECT o_custkey, o_orderkey, 'y' FROM orders")
def json_explode_orders(spark, sf_dir):
    item = F.struct(F.col("o_orderkey").alias("order"), F.array(F.lit("x"), F.lit("y")).alias("tags"))
    nested = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.collect_list(item).alias("items"))
    return I.flatten(nested)


@query("SELECT event_id, event_id % 5 = 0 AS repeated FROM events")
def json_duplicate_keys(spark, sf_dir):
    text = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit('{"k": 1, "k": '), "event_id", F.lit("}"))).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", I.duplicate_keys(text).alias("repeated"))


@query("SELECT 'Customer Key' AS spoken, c_custkey AS customer_key, c_acctbal AS balance, c_mktsegment AS balance_2 FROM customer")
def csv_clean_customers(spark, sf_dir):
    raw = table(spark, sf_dir, "customer").select(F.lit(" Customer Key ").alias("Spoken"), F.col("c_custkey").alias("Customer-Key"), F.concat(F.lit(" "), F.col("c_acctbal").cast("string")).alias("Balance"), F.concat("c_mktsegment", F.lit("  ")).alias("balance!"), F.lit("N/A").alias("Empty"))
    return I.clean_table(raw.unionAll(raw.where(F.col("`Customer-Key`") % 7 == 0)))


_BOOLS = "(SELECT o_orderkey, ['yes', 'True', '0', 'off', 'TRUE', 'maybe', 't', NULL][1 + o_orderkey % 8] AS t FROM orders)"


@query(
    "SELECT o_orderkey, t, CASE WHEN t IN ('y','Y','yes','Yes','YES','true','True','TRUE','on','On','ON') THEN true "
    "WHEN t IN ('n','N','no','No','NO','false','False','FALSE','off','Off','OFF') THEN false END AS yaml11, "
    "CASE WHEN t IN ('true','True','TRUE') THEN true END AS yaml12, "
    "CASE WHEN t IN ('1','t','T','TRUE','true','True') THEN true WHEN t = '0' THEN false END AS go, "
    f"lower(t) = 'true' AS java FROM {_BOOLS}"
)
def boolean_readers(spark, sf_dir):
    texts = F.array(*[F.lit(t) for t in ("yes", "True", "0", "off", "TRUE", "maybe", "t", None)])
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.get(texts, (F.col("o_orderkey") % 8).cast("int")).alias("t"))
    return rows.select("o_orderkey", "t", *[P.read_boolean(F.col("t"), r).alias(r) for r in ("yaml11", "yaml12", "go", "java")])


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS x, l_orderkey % 3 = 1 AS german, l_orderkey % 3 = 2 AS plain FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN NOT german THEN x END AS en, CASE WHEN german THEN x END AS de, CASE WHEN german THEN 'refused' ELSE 'ok' END AS en_status, CASE WHEN german THEN 'ok' ELSE 'refused' END AS de_status FROM r
""")
def locale_numbers(spark, sf_dir):
    rows, k = table(spark, sf_dir, "lineitem"), F.col("l_orderkey") % 3
    grouped = F.format_number("l_extendedprice", 2)
    text = F.when(k == 1, F.translate(grouped, ",.", ".,")).when(k == 2, F.replace(grouped, F.lit(","), F.lit(""))).otherwise(grouped)
    en, de = P.read_number(text, "en"), P.read_number(text, "de")
    return rows.select("l_orderkey", "l_linenumber", en["value"].cast("double").alias("en"), de["value"].cast("double").alias("de"), en["status"].alias("en_status"), de["status"].alias("de_status"))


@query("SELECT o_orderkey, CAST(o_orderkey % 50 * 3600 + o_custkey % 60 * 60 AS DOUBLE) AS go, CAST(o_custkey % 30 AS BIGINT) AS days, CAST(o_orderkey % 50 * 3600 + o_custkey % 60 * 60 AS BIGINT) AS short FROM orders")
def duration_readers(spark, sf_dir):
    h, m, d = F.col("o_orderkey") % 50, F.col("o_custkey") % 60, F.col("o_custkey") % 30
    return table(spark, sf_dir, "orders").select("o_orderkey", P.go_duration(F.concat(h, F.lit("h"), m, F.lit("m"))).alias("go"), P.iso_duration(F.concat(F.lit("P"), d, F.lit("DT1H")))["days"].alias("days"), P.short_duration(F.concat(h, F.lit("h "), m, F.lit("m"))).alias("short"))


@query("""
WITH e AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN TIMESTAMP '2024-03-30' ELSE TIMESTAMP '2024-10-26' END + INTERVAL 1 MINUTE * (event_id % 3000) AS l, event_id % 101 = 0 AS bad FROM events),
s AS (SELECT *, CASE WHEN bad THEN 'unparsed' WHEN l >= TIMESTAMP '2024-03-31 02:00:00' AND l < TIMESTAMP '2024-03-31 03:00:00' THEN 'nonexistent' WHEN l >= TIMESTAMP '2024-10-27 02:00:00' AND l < TIMESTAMP '2024-10-27 03:00:00' THEN 'ambiguous' ELSE 'ok' END AS status FROM e)
SELECT event_id, status, CASE WHEN status = 'ok' THEN l - CASE WHEN l >= TIMESTAMP '2024-03-31 03:00:00' AND l < TIMESTAMP '2024-10-27 02:00:00' THEN INTERVAL 2 HOUR ELSE INTERVAL 1 HOUR END END AS utc FROM s
""")
def timezone_status(spark, sf_dir):
    """Minutes of the two weekends on which Berlin changes its clocks."""
    k = F.col("event_id")
    local = F.when(k % 2 == 0, F.lit("2024-03-30").cast("timestamp_ntz")).otherwise(F.lit("2024-10-26").cast("timestamp_ntz")) + F.expr("make_dt_interval(0, 0, cast(event_id % 3000 as int), 0)")
    text = F.when(k % 101 == 0, "nonsense").otherwise(F.date_format(local, "yyyy-MM-dd HH:mm:ss"))
    return table(spark, sf_dir, "events").select("event_id", P.local_to_utc(text, F.lit("Europe/Berlin")).alias("r")).select("event_id", "r.status", F.col("r.utc").cast("timestamp_ntz").alias("utc"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'json' WHEN 1 THEN 'generic' WHEN 2 THEN 'access' ELSE 'keyword' END AS format, CASE WHEN event_id % 4 = 0 THEN 'ERROR' WHEN event_id % 4 = 1 THEN 'INFO' WHEN event_id % 4 = 2 THEN 'WARNING' ELSE 'DEBUG' END AS level FROM events")
def log_formats(spark, sf_dir):
    k = F.col("event_id") % 4
    line = (
        F.when(k == 0, F.concat(F.lit('{"level": "error", "msg": "'), "event_type", F.lit('"}'))).when(k == 1, F.concat(F.lit("2024-01-01 00:00:00 [INFO] "), "event_type"))
        .when(k == 2, F.concat(F.lit('10.0.0.1 - - [01/Jan/2024:00:00:00 +0000] "GET /'), "event_type", F.lit('" 404 12'))).otherwise(F.concat(F.lit("some debug text "), F.col("event_id")))
    )
    return table(spark, sf_dir, "events").select("event_id", P.parse_log(line).alias("r")).select("event_id", "r.format", "r.level")


@query("SELECT p_partkey, replace(lower(p_name), ' ', '-') || '-' || lower(p_type) AS slug, 'a_b_' || p_partkey AS file, p_partkey % 2 = 0 AS mail FROM part")
def slugs_and_names(spark, sf_dir):
    k = F.col("p_partkey")
    mail = F.when(k % 2 == 0, F.concat(F.lit("a.b+"), k, F.lit("@mail.example.com"))).otherwise(F.concat(F.lit("a..b"), k, F.lit("@mail")))
    return table(spark, sf_dir, "part").select("p_partkey", P.slugify(F.concat("p_name", F.lit(" & "), "p_type", F.lit("!"))).alias("slug"), P.safe_filename(F.concat(F.lit("a:b?"), k, F.lit(". "))).alias("file"), P.email_ok(mail).alias("mail"))


@query("SELECT o_orderkey, CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) * 20) / 20 AS DECIMAL(28,2)) AS cash, CAST(floor(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,0)) AS yen FROM orders")
def money_rounding(spark, sf_dir):
    price = F.col("o_totalprice").cast("decimal(18,2)")
    return table(spark, sf_dir, "orders").select("o_orderkey", P.round_money(price, 2, "half_up", "0.05").alias("cash"), P.round_money(price, 0, "floor").alias("yen"))


@query("SELECT p_partkey, p_brand AS brand, CAST(p_size AS BIGINT) AS size, CAST(-p_retailprice AS DECIMAL(38,2)) AS price FROM part")
def fixed_width_parts(spark, sf_dir):
    cents = F.lpad((F.col("p_retailprice") * 100 + 0.5).cast("long").cast("string"), 10, "0")
    punched = F.concat(F.substring(cents, 1, 9), F.translate(F.substring(cents, 10, 1), "0123456789", "}JKLMNOPQR"))
    record = F.encode(F.concat(F.rpad("p_brand", 12, " "), F.lpad(F.col("p_size").cast("string"), 6, " "), punched), "UTF-8")
    rows = table(spark, sf_dir, "part").select("p_partkey", record.alias("record"))
    layout = [Field("brand", 0, 12), Field("size", 12, 6, "int"), Field("price", 18, 10, "overpunch", 2)]
    parsed = parse_records(rows.select(F.concat(F.col("record"), F.encode(F.lpad(F.col("p_partkey").cast("string"), 10, " "), "UTF-8")).alias("record")), "record", [*layout, Field("p_partkey", 28, 10, "int")])
    return parsed.select("p_partkey", "brand", "size", "price")


@query("SELECT ';' AS delimiter, 1.0 AS consistent, 3 AS fields, 'ok' AS verdict")
def csv_sniff(spark, sf_dir):
    lines = table(spark, sf_dir, "customer").select(F.concat(F.col("c_custkey"), F.lit(';"a;'), F.col("c_mktsegment"), F.lit('";1,5')).alias("value"))
    varied = lines.withColumn("value", F.when(F.length("value") % 2 == 0, F.concat("value", F.lit(",x"))).otherwise(F.col("value")))
    return files.sniff_delimiter(varied)


@query("""
WITH c AS (SELECT doc_id, (len(text) - len(replace(text, chr(13) || chr(10), ''))) // 2 AS crlf, len(text) - len(replace(text, chr(10), '')) AS lfs, len(text) - len(replace(text, chr(13), '')) AS crs
FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN replace(text, chr(10), chr(13) || chr(10)) WHEN 2 THEN replace(text, chr(10), chr(13)) ELSE text || chr(13) || chr(10) || chr(13) END AS text FROM documents)),
n AS (SELECT doc_id, crlf, lfs - crlf AS lf, crs - crlf AS cr FROM c)
SELECT doc_id, CAST(crlf AS INTEGER) AS crlf, CAST(lf AS INTEGER) AS lf, CAST(cr AS INTEGER) AS cr, CASE WHEN (crlf > 0)::INT + (lf > 0)::INT + (cr > 0)::INT > 1 THEN 'mixed' WHEN crlf > 0 THEN 'crlf' WHEN lf > 0 THEN 'lf' WHEN cr > 0 THEN 'cr' ELSE 'none' END AS style FROM n
""")
def line_end_styles(spark, sf_dir):
    k, text = F.col("doc_id") % 4, F.col("text")
    ends = F.when(k == 0, text).when(k == 1, F.replace(text, F.lit("\n"), F.lit("\r\n"))).when(k == 2, F.replace(text, F.lit("\n"), F.lit("\r"))).otherwise(F.concat(text, F.lit("\r\n\r")))
    return table(spark, sf_dir, "documents").select("doc_id", I.line_ends(ends).alias("r")).select("doc_id", "r.crlf", "r.lf", "r.cr", "r.style")


@query("""
WITH s AS (SELECT min(o_orderdate)::DATE::TIMESTAMP AS a, max(o_orderdate)::DATE::TIMESTAMP + INTERVAL 1 DAY AS z FROM orders)
SELECT 'week-' || strftime(b, '%Y%m%d') AS chunk, b::DATE AS begins, least(b + INTERVAL 7 DAY, z)::DATE AS ends FROM (SELECT z, unnest(generate_series(a, z - INTERVAL 1 DAY, INTERVAL 7 DAY)) AS b FROM s)
""")
def backfill_weeks(spark, sf_dir):
    span = table(spark, sf_dir, "orders").agg(F.min(F.to_date("o_orderdate")).cast("string").alias("a"), F.date_add(F.max(F.to_date("o_orderdate")), 1).cast("string").alias("z")).first()
    return I.backfill_chunks(spark, span["a"], span["z"], "week")


@query("SELECT event_id, least(60.0, 0.5 * 2 ** (event_id % 10)) AS wait FROM events")
def retry_backoff(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", I.bucket_backoff(F.col("event_id") % 10 + 1, 0.5, 60.0).alias("wait"))


@query("SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, count(*) AS n FROM orders WHERE year(o_orderdate) = 1995 AND month(o_orderdate) IN (3, 4) GROUP BY 1, 2")
def partition_pruned(spark, sf_dir):
    from sluice.core.session import shared_dir

    path = f"{shared_dir(spark)}/partitioned-orders-{uuid.uuid4().hex}"
    I.write_partitioned(table(spark, sf_dir, "orders"), path, "o_orderdate")
    return spark.read.parquet(path).where("year = 1995 and month in (3, 4)").groupBy("year", "month").agg(F.count("*").alias("n"))
