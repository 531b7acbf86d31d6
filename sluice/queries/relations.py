"""Lookups, pages, levels, shares and shapes over the driver tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from sluice.core.session import shared_dir, table
from sluice.operators import accessibility as A
from sluice.operators import relations as R
from sluice.operators import statistics as S
from sluice.queries import query
from sluice.sources import files
from sluice.queries.statistics import _SCORED, _scored, rounded


@query("""
WITH v AS (SELECT c_custkey AS k, d AS valid_from, CASE WHEN c_custkey % 3 = 0 THEN d + INTERVAL 400 DAY ELSE d END AS recorded_at, c_mktsegment || '-' || i AS segment
FROM customer, (VALUES (0, TIMESTAMP '1992-01-01'), (1, TIMESTAMP '1994-06-01'), (2, TIMESTAMP '1996-03-01')) AS w(i, d)),
j AS (SELECT o_orderkey, segment, row_number() OVER (PARTITION BY o_orderkey ORDER BY valid_from DESC NULLS LAST, recorded_at DESC, segment DESC) AS r FROM orders LEFT JOIN v ON k = o_custkey AND valid_from <= o_orderdate AND recorded_at <= o_orderdate + INTERVAL 30 DAY)
SELECT o_orderkey, segment FROM j WHERE r = 1
""")
def bitemporal_segments(spark, sf_dir):
    versions = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", F.posexplode(F.array(*[F.lit(d).cast("timestamp_ntz") for d in ("1992-01-01", "1994-06-01", "1996-03-01")])).alias("i", "valid_from"))
    recorded = F.when(F.col("o_custkey") % 3 == 0, F.col("valid_from") + F.expr("interval 400 days")).otherwise(F.col("valid_from"))
    versions = versions.select("o_custkey", "valid_from", recorded.alias("recorded_at"), F.concat_ws("-", "c_mktsegment", "i").alias("segment"))
    facts = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"))
    return R.bitemporal(facts, versions, "o_custkey", "o_orderdate", F.col("o_orderdate") + F.expr("interval 30 days"), ["segment"]).select("o_orderkey", "segment")


@query("SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS price FROM orders WHERE (o_custkey, o_orderkey) > (40, 100) ORDER BY o_custkey, o_orderkey LIMIT 25")
def keyset_page_orders(spark, sf_dir):
    page = R.keyset_page(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderkey"], (40, 100), 25)
    return page.select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("price"))


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey, o_orderkey LIMIT 25 OFFSET 75")
def offset_page_orders(spark, sf_dir):
    return R.offset_page(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderkey"], 3, 25).select("o_orderkey", "o_custkey")


_WORDS = "(SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents)"


def _words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1))).alias("w"))


@query(f"SELECT 'UTF8_BINARY' AS collation, count(DISTINCT w) AS n FROM {_WORDS} UNION ALL SELECT 'UTF8_LCASE', count(DISTINCT lower(w)) FROM {_WORDS} UNION ALL SELECT 'UNICODE_CI', count(DISTINCT lower(w)) FROM {_WORDS}")
def collation_distinct_words(spark, sf_dir):
    return R.distinct_under(_words(spark, sf_dir), "w", ["UTF8_BINARY", "UTF8_LCASE", "UNICODE_CI"])


@query(f"WITH r AS (SELECT lower(w) AS word, min(w) AS spelt FROM {_WORDS} GROUP BY 1) SELECT word, row_number() OVER (ORDER BY word) AS place FROM (SELECT * FROM r ORDER BY word LIMIT 200)")
def collation_order_words(spark, sf_dir):
    from pyspark.sql import Window

    first = R.once(_words(spark, sf_dir), "w").groupBy(F.lower("w").alias("word")).agg(F.min("w").alias("spelt")).orderBy(F.collate(F.col("spelt"), "UTF8_LCASE")).limit(200)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.collate(F.col("spelt"), "UTF8_LCASE")))  # 200 rows
    return first.select("word", place.alias("place"))


@query("""
WITH m AS (SELECT date_diff('month', TIMESTAMP '1990-01-01', date_trunc('month', o_orderdate)) AS m, count(*)::DOUBLE AS x, sum(o_totalprice) AS y FROM orders GROUP BY 1)
SELECT l.lag::INTEGER AS lag, count(*) AS n, round(corr(a.x, b.y), 6) AS r FROM (SELECT unnest(range(0, 4)) AS lag) AS l JOIN m AS a ON true JOIN m AS b ON b.m = a.m + l.lag GROUP BY 1
""")
def lagged_order_correlation(spark, sf_dir):
    d = F.col("o_orderdate")
    months = table(spark, sf_dir, "orders").groupBy(((F.year(d) - 1990) * 12 + F.month(d)).alias("m")).agg(F.count("*").cast("double").alias("x"), F.sum("o_totalprice").alias("y"))
    return rounded(S.lagged_correlation(months, "m", "x", "y", [0, 1, 2, 3]))


@query("SELECT event_id, round(median(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS baseline FROM events")
def prior_median_events(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.struct("ts", "event_id").alias("at"))
    return S.prior_median(rows, ["user_id", "event_type"], "at", "value").select("event_id", F.round("baseline", 6).alias("baseline"))


@query("""
WITH e AS (SELECT quantile_cont(p_retailprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM part), s AS (SELECT len(list_filter(e, lambda x: x < p_retailprice))::INTEGER AS stratum, p_size FROM part, e)
SELECT stratum, count(*) AS n, round(avg(p_size), 6) AS mean, round(var_samp(p_size), 6) AS variance FROM s GROUP BY 1
""")
def decile_strata_part(spark, sf_dir):
    out = S.strata(table(spark, sf_dir, "part"), "p_retailprice").groupBy("stratum").agg(F.count("*").alias("n"), F.avg("p_size").alias("mean"), F.var_samp("p_size").alias("variance"))
    return rounded(out)


@query("""
WITH q AS (SELECT *, c_nationkey AS nation, floor(c_acctbal / 500) AS band FROM customer), r AS (SELECT nation, c_mktsegment, band, count(*) AS n FROM q WHERE c_custkey % 2 = 0 GROUP BY 1, 2, 3), k AS (SELECT nation, c_mktsegment, band, count(*) AS m FROM q GROUP BY 1, 2, 3)
SELECT CAST(sum(n) AS BIGINT) AS released, count(*) FILTER (n = 1) AS unique_rows, count(*) FILTER (n = 1 AND m = 1) AS matched, round(count(*) FILTER (n = 1 AND m = 1) / sum(n), 6) AS share FROM r LEFT JOIN k USING (nation, c_mktsegment, band)
""")
def linkage_attack_customers(spark, sf_dir):
    people = table(spark, sf_dir, "customer").withColumn("band", F.floor(F.col("c_acctbal") / 500))
    return rounded(R.reidentified(people.where("c_custkey % 2 = 0"), people, ["c_nationkey", "c_mktsegment", "band"], "c_name"))


_GAME = """WITH p AS (SELECT row_number() OVER (ORDER BY o_orderpriority) - 1 AS i, o_orderpriority AS player, max(o_totalprice) AS cost FROM orders GROUP BY o_orderpriority),
v AS (SELECT mask, coalesce(max(cost) FILTER ((mask >> i) & 1 = 1), 0) AS value FROM (SELECT unnest(range(0, 32)) AS mask) AS m, p GROUP BY 1)"""


@query(f"""
{_GAME} SELECT player, round(sum([0.2, 0.05, 1 / 30.0, 0.05, 0.2][bit_count(a.mask::INTEGER) + 1] * (b.value - a.value)), 4) AS share FROM p JOIN v AS a ON (a.mask >> i) & 1 = 0 JOIN v AS b ON b.mask = a.mask | (1 << i) GROUP BY 1
""")
def shapley_priorities(spark, sf_dir):
    values, players = _game(spark, sf_dir)
    return rounded(R.shapley(values, players), 4)


def _game(spark, sf_dir):
    """Every coalition of order priorities costs what its dearest order does."""
    costs = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.max("o_totalprice").alias("cost"))
    players = sorted(r[0] for r in costs.select("o_orderpriority").collect())
    bit = F.element_at(F.create_map(*[x for i, p in enumerate(players) for x in (F.lit(p), F.lit(1 << i))]), F.col("o_orderpriority"))
    masks = spark.range(1 << len(players)).select(F.col("id").cast("int").alias("mask"))
    members = costs.select(bit.alias("bit"), "cost", F.explode(F.sequence(F.lit(0), F.lit((1 << len(players)) - 1))).alias("mask")).where(F.expr("(mask & bit) > 0"))
    return masks.join(members.groupBy("mask").agg(F.max("cost").alias("value")), "mask", "left").select("mask", F.coalesce("value", F.lit(0.0)).alias("value")), players


@query(f"""
{_GAME}, s AS (SELECT player, i, sum([0.2, 0.05, 1 / 30.0, 0.05, 0.2][bit_count(a.mask::INTEGER) + 1] * (b.value - a.value)) AS share FROM p JOIN v AS a ON (a.mask >> i) & 1 = 0 JOIN v AS b ON b.mask = a.mask | (1 << i) GROUP BY 1, 2),
c AS (SELECT mask, value, sum(share) AS paid FROM v JOIN s ON (mask >> i) & 1 = 1 GROUP BY 1, 2)
SELECT count(*) AS coalitions, count(*) FILTER (paid > value + 1e-9) AS blocking, count(*) FILTER (paid > value + 1e-9) = 0 AS in_core FROM c
""")
def core_priorities(spark, sf_dir):
    values, players = _game(spark, sf_dir)
    return R.in_core(values, R.shapley(values, players), players)


@query("SELECT c_custkey AS node, CAST(floor(log2(c_custkey)) AS INTEGER) AS level FROM customer WHERE c_custkey > 0")
def topological_levels(spark, sf_dir):
    k = F.col("c_custkey")
    tasks = table(spark, sf_dir, "customer").where("c_custkey > 1")
    edges = tasks.select(F.floor(k / 2).alias("a"), k.alias("b")).union(tasks.where("c_custkey > 2").select(F.floor(k / 3).alias("a"), k.alias("b")))
    return R.levels(edges, "a", "b")


@query("""
WITH e AS (SELECT event_id, user_id, value, event_id % 3 AS c FROM events)
SELECT '$' AS path, 'object' AS kind, count(*) AS n FROM e UNION ALL SELECT '$.id', 'number', count(*) FROM e UNION ALL SELECT '$.user', 'object', count(*) FROM e WHERE c != 2 UNION ALL SELECT '$.user.name', 'string', count(*) FROM e WHERE c != 2
UNION ALL SELECT '$.user', 'string', count(*) FROM e WHERE c = 2 UNION ALL SELECT '$.tags', 'array', count(*) FROM e WHERE c = 1 UNION ALL SELECT '$.tags[]', 'boolean', 2 * count(*) FROM e WHERE c = 1
""")
def json_path_union(spark, sf_dir):
    user = F.concat(F.lit('{"name": "u'), "user_id", F.lit('"}'))
    c = F.col("event_id") % 3
    text = F.concat(F.lit('{"id": '), "event_id", F.lit(', "user": '), F.when(c == 2, F.lit('"nobody"')).otherwise(user), F.when(c == 1, F.lit(', "tags": [true, false]')).otherwise(F.lit("")), F.lit("}"))
    return R.json_paths(table(spark, sf_dir, "events").select(text.alias("text")), "text")


@query(r"""
WITH p AS (SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>', '', 'g') AS h FROM pages),
r AS (SELECT page_id, unnest(['html-lang', 'page-title', 'viewport', 'img-alt', 'link-name', 'link-vague', 'no-h1', 'multi-h1']) AS rule, unnest([
  (NOT regexp_matches(h, '(?i)<html[^>]*\slang="[^"]+"'))::INT, (NOT regexp_matches(h, '(?i)<title'))::INT, (NOT regexp_matches(h, '(?i)<meta[^>]*name="viewport"'))::INT,
  len(regexp_extract_all(h, '(?i)<img\b')) - len(regexp_extract_all(h, '(?i)<img\b[^>]*\salt=')), len(regexp_extract_all(h, '(?i)<a\b[^>]*>\s*</a>')), len(regexp_extract_all(h, '(?i)<a\b[^>]*>\s*(?:click here|here|read more|more|link|this|learn more)\s*</a>')),
  (NOT regexp_matches(h, '(?i)<h1[\s>]') AND regexp_matches(h, '(?i)<h[2-6][\s>]'))::INT, (len(regexp_extract_all(h, '(?i)<h1[\s>]')) > 1)::INT]) AS n FROM p)
SELECT page_id, rule, n::BIGINT AS n FROM r WHERE n > 0
""")
def page_accessibility(spark, sf_dir):
    found = A.findings(A.elements(table(spark, sf_dir, "pages"), "page_id", "html"))
    return found.groupBy(F.col("page").alias("page_id"), "rule").agg(F.count("*").alias("n"))


@query()
def page_grades(spark, sf_dir):
    return A.grades(A.elements(table(spark, sf_dir, "pages"), "page_id", "html")).select(F.col("page").alias("page_id"), "faults", "score", "grade")


@query(r"SELECT doc_id, CAST(len(text) + len(regexp_extract_all(text, '[\x{1100}-\x{115F}\x{2E80}-\x{303E}\x{3041}-\x{33FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{A000}-\x{A4CF}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{FE30}-\x{FE6F}\x{FF00}-\x{FF60}\x{FFE0}-\x{FFE6}]')) - len(regexp_extract_all(text, '[\x{0300}-\x{036F}\x{200B}-\x{200F}\x{20D0}-\x{20FF}\x{FE00}-\x{FE0F}\x{FE20}-\x{FE2F}]')) AS INTEGER) AS width FROM (SELECT doc_id, text || '日本e' || chr(769) AS text FROM documents)")
def display_widths(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", R.display_width(F.concat("text", F.lit("日本é"))).alias("width"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE left(c_name, 11) || '…' END AS short FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN left(c_name, 8) ELSE c_name END AS c_name FROM customer)")
def width_truncated_names(spark, sf_dir):
    name = F.when(F.col("c_custkey") % 2 == 0, F.left("c_name", F.lit(8))).otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", R.truncate(name, 12).alias("short"))


@query("SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice, o_orderdate::DATE AS o_orderdate, CASE WHEN o_orderkey % 2 = 0 THEN 'said \"x\";' || chr(10) || o_orderpriority END AS note FROM orders")
def csv_round_trip(spark, sf_dir):
    at = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    note = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit('said "x";\n'), "o_orderpriority"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"), F.to_date("o_orderdate").alias("o_orderdate"), note.alias("note"))
    files_written(rows, at)
    return spark.read.schema(rows.schema).options(**CSV).csv(at)


CSV = {"header": "true", "sep": ";", "quote": '"', "escape": '"', "multiLine": "true", "nullValue": "\\N", "mode": "FAILFAST"}


def files_written(rows, at):
    rows.write.options(**{k: v for k, v in CSV.items() if k not in ("multiLine", "mode")}).csv(at)


CODECS = ("gzip", "lz4_raw", "snappy", "uncompressed", "zstd")


@query("SELECT codec, count(*) AS n, round(sum(o_totalprice), 0) AS total, codec <> 'uncompressed' AS smaller FROM orders, (VALUES ('gzip'), ('lz4_raw'), ('snappy'), ('uncompressed'), ('zstd')) AS c(codec) GROUP BY 1")
def codec_compare(spark, sf_dir):
    """Every codec gives the rows back, in fewer bytes than none; ``codec_sizes`` has the bytes."""
    home, orders = f"{shared_dir(spark)}/codecs-{uuid.uuid4().hex}", table(spark, sf_dir, "orders")
    back = [(codec, spark.read.parquet(f"{home}/{codec}")) for codec in files.write_codecs(orders, home, CODECS)]
    parts = [df.agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 0).alias("total")).select(F.lit(codec).alias("codec"), "n", "total") for codec, df in back]
    smaller = files.codec_sizes(spark, home, CODECS).select("codec", (F.col("ratio") < 1).alias("smaller"))
    return reduce(lambda a, b: a.union(b), parts).join(F.broadcast(smaller), "codec")


@query()
def codec_sizes(spark, sf_dir):
    """Bytes that the orders take under each codec, from the listing of their files."""
    home = f"{shared_dir(spark)}/codecs-{uuid.uuid4().hex}"
    return files.codec_sizes(spark, home, files.write_codecs(table(spark, sf_dir, "orders"), home, CODECS)).select("codec", "files", "bytes", F.round("ratio", 4).alias("ratio"))


@query(f"""
WITH g AS (SELECT least(floor(s * 10), 9) AS b, count(*) AS n, avg(s) AS f, avg(y::INT) AS o FROM {_SCORED} GROUP BY 1), t AS (SELECT avg(y::INT) AS base FROM {_SCORED})
SELECT round(sum(n * (f - o) ** 2) / sum(n), 6) AS reliability, round(sum(n * (o - base) ** 2) / sum(n), 6) AS resolution, round(max(base * (1 - base)), 6) AS uncertainty FROM g, t
""")
def murphy_split(spark, sf_dir):
    return rounded(S.murphy(_scored(spark, sf_dir), F.col("y"), F.col("s")))


@query()
def pca_embeddings(spark, sf_dir):
    from sluice.operators import models as M

    return M.principal_components(table(spark, sf_dir, "embeddings"), "embedding", 5)
