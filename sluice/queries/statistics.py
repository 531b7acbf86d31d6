"""Tests and screens over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.core.session import table
from sluice.operators import statistics as S
from sluice.queries import query


def rounded(df, digits=6, **other):
    return df.select([F.round(c, other.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_ARMS = "SELECT count(*) FILTER (l_returnflag = 'A') AS n_a, avg(l_extendedprice) FILTER (l_returnflag = 'A') AS mean_a, var_samp(l_extendedprice) FILTER (l_returnflag = 'A') AS var_a, count(*) FILTER (l_returnflag = 'N') AS n_b, avg(l_extendedprice) FILTER (l_returnflag = 'N') AS mean_b, var_samp(l_extendedprice) FILTER (l_returnflag = 'N') AS var_b FROM lineitem"


@query(f"WITH a AS ({_ARMS}) SELECT n_a, n_b, round(mean_b - mean_a, 4) AS diff, round((mean_b - mean_a) / sqrt(var_a / n_a + var_b / n_b), 5) AS t, round((var_a / n_a + var_b / n_b) ** 2 / ((var_a / n_a) ** 2 / (n_a - 1) + (var_b / n_b) ** 2 / (n_b - 1)), 2) AS df FROM a")
def welch_price_by_flag(spark, sf_dir):
    out = S.welch(S.arms(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", "A", "N"))
    return out.select("n_a", "n_b", F.round("diff", 4).alias("diff"), F.round("t", 5).alias("t"), F.round("df", 2).alias("df"))


@query(f"WITH a AS ({_ARMS}), p AS (SELECT *, sqrt(((n_a - 1) * var_a + (n_b - 1) * var_b) / (n_a + n_b - 2)) AS s FROM a) SELECT round((mean_b - mean_a) / s, 6) AS cohen_d, round((mean_b - mean_a) / s * (1 - 3.0 / (4 * (n_a + n_b - 2) - 1)), 6) AS hedges_g, round((mean_b - mean_a) / sqrt(var_a), 6) AS glass_delta FROM p")
def effect_sizes_price(spark, sf_dir):
    out = S.effect_sizes(S.arms(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", "A", "N"))
    return rounded(out.select("cohen_d", "hedges_g", "glass_delta"))


@query("""
WITH c AS (SELECT count(*) FILTER (o_orderpriority = '1-URGENT') AS n_a, count(*) FILTER (o_orderpriority = '1-URGENT' AND o_orderstatus = 'F') AS x_a, count(*) FILTER (o_orderpriority = '5-LOW') AS n_b, count(*) FILTER (o_orderpriority = '5-LOW' AND o_orderstatus = 'F') AS x_b FROM orders),
p AS (SELECT *, x_a / n_a AS ra, x_b / n_b AS rb, (x_a + x_b) / (n_a + n_b) AS q FROM c)
SELECT n_a, x_a, n_b, x_b, round(rb - ra, 6) AS diff, round((rb - ra) / sqrt(q * (1 - q) * (1 / n_a + 1 / n_b)), 6) AS z, round((rb - ra) / ra, 6) AS lift FROM p
""")
def two_proportion_status(spark, sf_dir):
    out = S.two_proportions(table(spark, sf_dir, "orders"), "o_orderpriority", F.col("o_orderstatus") == "F", "1-URGENT", "5-LOW")
    return rounded(out.select("n_a", "x_a", "n_b", "x_b", "diff", "z", "lift"))


@query("""
WITH j AS (SELECT n_chars::DOUBLE AS s, toxic FROM labels JOIN documents USING (doc_id)), r AS (SELECT toxic, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk FROM j),
a AS (SELECT count(*) FILTER (toxic = 1) AS p, count(*) FILTER (toxic = 0) AS q, sum(rk) FILTER (toxic = 1) AS w FROM r)
SELECT p AS n_pos, q AS n_neg, round(w - p * (p + 1) / 2.0, 2) AS u, round((w - p * (p + 1) / 2.0) / (p * q), 6) AS auc FROM a
""")
def mannwhitney_auc(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    out = S.rank_sum(rows, F.col("toxic") == 1, "n_chars")
    return out.select("n_pos", "n_neg", F.round("u", 2).alias("u"), F.round("auc", 6).alias("auc"))


_CELLS = """WITH c AS (SELECT o_orderstatus AS "row", o_orderpriority AS "column", count(*) AS n FROM orders GROUP BY 1, 2),
e AS (SELECT *, sum(n) OVER (PARTITION BY "row") * sum(n) OVER (PARTITION BY "column") / sum(n) OVER () AS expected FROM c)"""


@query(f'{_CELLS} SELECT "row", "column", n, round(expected, 6) AS expected, round((n - expected) / sqrt(expected), 6) AS residual FROM e')
def crosstab_expected(spark, sf_dir):
    return rounded(S.contingency(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority"))


@query(f'{_CELLS} SELECT round(sum((n - expected) ** 2 / expected), 6) AS chi2, CAST((count(DISTINCT "row") - 1) * (count(DISTINCT "column") - 1) AS BIGINT) AS df, round(sqrt(sum((n - expected) ** 2 / expected) / (sum(n) * (least(count(DISTINCT "row"), count(DISTINCT "column")) - 1))), 6) AS cramers_v FROM e')
def chi2_crosstab(spark, sf_dir):
    return rounded(S.chi_square(S.contingency(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")).drop("p"))


@query("WITH c AS (SELECT o_orderstatus AS g, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT *, sum(n) OVER () / 3.0 AS e FROM c) SELECT CAST(sum(n) AS BIGINT) AS n, round(sum((n - e) ** 2 / e), 6) AS chi2, 2 AS df FROM t")
def srm_split(spark, sf_dir):
    return rounded(S.sample_ratio(table(spark, sf_dir, "orders"), "o_orderstatus", {"O": 1, "F": 1, "P": 1}).drop("p"))


@query("""
WITH g AS (SELECT c_mktsegment, count(*) AS n, avg(c_acctbal) AS m, var_samp(c_acctbal) AS v FROM customer GROUP BY 1), t AS (SELECT *, sum(n * m) OVER () / sum(n) OVER () AS mean FROM g),
s AS (SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS n, sum(n * (m - mean) ** 2) AS b, sum((n - 1) * v) AS w FROM t)
SELECT groups, n, round(b / (groups - 1) / (w / (n - groups)), 6) AS f, round(b / (b + w), 8) AS eta2 FROM s
""")
def anova_balance(spark, sf_dir):
    return rounded(S.anova(table(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal").drop("p"), eta2=8)


@query(" UNION ALL ".join(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", round(corr({a}, {b}), 6) AS r FROM lineitem" for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount"))))
def corr_matrix(spark, sf_dir):
    return rounded(S.correlations(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]))


@query("""
WITH u AS (SELECT user_id, user_id % 2 AS arm, coalesce(sum(value) FILTER (ts < TIMESTAMP '2024-01-15'), 0) AS pre, coalesce(sum(value) FILTER (ts >= TIMESTAMP '2024-01-15'), 0) AS post FROM events GROUP BY 1),
s AS (SELECT covar_samp(post, pre) / var_samp(pre) AS theta, corr(post, pre) AS r, avg(post) FILTER (arm = 1) - avg(post) FILTER (arm = 0) AS diff, avg(pre) FILTER (arm = 1) - avg(pre) FILTER (arm = 0) AS dx FROM u)
SELECT round(theta, 5) AS theta, round(diff, 4) AS diff, round(diff - theta * dx, 4) AS adjusted, round(1 - r ** 2, 5) AS variance_ratio FROM s
""")
def cuped_events(spark, sf_dir):
    half = F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.coalesce(F.sum(F.when(half, F.col("value"))), F.lit(0.0)).alias("pre"), F.coalesce(F.sum(F.when(~half, F.col("value"))), F.lit(0.0)).alias("post")).withColumn("arm", F.col("user_id") % 2)
    out = S.cuped(users, "arm", "post", "pre", 0, 1)
    return rounded(out, 4, theta=5, variance_ratio=5)


@query("""
WITH s AS (SELECT avg(value) FILTER (user_id % 2 = 0 AND ts < TIMESTAMP '2024-01-15') AS a, avg(value) FILTER (user_id % 2 = 0 AND ts >= TIMESTAMP '2024-01-15') AS b, avg(value) FILTER (user_id % 2 = 1 AND ts < TIMESTAMP '2024-01-15') AS c, avg(value) FILTER (user_id % 2 = 1 AND ts >= TIMESTAMP '2024-01-15') AS d FROM events)
SELECT round(a, 6) AS pre_control, round(b, 6) AS post_control, round(c, 6) AS pre_treated, round(d, 6) AS post_treated, round(d - c - b + a, 6) AS effect FROM s
""")
def did_events(spark, sf_dir):
    out = S.diff_in_diff(table(spark, sf_dir, "events"), F.col("user_id") % 2 == 1, F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz"), "value")
    return rounded(out.drop("se", "t"))


@query("""
WITH q AS (SELECT list_distinct(quantile_cont(l_quantity, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01'),
r AS (SELECT len(list_filter(e, lambda x: x < l_quantity)) AS b, count(*) AS n FROM lineitem, q WHERE l_shipdate < TIMESTAMP '1996-01-01' GROUP BY 1), c AS (SELECT len(list_filter(e, lambda x: x < l_quantity)) AS b, count(*) AS n FROM lineitem, q WHERE l_shipdate >= TIMESTAMP '1996-01-01' GROUP BY 1),
j AS (SELECT coalesce(r.n / (SELECT sum(n) FROM r), 0) + 1e-6 AS p, coalesce(c.n / (SELECT sum(n) FROM c), 0) + 1e-6 AS q FROM r FULL JOIN c USING (b))
SELECT round(sum((q - p) * ln(q / p)), 6) AS psi, CASE WHEN sum((q - p) * ln(q / p)) >= 0.25 THEN 'significant' WHEN sum((q - p) * ln(q / p)) >= 0.1 THEN 'moderate' ELSE 'stable' END AS severity FROM j
""")
def psi_quantity(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    early = F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp_ntz")
    return rounded(S.psi(rows.where(early), rows.where(~early), "l_quantity"))


@query("""
WITH g AS (SELECT CAST(floor(l_quantity / 10) AS INTEGER) AS bin, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS events FROM lineitem GROUP BY 1),
w AS (SELECT *, (n - events + 0.5) / (sum(n - events) OVER () + 0.5 * count(*) OVER ()) AS good, (events + 0.5) / (sum(events) OVER () + 0.5 * count(*) OVER ()) AS bad FROM g)
SELECT bin, n, events, round(ln(good / bad), 6) AS woe, round((good - bad) * ln(good / bad), 8) AS iv FROM w
""")
def woe_quantity(spark, sf_dir):
    out = S.weight_of_evidence(table(spark, sf_dir, "lineitem"), F.floor(F.col("l_quantity") / 10).cast("int"), F.col("l_returnflag") == "R")
    return rounded(out, iv=8)


_SCORED = "(SELECT toxic = 1 AS y, least(1.0, n_chars / 5000.0) AS s FROM labels JOIN documents USING (doc_id))"


def _scored(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return rows.select((F.col("toxic") == 1).alias("y"), F.least(F.lit(1.0), F.col("n_chars") / 5000.0).alias("s"))


@query(
    " UNION ALL ".join(
        f"SELECT CAST({t} AS DOUBLE) AS threshold, tp, fp, fn, tn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM (SELECT count(*) FILTER (y AND s >= {t}) AS tp, count(*) FILTER (NOT y AND s >= {t}) AS fp, count(*) FILTER (y AND s < {t}) AS fn, count(*) FILTER (NOT y AND s < {t}) AS tn FROM {_SCORED})"
        for t in (0.1, 0.3, 0.5, 0.7, 0.9)
    )
)
def threshold_grid(spark, sf_dir):
    return rounded(S.thresholds(_scored(spark, sf_dir), F.col("y"), "s", [0.1, 0.3, 0.5, 0.7, 0.9]))


@query(f"SELECT CAST(least(floor(s * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(s), 6) AS mean_score, round(avg(y::INT), 6) AS rate, round(abs(avg(s) - avg(y::INT)), 6) AS gap FROM {_SCORED} GROUP BY 1")
def calibration_bins(spark, sf_dir):
    return rounded(S.calibration(_scored(spark, sf_dir), F.col("y"), F.col("s")))


@query(f"""
WITH g AS (SELECT least(floor(s * 10), 9) AS b, sum(s) AS ss, sum(y::INT) AS yy FROM {_SCORED} GROUP BY 1)
SELECT round((SELECT avg((s - y::INT) ** 2) FROM {_SCORED}), 6) AS brier, round(sum(abs(ss - yy)) / (SELECT count(*) FROM {_SCORED}), 6) AS ece FROM g
""")
def brier_score(spark, sf_dir):
    return rounded(S.brier(_scored(spark, sf_dir), F.col("y"), F.col("s")).drop("log_loss"))


@query("""
WITH p AS (SELECT p_partkey, ((p_partkey * 37) % 101 + 1) / 102.0 AS p FROM part), r AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, p_partkey) AS raw FROM p)
SELECT p_partkey, round(p, 8) AS p, round(least(1.0, min(raw) OVER (ORDER BY p, p_partkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 8) AS p_adjusted FROM r
""")
def bh_adjust(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", (((F.col("p_partkey") * 37) % 101 + 1) / 102.0).alias("p"))
    return rounded(S.benjamini_hochberg(rows, "p"), 8)


@query("""
WITH t AS (SELECT * FROM part WHERE p_partkey % 4 != 0), e AS (SELECT * FROM part WHERE p_partkey % 4 = 0)
SELECT 'target_correlation' AS "check", 'p_size' AS feature, round(abs(corr(p_size, p_retailprice)), 6) AS value, abs(corr(p_size, p_retailprice)) >= 0.95 AS flagged FROM t
UNION ALL SELECT 'duplicate_rows', NULL, round((SELECT count(*) FROM e WHERE p_size IN (SELECT p_size FROM t)) / (SELECT count(*) FROM e), 6), (SELECT count(*) FROM e WHERE p_size IN (SELECT p_size FROM t)) / (SELECT count(*) FROM e) >= 0.01
UNION ALL SELECT 'target_shift', NULL, round(abs((SELECT avg(p_retailprice) FROM t) - (SELECT avg(p_retailprice) FROM e)), 6), abs((SELECT avg(p_retailprice) FROM t) - (SELECT avg(p_retailprice) FROM e)) >= 0.1
""")
def leakage_screens(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    return rounded(S.leakage(parts.where("p_partkey % 4 <> 0"), parts.where("p_partkey % 4 = 0"), ["p_size"], "p_retailprice"))


@query("""
WITH c AS (SELECT lang AS cell, count(*) AS n FROM documents GROUP BY 1), t AS (SELECT *, sum(n) OVER () AS total FROM c), s AS (SELECT *, n / total AS share, 0.25 AS target FROM t)
SELECT cell, n, round(share, 6) AS share, CAST(target AS DOUBLE) AS target, round(share / target, 6) AS ratio, round(target / share, 6) AS weight FROM s
""")
def representation_langs(spark, sf_dir):
    out = S.representation(table(spark, sf_dir, "documents"), "lang", {"de": 0.25, "en": 0.25, "es": 0.25, "fr": 0.25})
    return rounded(out.drop("low", "high"))
