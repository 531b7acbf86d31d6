"""Tests, effects and screens from one pass of sufficient statistics or ranks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from heapq import heappop, heappush, heappushpop
from math import ceil, floor

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from sluice.core.session import cut
from sluice.functions.stats import chi2_upper, f_upper, normal_two_sided, t_two_sided, wilson


def arms(df: DataFrame, group: str, value: str, a, b, keys: list[str] | None = None) -> DataFrame:
    """``n_a, mean_a, var_a, n_b, mean_b, var_b`` of two groups, in one pass (by ``keys``)."""
    sums = []
    for name, level in (("a", a), ("b", b)):
        v = F.when(F.col(group) == level, F.col(value).cast("double"))
        sums += [F.count(v).alias(f"n_{name}"), F.avg(v).alias(f"mean_{name}"), F.var_samp(v).alias(f"var_{name}")]
    return df.where(F.col(group).isin(a, b)).groupBy(*(keys or [])).agg(*sums)


def welch(stats: DataFrame) -> DataFrame:
    """Adds ``diff, t, df, p`` of Welch's test to the arms' statistics."""
    sa, sb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    out = stats.withColumn("diff", F.col("mean_b") - F.col("mean_a")).withColumn("t", F.col("diff") / F.sqrt(sa + sb))
    out = out.withColumn("df", (sa + sb) ** 2 / (sa**2 / (F.col("n_a") - 1) + sb**2 / (F.col("n_b") - 1)))
    return out.withColumn("p", t_two_sided(F.col("t"), F.col("df")))


def student(stats: DataFrame) -> DataFrame:
    """Adds ``diff, t, df, p`` of the pooled test."""
    n = F.col("n_a") + F.col("n_b") - 2
    pooled = ((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b")) / n
    out = stats.withColumn("diff", F.col("mean_b") - F.col("mean_a")).withColumn("df", n.cast("double"))
    out = out.withColumn("t", F.col("diff") / F.sqrt(pooled * (1 / F.col("n_a") + 1 / F.col("n_b"))))
    return out.withColumn("p", t_two_sided(F.col("t"), F.col("df")))


def effect_sizes(stats: DataFrame) -> DataFrame:
    """Adds Cohen's d, Hedges' g and Glass's delta."""
    n = F.col("n_a") + F.col("n_b") - 2
    pooled = F.sqrt(((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b")) / n)
    d = (F.col("mean_b") - F.col("mean_a")) / pooled
    return stats.withColumn("cohen_d", d).withColumn("hedges_g", d * (1 - 3 / (4 * n - 1))).withColumn("glass_delta", (F.col("mean_b") - F.col("mean_a")) / F.sqrt("var_a"))


def two_proportions(df: DataFrame, group: str, success: Column, a, b) -> DataFrame:
    """``n_a, x_a, n_b, x_b, rate_a, rate_b, diff, z, p, lift`` of the pooled z test and Wilson bounds."""
    sums = []
    for name, level in (("a", a), ("b", b)):
        here = F.col(group) == level
        sums += [F.count_if(here).alias(f"n_{name}"), F.count_if(here & success).alias(f"x_{name}")]
    out = df.agg(*sums).withColumn("rate_a", F.col("x_a") / F.col("n_a")).withColumn("rate_b", F.col("x_b") / F.col("n_b"))
    pool = (F.col("x_a") + F.col("x_b")) / (F.col("n_a") + F.col("n_b"))
    out = out.withColumn("diff", F.col("rate_b") - F.col("rate_a")).withColumn("z", F.col("diff") / F.sqrt(pool * (1 - pool) * (1 / F.col("n_a") + 1 / F.col("n_b"))))
    low, high = wilson(F.col("x_b"), F.col("n_b"))
    return out.withColumn("p", normal_two_sided(F.col("z"))).withColumn("lift", F.col("diff") / F.col("rate_a")).withColumn("low_b", low).withColumn("high_b", high)


def rank_sum(df: DataFrame, positive: Column, score: str) -> DataFrame:
    """``n_pos, n_neg, u, auc, z, p``: Mann-Whitney with average ranks for ties.

    Equal scores are counted together before anything is ordered, so the running sum goes over
    distinct scores. The order is a range partition of its own: cumulative counts come from bucket
    totals and a window within each bucket, and no task holds all scores.
    """
    counts = df.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    ranked = running(counts, "s", {"below": "neg"})
    half = ranked.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(F.col("pos") * (F.col("below") - F.col("neg") / 2.0)).alias("u"), F.sum((F.col("pos") + F.col("neg")).cast("double") ** 3 - (F.col("pos") + F.col("neg"))).alias("ties"))
    n = F.col("n_pos") + F.col("n_neg")
    sd = F.sqrt(F.col("n_pos") * F.col("n_neg") / 12.0 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    out = half.withColumn("auc", F.col("u") / (F.col("n_pos") * F.col("n_neg"))).withColumn("z", (F.col("u") - F.col("n_pos") * F.col("n_neg") / 2.0) / sd)
    return out.withColumn("p", normal_two_sided(F.col("z"))).drop("ties")


def running(df: DataFrame, order: str, sums: dict[str, str], descending: bool = False, buckets: int = 64) -> DataFrame:
    """Inclusive running sums over the whole order of a column, without one task for all rows.

    Rows are dealt into value ranges of about equal rows, each range is summed within itself, and
    the few ranges' totals are summed before being added back. There are ``buckets`` ranges, and 4 or
    16 times as many beyond 10^8 or 10^9 rows.
    """
    fine = 16 * buckets
    step = F.when(F.col("rows_") > 10**9, 1).when(F.col("rows_") > 10**8, 4).otherwise(16)
    edges = df.agg(F.count("*").alias("rows_"), F.percentile_approx(order, [i / fine for i in range(1, fine)], 10_000).alias("fine_"))
    edges = edges.withColumn("step_", step).select(F.array_distinct(F.expr("filter(fine_, (e, i) -> (i + 1) % step_ = 0)")).alias("edges_"))
    dealt = df.join(F.broadcast(edges)).withColumn("bucket_", F.size(F.filter("edges_", lambda e: e < F.col(order)))).drop("edges_")
    by = F.col(order).desc() if descending else F.col(order).asc()
    within = Window.partitionBy("bucket_").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    side = Window.partitionBy(F.lit(0)).orderBy(F.desc("bucket_") if descending else F.asc("bucket_")).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("bucket_").agg(*[F.sum(c).alias(f"t_{k}") for k, c in sums.items()])
    before = totals.select("bucket_", *[F.coalesce(F.sum(f"t_{k}").over(side), F.lit(0)).alias(f"b_{k}") for k in sums])
    local = dealt.select("*", *[F.sum(c).over(within).alias(f"l_{k}") for k, c in sums.items()])
    joined = local.join(F.broadcast(before), "bucket_")
    return joined.select(*df.columns, *[(F.col(f"l_{k}") + F.col(f"b_{k}")).alias(k) for k in sums])


def quantiles(df: DataFrame, column: str, probabilities: list[float]) -> list[float]:
    """Exact quantiles of a column by linear interpolation; nulls take no part, an empty column has none.

    Distinct values are counted first and their running counts taken over value ranges, so no task
    holds all values.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"))
    upto = cut(running(counts, "v", {"upto": "n"}))
    rows = upto.agg(F.max("upto")).first()[0]
    if not rows:
        return []
    places = [(rows - 1) * p for p in probabilities]
    wanted = sorted({k for p in places for k in (floor(p), ceil(p))})
    found = upto.agg(*[F.min(F.when(F.col("upto") > k, F.col("v"))).alias(f"v{k}") for k in wanted]).first()
    value = lambda k: found[f"v{k}"]
    return [value(floor(p)) + (value(ceil(p)) - value(floor(p))) * (p - floor(p)) for p in places]


def contingency(df: DataFrame, row: str, column: str) -> DataFrame:
    """``row, column, n, expected, residual`` of a two-way table, empty cells included."""
    cells = df.where(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(F.col(row).alias("row"), F.col(column).alias("column")).agg(F.count("*").alias("n"))
    rows, columns = cells.groupBy("row").agg(F.sum("n").alias("nr")), cells.groupBy("column").agg(F.sum("n").alias("nc"))
    grid = rows.withColumn("one_", F.lit(1)).join(columns.withColumn("one_", F.lit(1)), "one_")  # distinct levels of two columns, not rows
    all_ = grid.join(cells, ["row", "column"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return all_.withColumn("expected", F.col("nr") * F.col("nc") / total).select("row", "column", "n", "expected", ((F.col("n") - F.col("expected")) / F.sqrt("expected")).alias("residual"))


def chi_square(cells: DataFrame) -> DataFrame:
    """``chi2, df, p, cramers_v`` of a contingency table, with Yates' correction for 2 x 2."""
    out = cells.agg(F.count_distinct("row").alias("r"), F.count_distinct("column").alias("c"), F.sum("n").alias("n"), F.sum((F.col("n") - F.col("expected")) ** 2 / F.col("expected")).alias("plain"), F.sum((F.greatest(F.abs(F.col("n") - F.col("expected")) - 0.5, F.lit(0.0))) ** 2 / F.col("expected")).alias("yates"))
    df_ = (F.col("r") - 1) * (F.col("c") - 1)
    out = out.withColumn("df", df_).withColumn("chi2", F.when(F.col("df") == 1, F.col("yates")).otherwise(F.col("plain")))
    return out.select("chi2", "df", chi2_upper(F.col("chi2"), F.col("df").cast("double")).alias("p"), F.sqrt(F.col("plain") / (F.col("n") * (F.least("r", "c") - 1))).alias("cramers_v"))


def sample_ratio(df: DataFrame, group: str, expected: dict[str, float]) -> DataFrame:
    """``n, chi2, df, p``: whether the arms' sizes fit the planned shares."""
    total = sum(expected.values())
    plan = F.create_map(*[x for k, v in expected.items() for x in (F.lit(k), F.lit(v / total))])
    counts = df.where(F.col(group).isin(list(expected))).groupBy(F.col(group).alias("g")).agg(F.count("*").alias("n"))
    all_ = counts.withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(0)))).withColumn("e", F.col("total") * F.element_at(plan, F.col("g")))
    out = all_.agg(F.sum("n").alias("n"), F.sum((F.col("n") - F.col("e")) ** 2 / F.col("e")).alias("chi2"))
    return out.withColumn("df", F.lit(len(expected) - 1)).withColumn("p", chi2_upper(F.col("chi2"), F.lit(float(len(expected) - 1))))


def anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """``groups, n, f, p, eta2`` of one-way analysis of variance, from group counts, means and variances."""
    g = df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("v")).where("n > 0")
    all_ = Window.partitionBy(F.lit(0))
    mean = F.sum(F.col("n") * F.col("m")).over(all_) / F.sum("n").over(all_)
    out = g.withColumn("mean", mean).agg(F.count("*").alias("groups"), F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("m") - F.col("mean")) ** 2).alias("between"), F.sum((F.col("n") - 1) * F.col("v")).alias("within"))
    d1, d2 = (F.col("groups") - 1).cast("double"), (F.col("n") - F.col("groups")).cast("double")
    out = out.withColumn("f", F.col("between") / d1 / (F.col("within") / d2))
    return out.select("groups", "n", "f", f_upper(F.col("f"), d1, d2).alias("p"), (F.col("between") / (F.col("between") + F.col("within"))).alias("eta2"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """``left, right, r`` of every pair of columns, all in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    rows = [F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)]
    return df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)]).select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def cuped(df: DataFrame, arm: str, outcome: str, before: str, a, b) -> DataFrame:
    """``theta, diff, adjusted, variance_ratio``: the difference of arms with the covariate's part taken out."""
    rows = df.where(F.col(arm).isin(a, b) & F.col(outcome).isNotNull() & F.col(before).isNotNull())
    pick = lambda level, c: F.when(F.col(arm) == level, F.col(c).cast("double"))
    one = rows.agg(
        (F.covar_samp(F.col(outcome).cast("double"), F.col(before).cast("double")) / F.var_samp(before)).alias("theta"), F.corr(F.col(outcome).cast("double"), F.col(before).cast("double")).alias("r"),
        *[F.avg(pick(level, c)).alias(f"{n}_{k}") for n, level in (("a", a), ("b", b)) for k, c in (("y", outcome), ("x", before))],
    )
    diff = F.col("b_y") - F.col("a_y")
    return one.select("theta", diff.alias("diff"), (diff - F.col("theta") * (F.col("b_x") - F.col("a_x"))).alias("adjusted"), (1 - F.col("r") ** 2).alias("variance_ratio"))


def diff_in_diff(df: DataFrame, treated: Column, after: Column, value: str) -> DataFrame:
    """``pre_control, post_control, pre_treated, post_treated, effect, se, t`` of the four cells."""
    sums = []
    for name, cell in (("pre_control", ~treated & ~after), ("post_control", ~treated & after), ("pre_treated", treated & ~after), ("post_treated", treated & after)):
        v = F.when(cell, F.col(value))
        sums += [F.avg(v).alias(name), (F.var_samp(v) / F.count(v)).alias(f"s_{name}")]
    one = df.agg(*sums)
    effect = F.col("post_treated") - F.col("pre_treated") - F.col("post_control") + F.col("pre_control")
    se = F.sqrt(sum((F.col(f"s_{n}") for n in ("pre_control", "post_control", "pre_treated", "post_treated")), F.lit(0)))
    return one.select("pre_control", "post_control", "pre_treated", "post_treated", effect.alias("effect"), se.alias("se"), (effect / se).alias("t"))


def psi(reference: DataFrame, current: DataFrame, column: str, bins: int = 10, eps: float = 1e-6) -> DataFrame:
    """``psi, severity``: the population stability index over the reference's quantile bins."""
    edges = reference.agg(F.array_distinct(F.percentile(column, F.array(*[F.lit(i / bins) for i in range(1, bins)]))).alias("edges"))

    def shares(df: DataFrame, name: str) -> DataFrame:
        bucket = F.size(F.filter("edges", lambda e: e < F.col("v")))
        rows = df.select(F.col(column).cast("double").alias("v")).where("v is not null").join(F.broadcast(edges)).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
        return rows.select("bucket", (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).alias(name))

    both = shares(reference, "r").join(shares(current, "c"), "bucket", "full_outer")
    r, c = F.coalesce("r", F.lit(0.0)) + eps, F.coalesce("c", F.lit(0.0)) + eps
    out = both.agg(F.coalesce(F.sum((c - r) * F.log(c / r)), F.lit(0.0)).alias("psi"))
    return out.withColumn("severity", F.when(F.col("psi") >= 0.25, "significant").when(F.col("psi") >= 0.1, "moderate").otherwise("stable"))


def weight_of_evidence(df: DataFrame, bin_: Column, event: Column, smoothing: float = 0.5) -> DataFrame:
    """``bin, n, events, woe, iv`` per bin, smoothed."""
    g = df.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.count_if(event).alias("events"))
    all_ = Window.partitionBy(F.lit(0))
    k = F.count("*").over(all_)
    good = (F.col("n") - F.col("events") + smoothing) / (F.sum(F.col("n") - F.col("events")).over(all_) + smoothing * k)
    bad = (F.col("events") + smoothing) / (F.sum("events").over(all_) + smoothing * k)
    return g.withColumn("woe", F.log(good / bad)).withColumn("iv", (good - bad) * F.log(good / bad))


def thresholds(df: DataFrame, positive: Column, score: str, grid: list[float]) -> DataFrame:
    """``threshold, tp, fp, fn, tn, precision, recall, f1`` at each threshold (score >= threshold).

    Rows are counted once into the grid's steps; the confusion counts are running sums over them.
    """
    cuts = sorted(grid)
    step = sum((F.when(F.col(score) >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    counted = df.groupBy(step.alias("step")).agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    ladder = df.sparkSession.createDataFrame([(0, None), *[(i + 1, float(c)) for i, c in enumerate(cuts)]], "step int, threshold double")
    full = ladder.join(counted, "step", "left").na.fill(0, ["pos", "neg"])
    up = Window.partitionBy(F.lit(0)).orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(F.lit(0))
    out = full.withColumn("tp", F.sum("pos").over(up)).withColumn("fp", F.sum("neg").over(up)).withColumn("fn", F.sum("pos").over(all_) - F.col("tp")).withColumn("tn", F.sum("neg").over(all_) - F.col("fp")).where("threshold is not null")
    precision = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    recall = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    return out.select("threshold", "tp", "fp", "fn", "tn", precision.alias("precision"), recall.alias("recall"), F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0).alias("f1"))


def calibration(df: DataFrame, label: Column, score: Column, bins: int = 10) -> DataFrame:
    """``bin, n, mean_score, rate, gap`` in equal-width bins, the last closed; empty bins are left out."""
    b = F.least(F.floor(score * bins), F.lit(bins - 1))
    return df.groupBy(b.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(label.cast("double")).alias("rate")).withColumn("gap", F.abs(F.col("mean_score") - F.col("rate")))


def brier(df: DataFrame, label: Column, score: Column, bins: int = 10) -> DataFrame:
    """``brier, ece, log_loss`` in one pass over rows and one over bins."""
    y = label.cast("double")
    p = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), score))
    b = F.least(F.floor(score * bins), F.lit(bins - 1))
    g = df.groupBy(b.alias("b")).agg(F.count("*").alias("n"), F.sum((score - y) ** 2).alias("sq"), F.sum(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("ll"), F.sum(score).alias("s"), F.sum(y).alias("y"))
    n = F.sum("n")
    return g.agg((F.sum("sq") / n).alias("brier"), (F.sum(F.abs(F.col("s") - F.col("y"))) / n).alias("ece"), (F.sum("ll") / n).alias("log_loss"))


def benjamini_hochberg(df: DataFrame, p: str, buckets: int = 64) -> DataFrame:
    """Rows with ``p_adjusted``: the running minimum from the largest p down, of p m / rank.

    Equal p values have one adjusted value, that of their last rank, so ranks are counts of distinct
    values: a running sum over value ranges, then the minimum within a range and over those above.
    """
    counts = df.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("p_")).agg(F.count("*").alias("n_"))
    ranked = running(counts, "p_", {"rank_": "n_"}, buckets=buckets)
    edges = counts.agg(F.sum("n_").alias("m_"), F.percentile_approx("p_", [i / buckets for i in range(1, buckets)], 1000).alias("edges_"))
    raw = ranked.join(F.broadcast(edges)).select("p_", (F.col("p_") * F.col("m_") / F.col("rank_")).alias("raw_"), F.size(F.filter(F.array_distinct("edges_"), lambda e: e < F.col("p_"))).alias("bucket_"))
    within = Window.partitionBy("bucket_").orderBy(F.desc("p_")).rowsBetween(Window.unboundedPreceding, 0)
    above = Window.partitionBy(F.lit(0)).orderBy(F.desc("bucket_")).rowsBetween(Window.unboundedPreceding, -1)
    least = raw.groupBy("bucket_").agg(F.min("raw_").alias("low_")).select("bucket_", F.min("low_").over(above).alias("above_"))
    known = raw.withColumn("own_", F.min("raw_").over(within)).join(F.broadcast(least), "bucket_")
    known = known.select("p_", F.least(F.lit(1.0), F.col("own_"), F.col("above_")).alias("p_adjusted"))
    return df.join(known, F.col(p) == F.col("p_"), "left").drop("p_")


def murphy(df: DataFrame, label: Column, score: Column, bins: int = 10) -> DataFrame:
    """``reliability, resolution, uncertainty``: what the Brier score of binned forecasts consists of."""
    b = F.least(F.floor(score * bins), F.lit(bins - 1))
    g = df.groupBy(b.alias("b")).agg(F.count("*").alias("n"), F.avg(score).alias("f"), F.avg(label.cast("double")).alias("o"))
    base = df.agg(F.avg(label.cast("double")).alias("base"))
    n = F.sum("n")
    return g.join(F.broadcast(base)).agg((F.sum(F.col("n") * (F.col("f") - F.col("o")) ** 2) / n).alias("reliability"), (F.sum(F.col("n") * (F.col("o") - F.col("base")) ** 2) / n).alias("resolution"), F.max(F.col("base") * (1 - F.col("base"))).alias("uncertainty"))


def lagged_correlation(series: DataFrame, at: str, x: str, y: str, lags: list[int]) -> DataFrame:
    """``lag, n, r``: correlation of x with y that many steps later, on a whole-numbered time column."""
    ahead = series.select(F.explode(F.array(*map(F.lit, lags))).alias("lag"), F.col(at).alias("at_"), F.col(x).alias("x_")).withColumn("then_", F.col("at_") + F.col("lag"))
    later = series.select(F.col(at).alias("then_"), F.col(y).alias("y_"))
    return ahead.join(later, "then_").groupBy("lag").agg(F.count("*").alias("n"), F.corr("x_", "y_").alias("r"))


def prior_median(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Rows with ``baseline``, the median of the earlier rows of their keys (null for the first).

    Rows are dealt by key and sorted; two heaps for the key at hand give each row its median in the
    logarithm of the rows before it. Null values are no history.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, low, high = None, [], []
        for batch in batches:
            keys = zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in by))
            found = []
            for now, x in zip(keys, batch.column(batch.num_columns - 1).to_pylist()):
                if now != key:
                    key, low, high = now, [], []
                found.append(None if not low else float(-low[0]) if len(low) > len(high) else (high[0] - low[0]) / 2)
                if x is not None:
                    # The lower half, negated, has as many as the upper or one more.
                    heappush(high, -heappushpop(low, -x))
                    if len(high) > len(low):
                        heappush(low, -heappop(high))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.float64())], [*batch.schema.names[:-1], "baseline"])

    sorted_ = df.withColumn("value_", F.col(value).cast("double")).repartition(*by).sortWithinPartitions(*by, order)
    return sorted_.mapInArrow(run, StructType([*df.schema.fields, StructField("baseline", DoubleType())]))


def strata(df: DataFrame, covariate: str, parts: int = 10) -> DataFrame:
    """Rows with ``stratum`` (0 on) between the exact quantiles of a covariate; equal values share one."""
    edges = F.array(*[F.lit(e) for e in quantiles(df, covariate, [i / parts for i in range(1, parts)])]).cast("array<double>")
    return df.withColumn("stratum", F.size(F.filter(edges, lambda e: e < F.col(covariate))))


def leakage(train: DataFrame, test: DataFrame, features: list[str], target: str) -> DataFrame:
    """``check, feature, value, flagged``: correlation with the target, rows shared by the sets, target shift."""
    corr = train.agg(*[F.abs(F.corr(F.col(f).cast("double"), F.col(target).cast("double"))).alias(f) for f in features])
    rows = [F.struct(F.lit("target_correlation").alias("check"), F.lit(f).alias("feature"), F.col(f).alias("value"), (F.col(f) >= 0.95).alias("flagged")) for f in features]
    parts = [corr.select(F.explode(F.array(*rows)).alias("r")).select("r.*")]
    shared = test.select(features).join(train.select(features).distinct(), features, "left_semi").agg(F.count("*").alias("n"))
    share = shared.join(F.broadcast(test.agg(F.count("*").alias("m")))).select(F.lit("duplicate_rows").alias("check"), F.lit(None).cast("string").alias("feature"), (F.col("n") / F.col("m")).alias("value"))
    parts.append(share.withColumn("flagged", F.col("value") >= 0.01))
    shift = train.agg(F.avg(F.col(target).cast("double")).alias("a")).join(F.broadcast(test.agg(F.avg(F.col(target).cast("double")).alias("b"))))
    parts.append(shift.select(F.lit("target_shift").alias("check"), F.lit(None).cast("string").alias("feature"), F.abs(F.col("a") - F.col("b")).alias("value")).withColumn("flagged", F.col("value") >= 0.1))
    return reduce(DataFrame.unionByName, parts)


def representation(df: DataFrame, cell: str, targets: dict[str, float]) -> DataFrame:
    """``cell, n, share, target, ratio, weight, low, high``: a sample's make-up against the population's."""
    plan = F.create_map(*[x for k, v in targets.items() for x in (F.lit(k), F.lit(v))])
    counts = df.where(F.col(cell).isin(list(targets))).groupBy(F.col(cell).alias("cell")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    out = counts.withColumn("total", total).withColumn("share", F.col("n") / F.col("total")).withColumn("target", F.element_at(plan, F.col("cell")))
    low, high = wilson(F.col("n"), F.col("total"))
    return out.select("cell", "n", "share", "target", (F.col("share") / F.col("target")).alias("ratio"), (F.col("target") / F.col("share")).alias("weight"), low.alias("low"), high.alias("high"))
