"""Product and business analytics: funnels, cohorts, KPIs, alerts, decompositions, apportionment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.operators.statistics import running


def funnel(events: DataFrame, steps: list[str], user: str = "user_id", event: str = "event_type", segment: str | None = None) -> DataFrame:
    """``step, position, users, pct_of_top, step_conversion, drop_off_pct`` (by segment, if given).

    A user reaches a step who has all events up to it, in any order. One aggregation by user and one
    by step; a user's events are combined before the shuffle. A step without events has no users.
    ``segment`` is the user's smallest value of that column.
    """
    flags = [F.max(F.when(F.col(event) == s, 1).otherwise(0)).alias(f"s{i}") for i, s in enumerate(steps)]
    extra = [F.min(segment).alias("segment")] if segment else []
    users = events.where(F.col(event).isin(steps) | F.lit(segment is not None)).groupBy(user).agg(*flags, *extra)
    reach, reached = [], F.lit(1)
    for i in range(len(steps)):
        reached = reached * F.col(f"s{i}")
        reach.append(F.sum(reached).alias(f"n{i}"))
    keys = ["segment"] if segment else []
    counts = users.groupBy(*keys).agg(*reach)
    top = F.greatest(F.col("n0"), F.lit(1))
    rows = [
        F.struct(
            F.lit(s).alias("step"),
            F.lit(i + 1).alias("position"),
            F.coalesce(F.col(f"n{i}"), F.lit(0)).alias("users"),
            F.round(100.0 * F.coalesce(F.col(f"n{i}"), F.lit(0)) / F.coalesce(top, F.lit(1)), 1).alias("pct_of_top"),
            F.round(100.0 * F.coalesce(F.col(f"n{i}"), F.lit(0)) / F.greatest(F.coalesce(F.col(f"n{max(0, i - 1)}"), F.lit(0)), F.lit(1)), 1).alias("step_conversion"),
        )
        for i, s in enumerate(steps)
    ]
    out = counts.select(*keys, F.explode(F.array(*rows)).alias("row")).select(*keys, "row.*")
    return out.withColumn("drop_off_pct", F.when(F.col("position") == 1, 0.0).otherwise(F.round(100.0 - F.col("step_conversion"), 1)))


def cohort_retention(events: DataFrame, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """``cohort, period, users, cohort_users, retention``: months since the user's first month."""
    monthly = events.select(F.col(user).alias("user"), F.trunc(F.col(ts), "MM").alias("month")).distinct()
    first = F.min("month").over(Window.partitionBy("user"))
    period = F.round(F.months_between(F.col("month"), F.col("cohort"))).cast("int")
    counts = monthly.withColumn("cohort", first).groupBy("cohort", period.alias("period")).agg(F.count("*").alias("users"))
    base = F.max(F.when(F.col("period") == 0, F.col("users"))).over(Window.partitionBy("cohort"))
    return counts.withColumn("cohort_users", base).withColumn("retention", F.round(100.0 * F.col("users") / F.col("cohort_users"), 1))


def kpi_status(values: DataFrame, date: str = "date", metric: str = "metric", value: str = "value") -> DataFrame:
    """``metric, as_of, latest, week_ago, month_ago, wow_pct, mom_pct, slope``: the last value, the last on
    or before 7 and 30 days earlier, and the slope of the last eight points."""
    own = values.select(F.col(metric).alias("metric"), F.col(date).alias("date"), F.col(value).alias("value"))
    by = Window.partitionBy("metric")
    marked = own.withColumn("as_of", F.max("date").over(by)).withColumn("back", F.row_number().over(by.orderBy(F.desc("date"))))
    at = lambda days: F.max_by(F.when(F.col("date") <= F.date_sub("as_of", days), F.col("value")), F.when(F.col("date") <= F.date_sub("as_of", days), F.col("date")))
    x = F.when(F.col("back") <= 8, -F.col("back").cast("double"))
    out = marked.groupBy("metric").agg(F.max("as_of").alias("as_of"), F.max_by("value", "date").alias("latest"), at(7).alias("week_ago"), at(30).alias("month_ago"), F.regr_slope(F.when(F.col("back") <= 8, F.col("value")), x).alias("slope"))
    change = lambda old: F.when(F.col(old) != 0, F.round(100.0 * (F.col("latest") - F.col(old)) / F.abs(F.col(old)), 1))
    return out.withColumn("wow_pct", change("week_ago")).withColumn("mom_pct", change("month_ago")).withColumn("slope", F.round("slope", 4))


def metric_alerts(series: DataFrame, window: int, z: float, date: str = "date", value: str = "value", floor: float | None = None, ceiling: float | None = None, trend_pct: float = 0.5, keys: list[str] | None = None) -> DataFrame:
    """``date, kind, severity, value, score``: bounds, z against the prior full window, day-over-day.

    Standard deviations are of the population; the window must be full. Several series run at once
    by ``keys``; without keys one series is one partition, which a daily series is small enough for.
    """
    keys = keys or []
    order = Window.partitionBy(*([F.col(k) for k in keys] or [F.lit(0)])).orderBy(date)
    prior = order.rowsBetween(-window, -1)
    full = F.count(value).over(prior) == window
    mean, spread, last = F.avg(value).over(prior), F.stddev_pop(value).over(prior), F.lag(value).over(order)
    marked = series.select(
        *keys, F.col(date).alias("date"), F.col(value).alias("value"), F.when(full & (spread > 0), (F.col(value) - mean) / spread).alias("z"),
        F.when(last != 0, (F.col(value) - last) / F.abs(last)).alias("change"),
    )
    hit = lambda kind, severity, score, condition: F.when(condition, F.struct(F.lit(kind).alias("kind"), severity.alias("severity"), F.round(score, 4).alias("score")))
    rules = [
        hit("zscore", F.when(F.abs("z") >= 2 * z, "critical").otherwise("warning"), F.col("z"), F.abs("z") >= z),
        hit("trend", F.when(F.abs("change") >= 2 * trend_pct, "critical").otherwise("warning"), F.col("change"), F.abs("change") >= trend_pct),
    ]
    if floor is not None:
        rules.append(hit("floor", F.lit("critical"), F.col("value"), F.col("value") < floor))
    if ceiling is not None:
        rules.append(hit("ceiling", F.lit("warning"), F.col("value"), F.col("value") > ceiling))
    return marked.select(*keys, "date", "value", F.explode(F.filter(F.array(*rules), lambda r: r.isNotNull())).alias("a")).select(*keys, "date", "value", "a.*")


def lmdi(before: Column, after: Column, kpi_before: Column, kpi_after: Column) -> Column:
    """One factor's share of a product's change: the log mean of the product times the log ratio."""
    mean = F.when(kpi_after == kpi_before, kpi_after).otherwise((kpi_after - kpi_before) / (F.log(kpi_after) - F.log(kpi_before)))
    return mean * F.log(after / before)


def apportion(df: DataFrame, weight: str, units: int, keys: list[str], method: str = "largest_remainder", by: list[str] | None = None) -> DataFrame:
    """``units`` whole seats over rows in proportion to ``weight``, exactly adding up.

    Largest remainder gives floors and then one each by remainder; the divisor methods (jefferson,
    webster, adams, huntington) rank the priorities ``weight / divisor(k)`` of every row's next seats.
    A row can't get more seats than its quota, rounded up, plus a margin that covers the divisor
    methods' quota violations; ties go to ``keys`` in order. ``by`` splits into separate contests.
    """
    by = by or []
    group = Window.partitionBy(*([F.col(b) for b in by] or [F.lit(0)]))
    total = F.sum(weight).over(group)
    quota = F.col(weight) * units / total
    if method == "largest_remainder":
        base = df.withColumn("floor_", F.floor(quota)).withColumn("rest_", quota - F.floor(quota))
        left = F.lit(units) - F.sum("floor_").over(group)
        place = F.row_number().over(group.orderBy(F.desc("rest_"), *keys))
        return base.withColumn("seats", (F.col("floor_") + F.when(place <= left, 1).otherwise(0)).cast("long")).drop("floor_", "rest_")
    k = F.col("seat_").cast("double")
    divisor = {"jefferson": k + 1, "webster": k + 0.5, "adams": k, "huntington": F.sqrt(k * (k + 1))}[method]
    free = 1 if method in ("adams", "huntington") else 0
    n = F.count("*").over(group)
    most = F.least(F.lit(units), (F.ceil(quota * 1.5) + n).cast("int"))
    left = F.lit(units) - free * F.col("rows_")
    asked = df.withColumn("rows_", n).withColumn("most_", most).withColumn("seat_", F.explode(F.sequence(F.lit(free), F.col("most_")))).withColumn("claim", F.col(weight) / divisor)
    chosen = asked.withColumn("place_", F.row_number().over(group.orderBy(F.desc("claim"), *keys, "seat_"))).withColumn("left_", left)
    won = chosen.groupBy(*by, *keys).agg(F.first(weight).alias(weight), (F.sum(F.when(F.col("place_") <= F.col("left_"), 1).otherwise(0)) + free).cast("long").alias("seats"))
    return won


def lift_matrix(df: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """``row, column, total, expected, lift, share``: cells against what independent margins give."""
    cells = df.groupBy(F.col(row).alias("row"), F.col(column).alias("column")).agg(F.sum(value).alias("total"))
    all_ = F.sum("total").over(Window.partitionBy(F.lit(0)))
    expected = F.sum("total").over(Window.partitionBy("row")) * F.sum("total").over(Window.partitionBy("column")) / all_
    return cells.withColumn("expected", expected).withColumn("share", F.col("total") / all_).withColumn("lift", F.col("total") / F.col("expected") - 1)


def concentration(df: DataFrame, key: str, value: str) -> DataFrame:
    """``key, total, share, cumulative_share``, largest first."""
    sums = df.groupBy(F.col(key).alias("key")).agg(F.sum(value).alias("total"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("total"), "key").rowsBetween(Window.unboundedPreceding, 0)
    all_ = F.sum("total").over(Window.partitionBy(F.lit(0)))
    return sums.withColumn("share", F.col("total") / all_).withColumn("cumulative_share", F.sum("total").over(order) / all_)


def sessionize(events: DataFrame, user: str, ts: str, gap_seconds: int) -> DataFrame:
    """Events with the ``session`` number of their user: a new one after a longer gap."""
    order = Window.partitionBy(user).orderBy(ts)
    new = F.when(F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(order).cast("timestamp")) > gap_seconds * 1_000_000, 1).otherwise(0)
    return events.withColumn("new_", new).withColumn("session", F.sum("new_").over(order.rowsBetween(Window.unboundedPreceding, 0)) + 1).drop("new_")


def rice(df: DataFrame, reach: str, impact: str, confidence: str, effort: str) -> DataFrame:
    """Rows with ``rice`` = reach x impact x confidence / effort (0 without effort) and its rank.

    Ranks are running counts over distinct scores in value ranges, so no task orders all rows.
    """
    score = F.when(F.col(effort) > 0, F.col(reach) * F.col(impact) * F.col(confidence) / F.col(effort)).otherwise(0.0)
    scored = df.withColumn("rice", score)
    counts = scored.groupBy(F.col("rice").alias("score_")).agg(F.count("*").alias("n_"))
    ranks = running(counts, "score_", {"upto_": "n_"}, descending=True).select("score_", (F.col("upto_") - F.col("n_") + 1).alias("rank"))
    return scored.join(ranks, F.col("rice") == F.col("score_"), "left").drop("score_")


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str], values: list[str]) -> DataFrame:
    """Every left row with the last right row of its keys at or before it (null where there is none).

    Both sides are laid into one time line per key, so it costs one shuffle and one sort and no pair
    of rows is made. Of right rows at one moment the last by value order counts.
    """
    side = left.withColumn("is_left_", F.lit(1))
    other = right.select(*by, on, *[F.col(v).alias(f"{v}_right_") for v in values]).withColumn("is_left_", F.lit(0))
    line = side.unionByName(other, allowMissingColumns=True)
    order = Window.partitionBy(*by).orderBy(on, "is_left_", *[f"{v}_right_" for v in values]).rowsBetween(Window.unboundedPreceding, 0)
    packed = F.last(F.when(F.col("is_left_") == 0, F.struct(*[F.col(f"{v}_right_").alias(v) for v in values])), ignorenulls=True).over(order)
    kept = line.withColumn("found_", packed).where("is_left_ = 1")
    return kept.select(*left.columns, *[F.col(f"found_.{v}").alias(f"asof_{v}") for v in values])


def range_join(facts: DataFrame, versions: DataFrame, on: str, at: str, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Facts with the version of their key that holds at ``at``: half open, null end is open."""
    v = versions.alias("v")
    holds = (facts[at] >= F.col(f"v.{start}")) & (F.col(f"v.{end}").isNull() | (facts[at] < F.col(f"v.{end}")))
    return facts.join(v, (facts[on] == F.col(f"v.{on}")) & holds, "left").drop(F.col(f"v.{on}"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
