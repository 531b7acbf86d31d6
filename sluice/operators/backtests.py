"""Forecasts held against what came, from many origins of each series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MODELS = ("naive", "seasonal", "drift", "mean")


def rolling_origins(series: DataFrame, keys: list[str], t: str, y: str, horizon: int, origins: int, least: int, step: int = 1, period: int = 12) -> DataFrame:
    """``<keys>, origin, ahead, model, actual, forecast, error`` of every model, origin and step ahead.

    A series' steps are 0, 1, 2 and so on without gaps. Origins count the steps known: the last one
    leaves ``horizon`` steps, those before it lie ``step`` apart, ``origins`` of them at most, none with
    fewer than ``least`` steps. ``naive`` repeats the last value, ``seasonal`` that of the same place of
    the last whole period known, ``drift`` goes on in the line from the first to the last, ``mean`` is
    that of all known. A forecast sees nothing after its origin; a series too short has no rows.
    """
    ordered = Window.partitionBy(*keys).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    known = series.select(*keys, F.col(t).cast("long").alias(t), F.col(y).cast("double").alias("y_")).withColumns({"mean_": F.avg("y_").over(ordered), "first_": F.first("y_").over(ordered)})
    last = known.groupBy(*keys).agg((F.max(t) + 1).alias("n_"))
    lately = last.select(*keys, F.explode(F.filter(F.transform(F.sequence(F.lit(0), F.lit(origins - 1)), lambda i: F.col("n_") - horizon - i * step), lambda o: o >= least)).alias("origin"))
    ends = known.select(*keys, (F.col(t) + 1).alias("end_"), "y_", "mean_", "first_")
    at = lately.join(ends, [*[lately[k].eqNullSafe(ends[k]) for k in keys], lately["origin"] == ends["end_"]]).select(*[lately[c] for c in lately.columns], "y_", "mean_", "first_", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("ahead"))
    at = at.withColumns({t: F.col("origin") - 1 + F.col("ahead"), "season_": F.col("origin") - 1 + F.col("ahead") - period * F.ceil(F.col("ahead") / period)})
    values = known.select(*keys, F.col(t).alias("step_"), F.col("y_").alias("value_"))
    on = lambda a, b, column: [*[a[k].eqNullSafe(b[k]) for k in keys], a[column] == b["step_"]]
    actual = at.join(values, on(at, values, t)).select(*[at[c] for c in at.columns], F.col("value_").alias("actual"))
    before = values.withColumnRenamed("value_", "before_")
    both = actual.join(before, on(actual, before, "season_"), "left").select(*[actual[c] for c in actual.columns], "before_")
    steps = F.col("origin") - 1
    forecast = {"naive": F.col("y_"), "seasonal": F.col("before_"), "drift": F.col("y_") + F.col("ahead") * F.coalesce((F.col("y_") - F.col("first_")) / F.nullif(steps, F.lit(0)), F.lit(0.0)), "mean": F.col("mean_")}
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), f.alias("forecast")) for m, f in forecast.items()])).alias("m")
    return both.select(*keys, "origin", "ahead", "actual", rows).select(*keys, "origin", "ahead", "m.model", "actual", "m.forecast", (F.col("actual") - F.col("m.forecast")).alias("error")).where("forecast is not null")


def scores(errors: DataFrame, by: list[str]) -> DataFrame:
    """``<by>, n, mae, rmse, bias`` of backtests; ``by`` may hold keys, model and ahead."""
    return errors.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.abs("error")).alias("mae"), F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"), F.avg("error").alias("bias"))
