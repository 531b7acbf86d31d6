"""Effects of a treatment that units adopt at different times, and whether one series leads another.

Everything that grows with the data is a sum by a few keys; what is solved on are those sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.stats import f_upper, normal_two_sided


def changes(panel: DataFrame, unit: str, period: str, y: str, adopt: str, cluster: str | None = None) -> DataFrame:
    """``g, t, unit, cluster, treated, change`` of every cohort ``g`` from its adoption on, and those not yet treated.

    ``adopt`` is the unit's period of adoption, null for never. The change is from the period before
    ``g`` to ``t``; units without a value in both take no part. Units that adopted by ``t`` are no
    controls. Periods are whole numbers; of several rows of a unit and period the mean counts.
    """
    cells = panel.groupBy(F.col(unit).alias("unit"), F.col(period).cast("long").alias("t")).agg(F.avg(F.col(y).cast("double")).alias("y"), F.min(F.col(adopt).cast("long")).alias("adopt"), F.min(cluster or unit).alias("cluster"))
    cohorts = sorted(r[0] for r in panel.select(F.col(adopt).cast("long")).where(F.col(adopt).isNotNull()).distinct().collect())
    own = cells.where("y is not null").groupBy("unit").agg(F.map_from_entries(F.collect_list(F.struct("t", "y"))).alias("ys"), F.min("adopt").alias("adopt"), F.min("cluster").alias("cluster"))
    # A unit is of a cohort, or a control of it until its own adoption; a unit has as many periods as there are.
    each = own.select("*", F.explode(F.array(*[F.lit(g) for g in cohorts]).cast("array<long>")).alias("g")).where((F.col("adopt") == F.col("g")) | F.col("adopt").isNull() | (F.col("adopt") > F.col("g")))
    times = each.select("*", F.try_element_at("ys", F.col("g") - 1).alias("base"), F.explode("ys").alias("t", "y")).where((F.col("t") >= F.col("g")) & F.col("base").isNotNull() & ((F.col("adopt") == F.col("g")) | F.col("adopt").isNull() | (F.col("adopt") > F.col("t"))))
    return times.select("g", "t", "unit", "cluster", F.coalesce(F.col("adopt") == F.col("g"), F.lit(False)).alias("treated"), (F.col("y") - F.col("base")).alias("change"))


def group_time_effects(panel: DataFrame, unit: str, period: str, y: str, adopt: str, cluster: str | None = None) -> DataFrame:
    """``g, t, n_treated, n_control, effect, error, z, p``: average effects by cohort and period.

    The effect is the treated cohort's mean change since the period before adoption less that of the
    units not yet treated. Its error sums the units' influence within clusters before squaring
    (clusters default to units). Cells without controls or without treated units give no row.
    """
    rows = changes(panel, unit, period, y, adopt, cluster)
    arm = lambda name, side: [F.coalesce(F.sum(F.when(side, F.lit(1))), F.lit(0)).alias(f"n_{name}"), F.coalesce(F.sum(F.when(side, F.col("change"))), F.lit(0.0)).alias(f"s_{name}")]
    by = rows.groupBy("g", "t", "cluster").agg(*arm("treated", F.col("treated")), *arm("control", ~F.col("treated")))
    whole = by.groupBy("g", "t").agg(F.sum("n_treated").alias("n_t"), F.sum("s_treated").alias("s_t"), F.sum("n_control").alias("n_c"), F.sum("s_control").alias("s_c")).where("n_t > 0 and n_c > 0")
    # A few cohorts by a few periods.
    influence = (F.col("s_treated") - F.col("n_treated") * F.col("s_t") / F.col("n_t")) / F.col("n_t") - (F.col("s_control") - F.col("n_control") * F.col("s_c") / F.col("n_c")) / F.col("n_c")
    found = by.join(F.broadcast(whole), ["g", "t"]).groupBy("g", "t", "n_t", "s_t", "n_c", "s_c").agg(F.sqrt(F.sum(influence * influence)).alias("error"))
    effect = F.col("s_t") / F.col("n_t") - F.col("s_c") / F.col("n_c")
    out = found.select("g", "t", F.col("n_t").alias("n_treated"), F.col("n_c").alias("n_control"), effect.alias("effect"), "error")
    z = F.when(F.col("error") > 0, F.col("effect") / F.col("error"))
    return out.select("*", z.alias("z"), normal_two_sided(z).alias("p"))


def event_study(effects: DataFrame) -> DataFrame:
    """``after, effect, n``: effects by the time since adoption, weighted by treated units."""
    return effects.groupBy((F.col("t") - F.col("g")).alias("after")).agg((F.sum(F.col("n_treated") * F.col("effect")) / F.sum("n_treated")).alias("effect"), F.sum("n_treated").alias("n"))


def overall_effect(effects: DataFrame) -> DataFrame:
    """``effect, cells``: the mean over all treated units and periods, one row."""
    return effects.agg((F.sum(F.col("n_treated") * F.col("effect")) / F.sum("n_treated")).alias("effect"), F.count("*").alias("cells"))


#: Steps of a series that are sorted together, at least.
STRETCH = 256


def lagged(series: DataFrame, keys: list[str], t: str, columns: list[str], lags: int) -> DataFrame:
    """Rows of a series with arrays ``<column>_lags`` of the values 1 to ``lags`` steps before; rows without all of them are left out.

    A series is cut into stretches of steps, and a stretch gets the last ``lags`` steps of the one before
    too, so a long series needs no task of its own and few steps are sent twice. Steps are whole numbers,
    each once a key; a step that is missing leaves out those that need it.
    """
    size = max(STRETCH, 16 * lags)
    step = F.col(t).cast("long")
    own = F.floor(F.col(t) / size)
    rows = series.where(" and ".join(f"{c} is not null" for c in [t, *columns])).select(*keys, step.alias(t), *[F.col(c).cast("double").alias(c) for c in columns])
    sent = rows.withColumn("stretch_", F.explode(F.when(F.pmod(F.col(t), F.lit(size)) >= size - lags, F.array(own, own + 1)).otherwise(F.array(own))))
    before = Window.partitionBy(*keys, "stretch_").orderBy(t)
    back = [F.array(*[F.lag(c, k).over(before) for k in range(1, lags + 1)]).alias(f"{c}_lags") for c in columns]
    met = sent.select(*keys, t, *columns, *back, "stretch_", F.lag(t, lags).over(before).alias("first_"))
    return met.where((F.col("stretch_") == own) & (F.col("first_") == F.col(t) - lags)).drop("stretch_", "first_")


def granger(series: DataFrame, keys: list[str], t: str, x: str, y: str, lags: int = 4, period: int | None = 12) -> DataFrame:
    """``<keys>, n, f, df1, df2, p``: whether the past of ``x`` tells more of ``y`` than its own past does.

    Two regressions of ``y`` are compared, one on its lags, one on those of ``x`` too; both have an
    intercept and, unless ``period`` is None, the sine and cosine of one and two cycles a period.
    Spark sums the products of all pairs of regressors by key, and each key's normal equations are
    solved from these few numbers. Series without enough steps, or that are fitted without
    rest, have an F of 0 and a p of 1. Each (key, step) is one row; steps with nulls are missing.
    """
    rows = lagged(series, keys, t, [x, y], lags)
    angle = 2 * np.pi * F.col(t) / (period or 1)
    season = [F.sin(angle), F.cos(angle), F.sin(2 * angle), F.cos(2 * angle)] if period else []
    width = 1 + lags + len(season)
    design = F.concat(F.array(F.lit(1.0)), F.col(f"{y}_lags"), F.array(*season) if season else F.array().cast("array<double>"), F.col(f"{x}_lags"), F.array(F.col(y)))
    size = width + lags + 1
    rows = rows.select(*keys, design.alias("d"))
    products = [F.sum(F.col("d")[i] * F.col("d")[j]).alias(f"m{i}_{j}") for i in range(size) for j in range(i, size)]
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.array(*products).alias("m"))
    upper = np.triu_indices(size)

    def rest(gram: np.ndarray, own: list[int]) -> float:
        """The squares that regressors leave of the last column, and scaled so that sizes of columns don't matter."""
        a, b, c = gram[np.ix_(own, own)], gram[own, -1], gram[-1, -1]
        scale = np.sqrt(np.where(np.diag(a) > 0, np.diag(a), 1))
        solved = np.linalg.lstsq(a / np.outer(scale, scale), b / scale, rcond=1e-12)[0]
        return float(max(0.0, c - solved @ (b / scale)))

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for n, m in zip(part["n"], part["m"]):
                gram = np.zeros((size, size))
                gram[upper] = m
                gram = gram + np.triu(gram, 1).T
                less, more = rest(gram, list(range(width))), rest(gram, list(range(size - 1)))
                df2 = int(n) - (size - 1)
                out.append((max(0.0, (less - more) / lags) / (more / df2) if df2 > 0 and more > 1e-12 * gram[-1, -1] else 0.0, df2))
            yield part.drop(columns=["m"]).assign(f=[o[0] for o in out], df2=[o[1] for o in out])

    kinds = {f.name: f.dataType.simpleString() for f in series.schema.fields}
    found = sums.mapInPandas(solve, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "n long", "f double", "df2 long"]))
    p = F.when((F.col("df2") > 0) & (F.col("f") > 0), f_upper(F.col("f"), F.lit(float(lags)), F.col("df2").cast("double"))).otherwise(1.0)
    return found.select(*keys, "n", "f", F.lit(lags).alias("df1"), "df2", p.alias("p"))
