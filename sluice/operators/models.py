"""Models and series: clustering, classifiers, item similarity, forecasts, trends, folds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import CountVectorizer, IDF, RegexTokenizer, StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.core.session import SMALL_ROWS, cut
from sluice.operators import pairs

#: Least blocks of items whose pairs are summed cell by cell; ratings are shuffled once for each.
ITEM_BLOCKS = 8

#: Ratings of a block, about, beyond the least blocks; a cell holds two blocks in the memory of a task.
BLOCK_RATINGS = 8_000_000


def segments(df: DataFrame, features: list[str], ks: range = range(2, 9), seed: int = 7):
    """Rows with ``segment`` under the number of clusters of the best silhouette, and that number."""
    ready = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="raw_", handleInvalid="skip"), StandardScaler(inputCol="raw_", outputCol="features_", withMean=True)]).fit(df).transform(df).persist()
    tried = []
    for k in ks:
        model = KMeans(k=k, seed=seed, featuresCol="features_", predictionCol="segment").fit(ready)
        tried.append((ClusteringEvaluator(featuresCol="features_", predictionCol="segment").evaluate(model.transform(ready)), k, model))
    _, k, model = max(tried, key=lambda t: (t[0], -t[1]))
    return model.transform(ready).drop("raw_", "features_"), k


def text_classifier(df: DataFrame, text: str, label: str, min_df: int = 2, vocabulary: int = 20000):
    """A fitted pipeline of TF-IDF and logistic regression."""
    return Pipeline(stages=[RegexTokenizer(inputCol=text, outputCol="words_", pattern=r"[^\p{L}\p{N}]+"), CountVectorizer(inputCol="words_", outputCol="counts_", minDF=min_df, vocabSize=vocabulary), IDF(inputCol="counts_", outputCol="features_"), LogisticRegression(featuresCol="features_", labelCol=label, regParam=0.01, maxIter=50)]).fit(df)


def folds(df: DataFrame, label: str, key: str, k: int, seed: int = 0) -> DataFrame:
    """Rows with a stratified ``fold``: by a hash of the key, within each label's hash order."""
    order = Window.partitionBy(label, F.pmod(F.xxhash64(F.lit(seed), key), F.lit(64))).orderBy(F.xxhash64(F.lit(seed + 1), key), key)
    return df.withColumn("fold", ((F.row_number().over(order) - 1) % k).cast("int"))


def item_similarity(ratings: DataFrame, user: str, item: str, rating: str, k: int, least_shared: int = 1, unowned: bool = False) -> DataFrame:
    """``item, other, score``: each item's ``k`` nearest by cosine over its users' ratings.

    Pairs arise within a user; users' lists are what bounds them. Items are dealt into blocks by their
    number, and about a million ratings at a time are packed into one row for each block. A cell has the
    rows of two blocks and makes, sums and ranks all of their pairs, so what is shuffled are ratings, once
    for each block, and the ``k`` best of a cell, not pairs. Blocks grow with the ratings, to bound the
    memory of a cell; so the bytes shuffled grow with their square. ``unowned`` counts ratings without a
    user in the norms.
    """
    own = ratings.select(F.col(user).alias("user"), F.col(item).alias("item"), F.col(rating).alias("rating"))
    # Ratings without a user are spread by their item.
    own = own.withColumn("alone", F.when(F.col("user").isNull(), F.col("item"))) if unowned else own.where("user is not null").withColumn("alone", F.lit(0))
    one = own.repartition("user", "alone").groupBy("user", "alone", "item").agg(F.avg("rating").alias("r")).where("item is not null")
    one = cut(one.select("user", "item", "r"))
    items, n, ratings_ = numbered(one.groupBy("item").agg(F.sqrt(F.sum(F.col("r") ** 2)).alias("norm"), F.count("user").alias("n")))
    blocks = max(ITEM_BLOCKS, -(-ratings_ // BLOCK_RATINGS))
    coded = one.where("user is not null").join(F.broadcast(items) if n <= SMALL_ROWS else items, "item").select("user", "at", "r")
    # A broadcast leaves users where they are.
    coded = (coded if n <= SMALL_ROWS else coded.repartition("user")).sortWithinPartitions("user")
    packed = coded.mapInArrow(pairs.pack(blocks), "block int, batch bigint, n binary, place binary, code binary, kinds binary")
    norms = items.groupBy((F.col("at") % blocks).cast("int").alias("block")).agg(F.array_sort(F.collect_list(F.struct("at", "norm"))).alias("l")).select("block", F.col("l.norm").alias("norms"))
    cells = packed.unionByName(norms, allowMissingColumns=True).withColumn("with", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    cells = cells.withColumn("lo", F.least("block", "with")).withColumn("hi", F.greatest("block", "with")).drop("with")
    dealt = cells.repartitionById(blocks * (blocks + 1) // 2, F.expr("CAST(hi * (hi + 1) / 2 AS INT) + lo"))
    found = dealt.mapInArrow(pairs.nearest(blocks, k, least_shared), "at bigint, other_at bigint, score double")
    best = Window.partitionBy("at").orderBy(F.desc("score"), "other_at")
    kept = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    names = items.select("item", "at")
    names = F.broadcast(names) if n <= SMALL_ROWS else names
    return kept.join(names, "at").join(names.select(F.col("item").alias("other"), F.col("at").alias("other_at")), "other_at").select("item", "other", "score")


def numbered(items: DataFrame) -> tuple[DataFrame, int, int]:
    """Items with ``at``, their number from 0 in order; how many there are, and the sum of their ``n``."""
    placed = cut(items.orderBy("item").withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("items"), F.sum("n").alias("n")).orderBy("part").collect()
    before = np.cumsum([0] + [r["items"] for r in sizes]).tolist()
    starts = items.sparkSession.createDataFrame([(r["part"], b) for r, b in zip(sizes, before)], "part bigint, before bigint")
    at = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("part", part).join(F.broadcast(starts), "part").select("item", "norm", at.alias("at")), before[-1], sum(r["n"] for r in sizes)


def theil_sen(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """``keys, slope``: the median of the slopes between all points of a series.

    Series are short (a point a period); pairs arise by an equi-join on the series.
    """
    a = df.select(*keys, F.col(x).cast("double").alias("xa"), F.col(y).cast("double").alias("ya"))
    b = df.select(*keys, F.col(x).cast("double").alias("xb"), F.col(y).cast("double").alias("yb"))
    pairs = a.join(b, keys).where("xa < xb")
    return pairs.groupBy(*keys).agg(F.median((F.col("yb") - F.col("ya")) / (F.col("xb") - F.col("xa"))).alias("slope"))


def holt_winters(values: np.ndarray, season: int, horizon: int, alpha: float = 0.3, beta: float = 0.05, gamma: float = 0.2) -> np.ndarray:
    """Additive Holt-Winters forecasts of one series; shorter than two seasons it repeats the mean."""
    if len(values) < 2 * season:
        return np.full(horizon, values.mean() if len(values) else np.nan)
    level = values[:season].mean()
    trend = (values[season : 2 * season].mean() - level) / season
    cycle = list(values[:season] - level)
    for i, v in enumerate(values):
        s = cycle[i % season]
        last = level
        level = alpha * (v - s) + (1 - alpha) * (level + trend)
        trend = beta * (level - last) + (1 - beta) * trend
        cycle[i % season] = gamma * (v - level) + (1 - gamma) * s
    n = len(values)
    return np.array([level + (h + 1) * trend + cycle[(n + h) % season] for h in range(horizon)])


def forecast(df: DataFrame, key: str, date: str, value: str, season: int, horizon: int) -> DataFrame:
    """``key, step, forecast`` of every series; one series is one group, a point a period."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = holt_winters(pdf.sort_values("date")["value"].to_numpy(float), season, horizon)
        return pd.DataFrame({"key": pdf["key"].iloc[0], "step": np.arange(1, horizon + 1), "forecast": out})

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(date).alias("date"), F.col(value).alias("value")).groupBy("key").applyInPandas(run, f"key {kind}, step int, forecast double")


def two_way_demean(df: DataFrame, unit: str, time: str, value: str) -> DataFrame:
    """Rows with ``demeaned``: less the unit's and the time's mean, plus the mean of all.

    Means are aggregated and joined back, so no unit or time is one task's.
    """
    u = df.groupBy(unit).agg(F.avg(value).alias("u_"))
    t = df.groupBy(time).agg(F.avg(value).alias("t_"))
    g = df.agg(F.avg(value).alias("g_"))
    return df.join(u, unit).join(t, time).join(F.broadcast(g)).withColumn("demeaned", F.col(value) - F.col("u_") - F.col("t_") + F.col("g_")).drop("u_", "t_", "g_")


def naive_baselines(df: DataFrame, label: Column, rule: Column) -> DataFrame:
    """``majority, one_rule``: accuracies of always the larger class and of one rule."""
    y = label.cast("int")
    return df.agg(F.greatest(F.avg(y.cast("double")), 1 - F.avg(y.cast("double"))).alias("majority"), F.avg((label == rule).cast("double")).alias("one_rule"))


def undersample(df: DataFrame, label: str, key: str, ratio: float = 1.0) -> DataFrame:
    """Rows of the larger classes thinned by a hash of the key to ``ratio`` times the smallest."""
    n = df.groupBy(label).agg(F.count("*").alias("n_"))
    share = n.join(F.broadcast(n.agg(F.min("n_").alias("least_")))).select(label, F.least(F.lit(1.0), ratio * F.col("least_") / F.col("n_")).alias("share_"))
    unit = (F.pmod(F.xxhash64(key), F.lit(1 << 30)) / F.lit(float(1 << 30))).alias("u")
    return df.join(F.broadcast(share), label).where(unit < F.col("share_")).drop("share_")


def principal_components(df: DataFrame, vector: str, k: int) -> DataFrame:
    """``component, variance, direction`` of the ``k`` directions of largest variance, as shares of all variance.

    Covariances are summed by Spark; the driver solves a matrix of the vectors' dimension.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    usable = df.where(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x)))
    fitted = PCA(k=k, inputCol="v_", outputCol="p_").fit(usable.select(array_to_vector(F.col(vector).cast("array<double>")).alias("v_")))
    rows = [(i, float(fitted.explainedVariance[i]), fitted.pc.toArray()[:, i].tolist()) for i in range(k)]
    return df.sparkSession.createDataFrame(rows, "component int, variance double, direction array<double>")


def recommend(ratings: DataFrame, similar: DataFrame, user: str, item: str, rating: str, n: int) -> DataFrame:
    """``user, rank, item, score, because``: the ``n`` items a user hasn't rated that are most like those rated.

    The score sums the similarity to each rated item times its rating; only positive scores count. An item
    rated 0 or less is rated, too. Ranks go by the score to nine decimals, ties to the smaller item; the
    score itself isn't rounded.
    ``because`` is the rated item that adds most, ties to the smaller. ``similar`` is what
    :func:`item_similarity` gives; items meet on an equi-join, so users without a similar item have no rows.
    """
    own = ratings.groupBy(F.col(user).alias("user"), F.col(item).alias("rated")).agg(F.avg(rating).alias("r"))
    met = own.join(similar.select(F.col("item").alias("rated"), F.col("other").alias("item"), "score"), "rated").withColumn("adds", F.col("r") * F.col("score"))
    scored = met.groupBy("user", "item").agg(F.sum("adds").alias("score"), F.max_by("rated", F.struct("adds", -F.col("rated"))).alias("because")).where("score > 0")
    fresh = scored.join(own.select("user", F.col("rated").alias("item")), ["user", "item"], "left_anti")
    best = Window.partitionBy("user").orderBy(F.desc(F.round("score", 9)), "item")
    return fresh.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n).select("user", "rank", "item", "score", "because")
