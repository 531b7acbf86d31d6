"""Classifiers over feature columns: boosted trees, cross-validated leaderboards, importances, risk bands."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.operators.models import folds

#: Rows of about so many keys trade values with each other when a feature is shuffled.
SHUFFLE_ROWS = 4096


def boosted_trees(features: list[str], label: str, rounds: int = 10, depth: int = 3, seed: int = 0) -> Pipeline:
    """Gradient-boosted trees over the feature columns; rows with a null feature are skipped."""
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features_", handleInvalid="skip"), GBTClassifier(featuresCol="features_", labelCol=label, maxIter=rounds, maxDepth=depth, seed=seed)])


def scaled_logistic(features: list[str], label: str, penalty: float = 0.01) -> Pipeline:
    """Logistic regression over standardised feature columns; rows with a null feature are skipped."""
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="raw_", handleInvalid="skip"), StandardScaler(inputCol="raw_", outputCol="features_", withMean=True), LogisticRegression(featuresCol="features_", labelCol=label, regParam=penalty)])


def auc(scored: DataFrame, label: str, score: str = "rawPrediction") -> float:
    return BinaryClassificationEvaluator(labelCol=label, rawPredictionCol=score).evaluate(scored)


def leaderboard(df: DataFrame, label: str, key: str, models: dict[str, Pipeline], k: int = 5, seed: int = 0) -> DataFrame:
    """``model, folds, mean_auc, std_auc, rank`` of every model over stratified folds.

    Labels are 0 and 1. Every model sees the same folds. ``prior``, one score for all rows, is
    always on the board. Where the rows in or outside of a fold are all of one label no order can
    be told, and every model has 0.5 there. Rows are ranked by the mean, ties by name.
    """
    dealt = folds(df, label, key, k, seed).persist()
    found: dict[str, list[float]] = {name: [] for name in ["prior", *models]}
    counts = {(r["fold"], r["y"]): r["count"] for r in dealt.groupBy("fold", F.col(label).cast("int").alias("y")).count().collect()}
    for fold in range(k):
        train, held = dealt.where(F.col("fold") != fold), dealt.where(F.col("fold") == fold)
        told = all(counts.get((fold, y)) and any(f != fold for f, z in counts if z == y) for y in (0, 1))
        found["prior"].append(0.5)
        for name, model in models.items():
            found[name].append(auc(model.fit(train).transform(held), label) if told else 0.5)
    dealt.unpersist()
    mean = {name: math.fsum(x) / k for name, x in found.items()}
    board = sorted(found, key=lambda name: (-mean[name], name))
    rows = [(name, k, mean[name], math.sqrt(math.fsum((x - mean[name]) ** 2 for x in found[name]) / k), i) for i, name in enumerate(board, 1)]
    return df.sparkSession.createDataFrame(rows, "model string, folds int, mean_auc double, std_auc double, rank int")


def shuffled(df: DataFrame, column: str, key: str, seed: int = 0) -> DataFrame:
    """Rows with the values of one column dealt anew among rows of the same bucket of keys.

    Every value occurs as often as before. Buckets hold about ``SHUFFLE_ROWS`` rows, so none is one
    task's table; keys tell rows apart.
    """
    bucket = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 + df.count() // SHUFFLE_ROWS))
    giver = Window.partitionBy("bucket_").orderBy(F.xxhash64(F.lit(seed + 1), "key_"), "key_")
    taker = Window.partitionBy("bucket_").orderBy(F.xxhash64(F.lit(seed + 2), key), key)
    values = df.select(bucket.alias("bucket_"), F.col(key).alias("key_"), F.col(column).alias("value_")).withColumn("place_", F.row_number().over(giver)).drop("key_")
    placed = df.withColumn("bucket_", bucket).withColumn("place_", F.row_number().over(taker))
    return placed.join(values, ["bucket_", "place_"]).withColumn(column, F.col("value_")).drop("bucket_", "place_", "value_")


def importances(df: DataFrame, features: list[str], label: str, key: str, held: Column, seed: int = 0) -> DataFrame:
    """``feature, impurity, permutation, consensus``: how much boosted trees lean on each feature.

    ``impurity`` is the trees' own share; ``permutation`` is the loss of AUC on the ``held`` rows
    when the feature is shuffled; ``consensus`` ranks features by the mean of their two ranks, ties
    by name.
    """
    kept = df.where(held).persist()
    model = boosted_trees(features, label, seed=seed).fit(df.where(~held))
    whole = auc(model.transform(kept), label)
    own = model.stages[-1].featureImportances.toArray().tolist()
    lost = [whole - auc(model.transform(shuffled(kept, f, key, seed)), label) for f in features]
    kept.unpersist()

    def places(x: list[float]) -> list[int]:
        return [sum(other > mine for other in x) for mine in x]

    mean = [a + b for a, b in zip(places(own), places(lost))]
    order = sorted(range(len(features)), key=lambda i: (mean[i], features[i]))
    rows = [(features[i], own[i], lost[i], rank) for rank, i in enumerate(order, 1)]
    return df.sparkSession.createDataFrame(rows, "feature string, impurity double, permutation double, consensus int")


def risk_band(score: Column, low: float = 0.3, high: float = 0.6) -> Column:
    """``low``, ``medium`` or ``high`` by two thresholds, each part of the band above it; null stays null."""
    return F.when(score >= high, "high").when(score >= low, "medium").when(score < low, "low")
