"""A training corpus in five stages: language, toxicity, near-duplicates, mixture, tokens.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the one before it kept; all but
the last return the columns of ``documents``. A cluster writes each result as Parquet and reads it
again; ``run`` does so in the folder of ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.core.session import shared_dir, small_batches, table
from sluice.llm import langid, mixing, pieces, shingles, simhash, toxicity
from sluice.llm.common import fold
from sluice.llm.registry import PIECES

#: Below this score no language stands out and the text is rejected.
LEAST_LANGUAGE = 0.3


def _rows(docs: DataFrame) -> DataFrame:
    """``row, text``: whole rows stand in for ids, so that verdicts hold for rows and not for ids."""
    return docs.select(F.struct(*docs.columns).alias("row"), "text")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters and those that no learned language fits."""
    small_batches(spark)
    model = langid.train(docs.where(fold(F.col("doc_id"), 5) != 0))
    found = langid.predict(_rows(docs), model, "row")
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE)).select("doc_id.*")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents predicted toxic; labels of the held-out fold are not learned from."""
    small_batches(spark)
    labels = table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(fold(F.col("doc_id"), 4) != 2), docs)
    return toxicity.score(_rows(docs), model, "row").where("predicted = 0").select("doc_id.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate component, that of the smallest id.

    Links are fingerprints of three bits or fewer apart, as ``op9_simhash`` finds them, and five-word
    shingle sets of similarity 0.8 or more, which fingerprints that close seldom meet. Rows that
    share an id but no text are judged on their own; rows without an id stay only where no row of
    their component has one; of rows alike in id and text one stays.
    """
    small_batches(spark)
    keyed = simhash.row_keys(docs)
    found = shingles.merged(simhash.near_duplicates(keyed, "key"), shingles.components(keyed, "key"))
    return simhash.firsts(keyed, found)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that the sources meet their target weights, row by row."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document taken, with its language and source."""
    small_batches(spark)
    coded = pieces.encode(docs.withColumn("doc_id", F.struct("doc_id", "lang", "source")), pieces.load(PIECES))
    return coded.select("doc_id.*", "n_ids", "n_bytes", "round_trip", "ids")


STAGES = [
    ("language", language),
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: The learned stages have no SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    home = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        at = os.path.join(home, name)
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
