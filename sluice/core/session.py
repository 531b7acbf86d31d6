"""Session settings and table loading."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for one machine; a cluster passes its own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sluice")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SLUICE_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver tables as a DataFrame (Parquet, pruned and pushed down by Catalyst)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only on one machine (tests) a temporary folder is set where the session names none; a cluster
    without one is an error, as its machines share no local folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rsplit("/", 1)[0]
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    made = "file://" + tempfile.mkdtemp(prefix="sluice-")
    spark.sparkContext.setCheckpointDir(made)
    return made


#: Rows of a small table that may be broadcast, once they have been counted.
SMALL_ROWS = 400_000


#: Bytes of an Arrow batch of whole texts, unless the session names another number.
BATCH_BYTES = "4m"


def small_batches(spark: SparkSession) -> None:
    """Hand whole texts to Python in Arrow batches of ``BATCH_BYTES``, from here on in this session.

    Spark's own bounds are 10,000 rows and 64 MB, which a task holds in the JVM and in Python at once. A
    session that has set the bound keeps it.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, spark.conf.get(key, BATCH_BYTES))


def counted_small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """A table computed once, with a hint to broadcast it only where it was counted to have ``most`` rows or fewer."""
    df = cut(df)
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
