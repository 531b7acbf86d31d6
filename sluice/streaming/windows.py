"""Event-time windows: batch, exact late accounting, and Structured Streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.core.session import shared_dir


def windowed(df: DataFrame, ts: str, key: str, value: str, size: str, slide: str | None = None) -> DataFrame:
    """``key, begins, ends, n, total``: tumbling windows, or sliding ones with ``slide`` no longer than ``size``."""
    w = F.window(F.col(ts), size, slide or size)
    out = df.groupBy(w.alias("w"), F.col(key).alias("key")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select("key", F.col("w.start").alias("begins"), F.col("w.end").alias("ends"), "n", "total")


def running_max(df: DataFrame, order: str, value: str, name: str, buckets: int = 64) -> DataFrame:
    """Adds the largest ``value`` up to each row in ``order``, without one task for all rows.

    Ranges of the order run their own maxima; the ranges' maxima, a few rows, are run over after.
    """
    edges = df.agg(F.percentile_approx(order, [i / buckets for i in range(1, buckets)], 1000).alias("edges_"))
    dealt = df.join(F.broadcast(edges)).withColumn("bucket_", F.size(F.filter(F.array_distinct("edges_"), lambda e: e < F.col(order)))).drop("edges_")
    tops = dealt.groupBy("bucket_").agg(F.max(value).alias("top_"))
    before = tops.select("bucket_", F.max("top_").over(Window.partitionBy(F.lit(0)).orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)).alias("before_"))
    within = Window.partitionBy("bucket_").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.withColumn("local_", F.max(value).over(within))
    return local.join(F.broadcast(before), "bucket_").withColumn(name, F.greatest("local_", "before_")).drop("bucket_", "local_", "before_")


def late_accounting(df: DataFrame, arrival: str, seconds: str, size: int, slide: int, lateness: int) -> DataFrame:
    """One row ``events, windowed, late``: what a watermark that every event advances would drop.

    Events come in ``arrival`` order; the watermark is the largest time so far less the lateness. A
    window takes an event unless it ended at or before the watermark; an event that no window takes
    is late. For tumbling windows, windowed and late events add up to all.
    """
    if slide > size:
        raise ValueError("a slide longer than the window leaves gaps")
    marked = running_max(df.select(arrival, F.col(seconds).alias("s")), arrival, "s", "high").withColumn("mark", F.col("high") - lateness)
    first = F.floor(F.col("s") / slide) * slide
    open_ = F.size(F.filter(F.transform(F.sequence(F.lit(0), F.lit((size - 1) // slide)), lambda i: first - i * slide), lambda b: (b + size > F.col("mark")) & (b + size > F.col("s"))))
    return marked.agg(F.count("*").alias("events"), F.coalesce(F.sum(open_), F.lit(0)).cast("long").alias("windowed"), F.count_if(open_ == 0).alias("late"))


def stream_windows(spark: SparkSession, folder: str, pattern: str, schema, ts: str, key: str, value: str, size: str, lateness: str, slide: str | None = None) -> DataFrame:
    """Run the windows as a stream over files and return what it appended: windows that the watermark closed.

    State lives in the checkpointed store and leaves it as windows close; both the checkpoint and
    the appended Parquet stand in the shared folder, so a lost executor or driver can go on.
    """
    home = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder).withColumn(ts, F.col(ts).cast("timestamp"))
    out = windowed(events.withWatermark(ts, lateness), ts, key, value, size, slide)
    run = out.writeStream.outputMode("append").format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{home}/out")


def overdue(pings: DataFrame, jobs: DataFrame, job: str, ts: str, now: str) -> DataFrame:
    """``job, last, deadline`` of jobs whose last heartbeat is older than their interval and grace, in seconds.

    A job that never pinged is overdue without a deadline.
    """
    last = pings.groupBy(F.col(job).alias("job")).agg(F.max(F.col(ts).cast("timestamp")).alias("last"))
    due = jobs.join(last, "job", "left").withColumn("deadline", F.timestamp_seconds(F.unix_timestamp("last") + F.col("interval") + F.col("grace")))
    return due.where(F.col("last").isNull() | (F.col("deadline") < F.lit(now).cast("timestamp"))).select("job", "last", "deadline")
