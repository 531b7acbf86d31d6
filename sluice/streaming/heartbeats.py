"""Heartbeats of jobs as a stream: an alert for each time a job falls silent.

Every job has its state in the checkpointed store: its limit (interval and grace) and the pings whose
deadline hasn't passed. One event-time timer stands at the first deadline. When the watermark has
passed it, every ping that was due and had no successor in time gives one alert, so a job alerts once
a gap and is quiet until it pings again, in whatever order pings came within the lateness.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sluice.core.session import shared_dir

ALERT = "job long, last timestamp, deadline timestamp"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def gaps(pings: list[int], limit: int, watermark: int) -> tuple[list[int], list[int]]:
    """Of sorted distinct pings, those that were due by the watermark without a successor in time; and the ones not due yet."""
    alerts, i = [], 0
    while i < len(pings) and pings[i] + limit <= watermark:
        if i + 1 == len(pings) or pings[i + 1] > pings[i] + limit:
            alerts.append(pings[i])
        i += 1
    return alerts, pings[i:]


class _Silence(StatefulProcessor):
    """Times are microseconds; timers and watermarks, whole milliseconds, come after the deadline."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("pings", "limit long, due long, pings array<long>")

    def _step(self, key: tuple, limit: int, due: int, pings: list[int], watermark: int) -> pd.DataFrame:
        alerts, left = gaps(pings, limit, watermark * 1000)
        now = (left[0] + limit + 999) // 1000 if left else -1
        if now != due:
            if due >= 0:
                self.handle.deleteTimer(due)
            if left:
                self.handle.registerTimer(now)
        if left:
            self.state.update((limit, now, left))
        else:
            self.state.clear()
        times = [pd.to_datetime([t + k for t in alerts], unit="us") for k in (0, limit)]
        return pd.DataFrame({"job": [key[0]] * len(alerts), "last": times[0], "deadline": times[1]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.state.get() if self.state.exists() else None
        new, limit = set(known[2]) if known else set(), known[0] if known else 0
        for part in rows:
            new.update(part["at"].tolist())
            limit = int(part["limit"].max())
        yield self._step(key, limit, known[1] if known else -1, sorted(new), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            limit, due, pings = self.state.get()
            # The timer that expired is gone; what is left gets its own.
            yield self._step(key, limit, -1 if due == expiredTimerInfo.getExpiryTimeInMs() else due, list(pings), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def silences(pings: DataFrame, job: str, ts: str, limit_seconds, lateness: str) -> DataFrame:
    """``job, last, deadline`` of a stream of pings: each time that a job didn't ping for its limit.

    ``limit_seconds`` is a column of the ping, its job's interval and grace. Pings later than the
    lateness are dropped by the watermark. Null jobs and times take no part; equal times are one ping.
    """
    rows = pings.where(F.col(job).isNotNull() & F.col(ts).isNotNull()).select(F.col(job).cast("long").alias("job"), F.col(ts).cast("timestamp").alias("ts"), (limit_seconds * 1_000_000).cast("long").alias("limit"))
    marked = rows.withWatermark("ts", lateness).withColumn("at", F.unix_micros("ts"))
    return marked.groupBy("job").transformWithStateInPandas(_Silence(), outputStructType=ALERT, outputMode="append", timeMode="EventTime")


def run_silences(spark: SparkSession, folder: str, schema, job: str, ts: str, limit_seconds, lateness: str, pattern: str = "*.parquet", home: str | None = None) -> DataFrame:
    """The alerts of all files of a folder, as far as the watermark got. The same ``home`` goes on where the last run ended.

    State and written alerts stand in the shared folder; a batch that was cut off is done again and
    its files replaced, so no alert is lost or doubled.
    """
    home = home or f"{shared_dir(spark)}/heartbeats-{uuid.uuid4().hex}"
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)
    try:
        pings = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
        out = silences(pings, job, ts, limit_seconds, lateness)
        run = out.writeStream.outputMode("append").format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.set(_STORE, before)
    return spark.read.schema(ALERT).parquet(f"{home}/out")
