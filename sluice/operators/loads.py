"""Loads in increments: a target table, its watermark and its log, changed together or not at all.

The target lies in buckets by a hash of its key. A load reads the rows beyond the stored watermark,
merges them into the buckets that they touch, writes these under new names, and then commits one
small record: the watermark, which files make up each bucket, and what was done. The record's name is
its number and it is put there only if no other is, so of two loads one fails and a load that dies at
any point before has changed nothing; done again, it does the same. Readers go by the last record.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.core.session import cut


@dataclass
class Record:
    """What a load left: ``files`` names the folder of each bucket, ``batch`` the last batch of a stream."""

    number: int = 0
    watermark: str | None = None
    batch: int = -1
    files: dict[str, str] = field(default_factory=dict)
    extracted: int = 0
    inserted: int = 0
    updated: int = 0
    deleted: int = 0


class Target:
    """A table in ``home``, a folder that driver and executors share, with rows by a unique key.

    ``watermark`` is a column that grows with each change of a row, ``deleted`` one that marks a
    removed row. Columns are those of ``schema``, tombstones' mark included.
    """

    def __init__(self, spark: SparkSession, home: str, schema, key: str, watermark: str, deleted: str | None = None, buckets: int = 16):
        self.spark, self.home, self.key, self.watermark, self.deleted, self.buckets = spark, home, key, watermark, deleted, buckets
        self.schema = spark.createDataFrame([], schema).schema
        self.jvm = spark._jvm
        self.fs = self._path(home).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def records(self) -> list[Record]:
        """All loads in order: the sync log."""
        folder = self._path(f"{self.home}/log")
        if not self.fs.exists(folder):
            return []
        names = sorted(s.getPath().toString() for s in self.fs.listStatus(folder) if s.getPath().getName().endswith(".json"))
        lines = self.spark.read.text(names, wholetext=True).collect() if names else []
        return sorted((Record(**json.loads(r[0])) for r in lines), key=lambda r: r.number)

    def last(self) -> Record:
        found = self.records()
        return found[-1] if found else Record()

    def read(self, record: Record | None = None) -> DataFrame:
        """The rows as of a record, the last if none is given."""
        record = record or self.last()
        folders = [f"{self.home}/{f}" for f in sorted(record.files.values())]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _commit(self, record: Record) -> None:
        """Put the record there under its number, unless another load has taken it."""
        part, place = self._path(f"{self.home}/log/.{uuid.uuid4().hex}"), self._path(f"{self.home}/log/{record.number:08d}.json")
        out = self.fs.create(part, False)
        out.write(bytearray(json.dumps(asdict(record)).encode()))
        out.close()
        if self.fs.exists(place) or not self.fs.rename(part, place):
            self.fs.delete(part, False)
            raise RuntimeError(f"load {record.number} was committed by another run")

    def load(self, source: DataFrame, batch: int | None = None, stop_before_commit: bool = False) -> Record:
        """Merge the rows of ``source`` beyond the stored watermark; the last record if there are none.

        Of several rows of a key the one of the largest watermark counts, ties by its other columns.
        A null watermark is beyond none, a null key is no row's. Tombstones remove their key. A batch
        that the log has is not loaded again; rows of a stream's batch are taken as they come, since
        the batch number keeps them from being taken twice.
        """
        before = self.last()
        if batch is not None and batch <= before.batch:
            return before
        rows = source.where(F.col(self.key).isNotNull() & F.col(self.watermark).isNotNull()).select(*self.schema.names)
        if batch is None and before.watermark is not None:
            rows = rows.where(F.col(self.watermark) > F.lit(before.watermark).cast(self.schema[self.watermark].dataType))
        newest = Window.partitionBy(self.key).orderBy(F.desc(self.watermark), *[F.desc(c) for c in self.schema.names])
        latest = cut(rows.withColumn("at_", F.row_number().over(newest)).where("at_ = 1").drop("at_").withColumn("bucket_", self._bucket()))
        extracted = rows.count()
        if not extracted:
            return before
        touched = {str(r[0]) for r in latest.select("bucket_").distinct().collect()}
        old = self.read(Record(files={b: f for b, f in before.files.items() if b in touched}))
        gone = F.coalesce(F.col(self.deleted).cast("boolean"), F.lit(False)) if self.deleted else F.lit(False)
        marked = latest.withColumn("gone_", gone).join(old.select(F.col(self.key), F.col(self.watermark).alias("old_"), F.lit(True).alias("known_")), self.key, "left")
        # A row that came late changes nothing.
        marked = cut(marked.where(F.col("old_").isNull() | (F.col(self.watermark) >= F.col("old_"))))
        counts = marked.agg(*[F.count_if(c).alias(n) for n, c in (("inserted", ~F.col("gone_") & F.col("known_").isNull()), ("updated", ~F.col("gone_") & F.col("known_").isNotNull()), ("deleted", F.col("gone_") & F.col("known_").isNotNull()))]).first()
        kept = old.withColumn("bucket_", self._bucket()).join(marked.select(self.key), self.key, "left_anti")
        merged = kept.unionByName(marked.where("not gone_").select(*self.schema.names, "bucket_"))
        number, name = before.number + 1, uuid.uuid4().hex
        merged.repartition("bucket_").write.partitionBy("bucket_").parquet(f"{self.home}/data/{number:08d}-{name}")
        made = {str(r[0]) for r in merged.select("bucket_").distinct().collect()}
        files = {b: f for b, f in before.files.items() if b not in touched} | {b: f"data/{number:08d}-{name}/bucket_={b}" for b in made}
        # The source's watermark, whatever became of its rows; never back.
        high = latest.agg(F.max(self.watermark).cast("string")).first()[0]
        high = max(high, before.watermark, key=lambda w: self._order(w)) if before.watermark is not None else high
        record = Record(number, high, before.batch if batch is None else batch, files, extracted, **counts.asDict())
        if stop_before_commit:
            raise InterruptedError("stopped before the commit")
        self._commit(record)
        return record

    def _order(self, watermark: str):
        return self.spark.range(1).select(F.lit(watermark).cast(self.schema[self.watermark].dataType)).first()[0]

    def load_stream(self, folder: str, pattern: str = "*.parquet", files_at_once: int = 1) -> Record:
        """Load all files of a folder that weren't yet, as the batches of a stream; each batch once."""
        stream = self.spark.readStream.schema(self.schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_at_once).parquet(folder)
        run = stream.writeStream.foreachBatch(lambda rows, batch: self.load(rows, batch)).option("checkpointLocation", f"{self.home}/stream").trigger(availableNow=True).start()
        run.awaitTermination()
        return self.last()

    def log(self) -> DataFrame:
        """``number, watermark, batch, extracted, inserted, updated, deleted`` of every load."""
        rows = [(r.number, r.watermark, r.batch, r.extracted, r.inserted, r.updated, r.deleted) for r in self.records()]
        return self.spark.createDataFrame(rows, "number int, watermark string, batch long, extracted long, inserted long, updated long, deleted long")
