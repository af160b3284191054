"""The ids of everything accepted, cut by hash buckets, for look-ups whose cost follows the batch.

A batch writes its ids as a run of its own, bucket by bucket. Every `fan` runs of one
level are merged into one of the next, so an id is rewritten once per level and a
look-up opens few runs. Which runs hold the ids before a batch follows from the batch's number
alone, so a batch that runs again after a failure reads what it read before. Merged runs
are removed when the batch after has begun, for by then the merge is committed.

With `keep_us`, merges leave out ids that are older than that by the newest one: for
queues, whose messages expire, the table stops growing.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = "event_id STRING, first_us BIGINT"


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


@dataclass(frozen=True)
class IdTable:
    """`event_id` with its first arrival in microseconds, under `root`."""

    root: str
    buckets: int = 32
    fan: int = 8
    keep_us: int | None = None

    def bucket(self, event_id: Column | str) -> Column:
        return F.pmod(F.xxhash64(event_id), F.lit(self.buckets)).cast("int")

    def path(self, level: int, run: int) -> str:
        return f"{self.root}/level={level}/run={run}"

    def runs(self, batch: int) -> list[tuple[int, int]]:
        """Levels and numbers of the runs that hold the ids of all batches before `batch`."""
        out, level, done = [], 0, batch
        while done:
            # of each level, the runs that no run of the next level covers
            out += [(level, run) for run in range(done // self.fan * self.fan, done)]
            level, done = level + 1, done // self.fan
        return out

    def read(self, spark: SparkSession, batch: int) -> DataFrame:
        """All ids of the batches before `batch`, with their buckets."""
        rows = [spark.read.schema(f"{COLUMNS}, bucket INT").parquet(self.path(level, run)) for level, run in self.runs(batch)]
        return reduce(DataFrame.unionByName, rows) if rows else spark.createDataFrame([], f"{COLUMNS}, bucket INT")

    def touched(self, wanted: DataFrame, batch: int) -> DataFrame:
        """What a look-up of the `wanted` ids reads: the buckets they fall into, and no others."""
        spark = wanted.sparkSession
        if not self.runs(batch):
            return self.read(spark, batch)
        numbers = [r[0] for r in wanted.select(self.bucket("event_id").alias("b")).distinct().collect()]
        return self.read(spark, batch).filter(F.col("bucket").isin(numbers))

    def find(self, wanted: DataFrame, batch: int) -> DataFrame:
        """event_id, first_us of the wanted ids that batches before `batch` stored."""
        known = self.touched(wanted, batch).select("event_id", "first_us")
        return known.join(wanted.select("event_id").distinct(), "event_id", "left_semi")

    def add(self, ids: DataFrame, batch: int) -> None:
        """Store the ids of a batch, and merge the runs that it completes."""
        self._forget(ids.sparkSession, batch)
        self._write(ids.select("event_id", "first_us", self.bucket("event_id").alias("bucket")), self.path(0, batch))
        spark, level, done = ids.sparkSession, 0, batch + 1
        while done % self.fan == 0:
            parts = [self.path(level, run) for run in range(done - self.fan, done)]
            level, done = level + 1, done // self.fan
            merged = spark.read.schema(f"{COLUMNS}, bucket INT").parquet(parts[0])
            for part in parts[1:]:
                merged = merged.unionByName(spark.read.schema(f"{COLUMNS}, bucket INT").parquet(part))
            if self.keep_us is not None:
                newest = merged.agg(F.max("first_us")).first()[0] or 0
                merged = merged.filter(F.col("first_us") >= newest - self.keep_us)
            self._write(merged, self.path(level, done - 1))

    @staticmethod
    def _write(rows: DataFrame, path: str) -> None:
        rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)

    def _forget(self, spark: SparkSession, batch: int) -> None:
        """Remove the runs that the batch before merged."""
        level, done = 0, batch
        while done and done % self.fan == 0:
            for run in range(done - self.fan, done):
                files, at = _folder(spark, self.path(level, run))
                files.delete(at, True)
            level, done = level + 1, done // self.fan


def claim(spark: SparkSession, root: str, checkpoint: str) -> None:
    """Tie an output folder to the checkpoint whose batch numbers name its parts.

    A fresh checkpoint counts from 0 again and would overwrite the parts of the
    earlier one, so a folder that another checkpoint has written is refused.
    """
    files, at = _folder(spark, f"{root}/_checkpoint")
    if files.exists(at):
        stream = files.open(at)
        try:
            owner = stream.readUTF()
        finally:
            stream.close()
        if owner != checkpoint:
            raise ValueError(f"{root} was written from checkpoint {owner}; resume that one or write elsewhere")
        return
    stream = files.create(at, False)
    try:
        stream.writeUTF(checkpoint)
    finally:
        stream.close()
