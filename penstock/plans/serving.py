"""The read model, kept up to date run by run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penstock import schema
from penstock.operators import metrics
from penstock.sources import tables
from penstock.streaming.idtable import IdTable

ATTEMPTS = "id STRING, event_id STRING, destination_id STRING, status STRING, attempt_number INT, error STRING, attempted_at TIMESTAMP"


@dataclass(frozen=True)
class Serving:
    """Events, delivery attempts and the model built from them, all under `root` and cut by the day of the event.

    A run writes folders of its own number and overwrites them when it runs again.
    """

    root: str
    buckets: int = 32

    @property
    def ids(self) -> IdTable:
        """Event ids with the time of the event, which says what day an attempt belongs to."""
        return IdTable(f"{self.root}/ids", self.buckets)

    def events(self, spark: SparkSession, days: list | None = None) -> DataFrame:
        rows = spark.read.schema(f"{schema.STORE}, run INT, received_date DATE").parquet(f"{self.root}/events")
        return rows if days is None else rows.filter(F.col("received_date").isin(days))

    def attempts(self, spark: SparkSession, days: list | None = None) -> DataFrame:
        rows = spark.read.schema(f"{ATTEMPTS}, run INT, day DATE").parquet(f"{self.root}/attempts")
        return rows if days is None else rows.filter(F.col("day").isin(days))

    def model(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.root}/model")

    def rebuilt(self, spark: SparkSession, days: list, workspaces: DataFrame) -> DataFrame:
        """The model's rows of some days, from events and attempts of these days alone."""
        return metrics.read_model(self.events(spark, days), self.attempts(spark, days), workspaces)

    def run(self, number: int, events: DataFrame, attempts: DataFrame, workspaces: DataFrame) -> list:
        """Take in a run's events and attempts; returns the days whose rows were replaced.

        A day changes when an event of it arrives, however late, or an attempt for one of its events.
        Attempts that come before their event wait for it. People are counted distinct, so a day is
        computed anew from its own rows rather than patched.
        """
        spark = events.sparkSession
        tables.append_events(events.select(*schema.STORE_COLUMNS), f"{self.root}/events/run={number}", mode="overwrite")
        of_run = spark.read.schema(f"{schema.STORE}, received_date DATE").parquet(f"{self.root}/events/run={number}")
        self.ids.add(of_run.select("event_id", F.unix_micros("received_at").alias("first_us")), number)

        given = attempts.select(*[c.split()[0] for c in ATTEMPTS.split(", ")])
        if number:
            given = given.unionByName(spark.read.schema(ATTEMPTS).parquet(f"{self.root}/waiting/run={number - 1}"))
        at = self.ids.find(given, number + 1)
        placed = given.join(at, "event_id", "left").withColumn("day", F.to_date(F.timestamp_micros("first_us")))
        placed.filter("day IS NULL").drop("first_us", "day").write.mode("overwrite").parquet(f"{self.root}/waiting/run={number}")
        known = placed.filter("day IS NOT NULL").drop("first_us")
        known.hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(f"{self.root}/attempts/run={number}")

        of_attempts = spark.read.schema(f"{ATTEMPTS}, day DATE").parquet(f"{self.root}/attempts/run={number}")
        changed = of_run.select(F.col("received_date").alias("day")).union(of_attempts.select("day")).distinct()
        days = sorted(r.day for r in changed.collect())
        if days:
            tables.write_read_model(self.rebuilt(spark, days, workspaces), f"{self.root}/model")
        return days
