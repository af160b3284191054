"""Reads of the event store: counts, latest events, traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from penstock.operators.skew import previous_in_slices


def event_counts(store: DataFrame) -> DataFrame:
    return store.groupBy("workspace_id", "event_name").agg(F.count(F.lit(1)).alias("n"))


def latest_events(store: DataFrame, n: int) -> DataFrame:
    """The newest `n` events of every workspace; each input task keeps at most `n` per workspace."""
    newest = Window.partitionBy("workspace_id").orderBy(F.col("received_at").desc(), F.col("event_id"))
    return store.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= n)


def correlation_trace(store: DataFrame, correlation_id: str | None = None) -> DataFrame:
    """Events of one correlation id, or of all, with the gap in ms to the event before.

    The store is read once, into slices of equal size, so an id with all its events in one
    hour is traced by many tasks.
    """
    rows = store if correlation_id is None else store.filter(F.col("correlation_id") == correlation_id)
    at = F.unix_millis("received_at")
    traced = previous_in_slices(rows, ["correlation_id"], ["received_at", "event_id"], at, "_before")
    return traced.withColumn("gap_ms", at - F.col("_before")).drop("_before")
