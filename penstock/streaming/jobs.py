"""Streaming jobs: the batch operators inside `foreachBatch`, with replayable writes.

Each micro-batch writes into a folder named by its number and overwrites it, so a
batch that runs again after a failure leaves one copy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.storagelevel import StorageLevel

from penstock import schema
from penstock.operators import delivery, ingest, requests, steps
from penstock.sources import queue, sinks
from penstock.streaming.idtable import IdTable, claim


def batch_path(root: str, table: str, batch: int) -> str:
    return f"{root}/{table}/batch={batch}"


def run_batches(
    stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Start a query that hands every micro-batch to `work`; with `once` it ends when caught up."""
    writer = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_batches(spark: SparkSession, root: str, table: str, columns: str, before: int | None = None) -> DataFrame:
    """Everything a job has written to a table, or what its batches before a given one wrote."""
    rows = spark.read.schema(f"{columns}, batch INT").option("ignoreMissingFiles", "true").parquet(f"{root}/{table}")
    return rows if before is None else rows.filter(F.col("batch") < before)


QUARANTINE = """
    batch_id STRING, pos INT, workspace_id STRING, arrived_at TIMESTAMP, status_code INT, error STRING,
    message ARRAY<STRING>, correlation_id STRING, errors ARRAY<STRUCT<field: STRING, message: STRING>>, raw STRING
"""


def ingest_batch(spark_batch: DataFrame, batch: int, root: str, ids: IdTable) -> None:
    """Validate, split, deduplicate against what earlier batches stored, and write all branches.

    The parsed and validated rows are kept for the two branches that read them. The
    ids stored so far are a narrow table cut by hash buckets; only the buckets of this
    batch's ids are read.
    """
    spark = spark_batch.sparkSession
    validated = requests.validate_events(requests.parse_raw_events(spark_batch))
    validated = validated.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        requests.quarantine_events(validated).write.mode("overwrite").parquet(batch_path(root, "quarantine", batch))
        rows = ingest.normalize_events(requests.valid_events(validated))
        rows.write.mode("overwrite").parquet(batch_path(root, "arrivals", batch))
    finally:
        validated.unpersist()
    arrived = spark.read.schema(rows.schema).parquet(batch_path(root, "arrivals", batch))
    labelled = labelled_batch(arrived, batch, root, ids, ingest.REQUEST_ORDER)
    accepted = labelled.filter(F.col("status") == "accepted")
    ingest.event_envelope(accepted).write.mode("overwrite").parquet(batch_path(root, "queue", batch))


def labelled_batch(arrived: DataFrame, batch: int, root: str, ids: IdTable, order: tuple[str, ...]) -> DataFrame:
    """Write the labels of a batch's arrivals, and make the ids it accepts known to later batches.

    Nothing is held between batches but the id table, of which only the buckets of this batch's ids are read.
    """
    store = ids.find(arrived, batch).select("event_id", F.timestamp_micros("first_us").alias("ingested_at"))
    labelled = ingest.dedupe_status(arrived, store if batch else None, order=order)
    labelled.write.mode("overwrite").parquet(batch_path(root, "labelled", batch))
    labelled = arrived.sparkSession.read.schema(labelled.schema).parquet(batch_path(root, "labelled", batch))
    ids.add(labelled.filter(F.col("status") == "accepted").select("event_id", F.unix_micros("arrived_at").alias("first_us")), batch)
    return labelled


def stream_ingest(stream: DataFrame, root: str, checkpoint: str, once: bool = True, buckets: int = 32) -> StreamingQuery:
    """Raw requests to quarantine, labelled arrivals, stored ids and queue messages.

    The more batches a day, the more `buckets` keep a look-up small. `root` belongs to one checkpoint.
    """
    claim(stream.sparkSession, root, checkpoint)
    ids = IdTable(f"{root}/ids", buckets)
    return run_batches(stream, lambda df, n: ingest_batch(df, n, root, ids), checkpoint, once)


def stream_labels(stream: DataFrame, root: str, checkpoint: str, once: bool = True, buckets: int = 32) -> StreamingQuery:
    """Arrivals (event_id, arrived_at, arrival_seq) to a table of labels, in three states.

    No state is kept in Spark: an id is a duplicate or a conflict by its entry in the id table, for
    ever, and nobody's clock decides when state may go. Input rows of a look-up follow the batch.
    """
    claim(stream.sparkSession, root, checkpoint)
    ids = IdTable(f"{root}/ids", buckets)

    def label(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(batch_path(root, "arrivals", batch))
        arrived = rows.sparkSession.read.schema(rows.schema).parquet(batch_path(root, "arrivals", batch))
        labelled_batch(arrived, batch, root, ids, ("arrived_at", "arrival_seq"))

    return run_batches(stream, label, checkpoint, once)


def consume_once(
    messages: DataFrame, work: Callable[[DataFrame, int], None], root: str, checkpoint: str, ttl_ms: int = schema.MESSAGE_TTL_MS, once: bool = True, buckets: int = 32
) -> StreamingQuery:
    """Hand each queue message to `work` once, in whatever batches its copies arrive.

    The ids of consumed messages are kept in an id table as long as a queue keeps a
    message, so neither state nor table grows without end. Copies within a batch and
    messages known before leave in one shuffle; what is left is written, and read by
    `work` and by the table.
    """
    claim(messages.sparkSession, root, checkpoint)
    ids = IdTable(f"{root}/ids", buckets, keep_us=2 * ttl_ms * 1000)

    def consume(rows: DataFrame, batch: int) -> None:
        known = ids.touched(queue.identified(rows).select(F.col("message_id").alias("event_id")), batch).select("event_id")
        fresh = queue.consumed_once(rows)
        fresh = fresh.join(known, fresh["message_id"] == known["event_id"], "left_anti")
        fresh.write.mode("overwrite").parquet(batch_path(root, "messages", batch))
        new = rows.sparkSession.read.schema(fresh.schema).parquet(batch_path(root, "messages", batch))
        work(new.select(*rows.columns), batch)
        ids.add(new.select(F.col("message_id").alias("event_id"), F.unix_micros("published_at").alias("first_us")), batch)

    return run_batches(messages, consume, checkpoint, once)


def pipeline_batch(
    batch_rows: DataFrame,
    batch: int,
    root: str,
    config: Callable[[], tuple[DataFrame, DataFrame, dict[str, steps.Enrichment]]],
    jdbc: dict[str, dict[str, str]] | None = None,
) -> None:
    """Trigger, steps and fan-out for one micro-batch; `config` is read again each time.

    Files and outbox are replaced when a batch runs again. A database append (`jdbc`) is not: the delivery's `id` is
    the same then, and a unique key on it in the target table is what keeps copies out.
    """
    spark = batch_rows.sparkSession
    pipelines, destinations, enrichments = config()
    typed = steps.typed_pipelines(pipelines, destinations)
    executed = steps.run_steps(batch_rows, typed, enrichments)
    executed = executed.drop("steps", "props")
    executed.write.mode("overwrite").parquet(batch_path(root, "executed", batch))
    executed = spark.read.schema(executed.schema).parquet(batch_path(root, "executed", batch))
    fanned = steps.destination_fanout(executed)
    steps.pipeline_executions(executed, F.col("received_at"), F.col("ingested_at")).write.mode("overwrite").parquet(
        batch_path(root, "executions", batch)
    )
    delivery.dead_letter(unmatched=steps.unknown_destinations(fanned)).write.mode("overwrite").parquet(
        batch_path(root, "dead_letters", batch)
    )
    sinks.write_deliveries(steps.deliveries(fanned), batch_path(root, "deliveries", batch), jdbc, mode="overwrite")


def stream_pipeline(
    stream: DataFrame, root: str, checkpoint: str, config, once: bool = True, jdbc: dict[str, dict[str, str]] | None = None
) -> StreamingQuery:
    """Stored events to executions, dead letters and deliveries by type."""
    claim(stream.sparkSession, root, checkpoint)
    return run_batches(stream, lambda df, n: pipeline_batch(df, n, root, config, jdbc), checkpoint, once)


def stream_throughput(
    stream: DataFrame, path: str, checkpoint: str, width: str, slide: str | None = None, lateness: str = "1 hour"
) -> StreamingQuery:
    """Counts per closed window, workspace and name; rows later than the watermark are left out."""
    counted = (
        stream.withWatermark("received_at", lateness)
        .groupBy(F.window("received_at", width, slide), "workspace_id", "event_name")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("bucket"), F.col("window.end").alias("bucket_end"), "workspace_id", "event_name", "n")
    )
    return (
        counted.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _closed(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    writer = rows.writeStream.format("parquet").outputMode("append").option("path", path)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_sessions(stream: DataFrame, path: str, checkpoint: str, gap: str = "30 minutes", idle: str = "24 hours", lateness: str = "1 hour") -> StreamingQuery:
    """Sessions that the watermark has closed: by session id where there is one, else by gaps per person.

    An event joins every open session it reaches, so a late one merges two. A session by id
    closes when the id was idle that long; if it comes again, its parts add up in
    `merged_sessions`. State holds open sessions only.
    """
    named = F.col("session_id").isNotNull()
    rows = stream.withWatermark("received_at", lateness).select(
        "workspace_id", F.when(named, "id").otherwise("gap").alias("kind"), F.coalesce("session_id", "user_id", "anonymous_id").alias("session"), "received_at",
        F.when(named, idle).otherwise(gap).alias("until"),
    )
    closed = rows.groupBy("workspace_id", "kind", "session", F.session_window("received_at", F.col("until")).alias("w")).agg(
        F.count(F.lit(1)).alias("events"), F.min("received_at").alias("started_at"), F.max("received_at").alias("ended_at")
    )
    return _closed(closed.drop("w"), path, checkpoint)


def merged_sessions(closed: DataFrame) -> DataFrame:
    """One row per session id of what `stream_sessions` has written; gap sessions stay as they are."""
    part = F.when(F.col("kind") == "gap", F.col("started_at"))
    return closed.groupBy("workspace_id", "kind", "session", part.alias("_part")).agg(
        F.sum("events").alias("events"), F.min("started_at").alias("started_at"), F.max("ended_at").alias("ended_at")
    ).drop("_part")


def stream_expiry(
    published: DataFrame, consumed: DataFrame, path: str, checkpoint: str, ttl_ms: int = schema.MESSAGE_TTL_MS, lag: str = "1 hour"
) -> StreamingQuery:
    """Messages that nobody took within `ttl_ms`, with their dead-letter routing key, as the watermark passes their time.

    Each published message waits in state until its time has come, or until its consumption
    (message_id, consumed_at) arrives, in either order. One that is consumed at `ttl_ms` to
    the millisecond is too late, as in the batch form. `lag` is how far the two feeds may run
    out of order; consumption may be stamped that much before publication.
    """
    waiting = published.withWatermark("published_at", lag)
    taken = consumed.select(F.col("message_id").alias("_taken"), "consumed_at").withWatermark("consumed_at", lag)
    life = F.expr(f"interval {ttl_ms} milliseconds")
    # to the millisecond, as the batch form compares
    inside = (F.col("_taken") == F.col("message_id")) & (F.col("consumed_at") < F.col("published_at") + life) & (F.col("consumed_at") >= F.col("published_at") - F.expr(f"interval {lag}"))
    left = waiting.join(taken, inside, "left_outer").filter(F.col("_taken").isNull()).drop("_taken", "consumed_at")
    expired = left.withColumn("routing_key", F.concat(F.lit("dead."), F.col("queue"))).withColumn("dead_at", F.col("published_at") + life)
    return _closed(expired, path, checkpoint)


def late_rows(store: DataFrame, closed: DataFrame, width: str) -> DataFrame:
    """Buckets where the stream counted fewer events than the store holds, and how many it missed."""
    key = ["bucket", "workspace_id", "event_name"]
    full = store.groupBy(F.window("received_at", width).start.alias("bucket"), "workspace_id", "event_name").agg(
        F.count(F.lit(1)).alias("stored")
    )
    return (
        full.join(closed.select(*key, "n"), key, "inner")
        .withColumn("late", F.col("stored") - F.col("n"))
        .filter(F.col("late") > 0)
    )


def stream_accepted(stream: DataFrame, ttl_seconds: int = schema.IDEMPOTENCY_SECONDS) -> DataFrame:
    """Fast path: accepted arrivals only, with state that Spark itself drops after the window."""
    return stream.withWatermark("arrived_at", f"{ttl_seconds} seconds").dropDuplicatesWithinWatermark(["event_id"])
