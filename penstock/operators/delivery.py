"""Delivery logs: latest state, outcomes, retries, health, expiry, dead letters and replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penstock import schema
from penstock.functions import backoff, ids, times
from penstock.functions.backoff import Backoff
from penstock.operators.ingest import ENVELOPE_VERSION
from penstock.operators.skew import HOT_ROWS, salted_join

DEAD_LETTER = ["reason", "queue", "routing_key", "event_id", "destination_id", "message", "error", "dead_at"]


def delivery_latest(attempts: DataFrame) -> DataFrame:
    """Status of the last attempt per event and destination, and how many there were.

    The last one is the latest by time, then number, then id: a replay counts its
    attempts from 1 again.
    """
    return attempts.groupBy("event_id", "destination_id").agg(
        F.max_by("status", F.struct("attempted_at", "attempt_number", "id")).alias("status"),
        F.count(F.lit(1)).alias("attempts"),
        F.max("attempted_at").alias("last_attempt_at"),
    )


def delivery_outcomes(attempts: DataFrame) -> DataFrame:
    """Per destination: latest statuses, mean attempts, and share delivered at the first try."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in schema.DELIVERY_STATUSES]
    first_try = (F.col("status") == "delivered") & (F.col("attempts") == 1)
    return delivery_latest(attempts).groupBy("destination_id").agg(
        *counts,
        F.avg("attempts").alias("mean_attempts"),
        (F.count_if(first_try) / F.count(F.lit(1))).alias("first_try_rate"),
    )


def retry_schedule(attempts: DataFrame, policy: Backoff = backoff.BROKER) -> DataFrame:
    """Failed attempts with `next_attempt_at`, or `exhausted` past the last retry."""
    used = F.col("attempt_number") + (policy.first_attempt - 1)
    spent = backoff.exhausted(used, policy)
    delay = backoff.delay_ms(used, policy)
    return (
        attempts.filter(F.col("status") == "failed")
        .withColumn("exhausted", spent)
        .withColumn("delay_ms", F.when(~spent, delay))
        .withColumn(
            "next_attempt_at",
            F.when(~spent, F.timestamp_millis(F.unix_millis("attempted_at") + delay)),
        )
    )


def destination_health(attempts: DataFrame, threshold: int) -> DataFrame:
    """Trailing failures per destination; `open` from `threshold` on, else `closed`.

    The run is counted as attempts after the last success, which needs two
    pre-aggregated passes instead of sorting a destination's whole history.
    """
    order = F.struct("attempted_at", "id")
    settled = attempts.filter(F.col("status") != "pending")
    success = F.col("status") == "delivered"
    last = settled.groupBy("destination_id").agg(F.max(F.when(success, order)).alias("_last"))
    after = F.col("_last").isNull() | (order > F.col("_last"))
    return (
        settled.join(last, "destination_id", "left")
        .groupBy("destination_id")
        .agg(
            F.count_if(after).alias("trailing_failures"),
            F.max(F.when(success, F.col("attempted_at"))).alias("last_success_at"),
        )
        .withColumn("state", F.when(F.col("trailing_failures") >= threshold, "open").otherwise("closed"))
    )


def expire_messages(queue_log: DataFrame, as_of: Column, ttl_ms: int = schema.MESSAGE_TTL_MS) -> DataFrame:
    """Messages that waited `ttl_ms` or longer, with their dead-letter routing key."""
    published = F.unix_millis("published_at")
    waited = F.unix_millis(F.coalesce("consumed_at", as_of)) - published
    return (
        queue_log.filter(waited >= ttl_ms)
        .withColumn("routing_key", F.concat(F.lit("dead."), F.col("queue")))
        .withColumn("dead_at", F.timestamp_millis(published + ttl_ms))
    )


def dead_letter(
    expired: DataFrame | None = None,
    exhausted: DataFrame | None = None,
    unmatched: DataFrame | None = None,
    messages: DataFrame | None = None,
) -> DataFrame:
    """One table of dead letters from expired messages, exhausted deliveries and unknown destinations.

    `message` is what could not be delivered, `error` why. An exhausted attempt names its event only;
    `messages` (event_id, value) has the events as they were queued, and a letter whose event is not
    among them keeps a NULL message.
    """
    nothing = F.lit(None).cast("string")
    parts = []
    if expired is not None:
        parts.append(
            expired.select(
                F.lit("expired").alias("reason"), "queue", "routing_key", "event_id",
                nothing.alias("destination_id"), F.col("value").alias("message"), nothing.alias("error"), "dead_at",
            )
        )
    if exhausted is not None:
        dead = exhausted.filter(F.col("status") == "dead_lettered")
        if messages is None:
            dead = dead.withColumn("value", nothing)
        else:
            dead = dead.join(messages.select("event_id", "value").dropDuplicates(["event_id"]), "event_id", "left")
        parts.append(
            dead.select(
                F.lit("exhausted").alias("reason"), F.lit("delivery.events").alias("queue"),
                F.lit("dead.delivery.events").alias("routing_key"), "event_id", "destination_id",
                F.col("value").alias("message"), "error", F.col("attempted_at").alias("dead_at"),
            )
        )
    if unmatched is not None:
        parts.append(
            unmatched.select(
                F.lit("unknown_destination").alias("reason"), F.lit("pipeline.events").alias("queue"),
                F.lit("dead.pipeline.events").alias("routing_key"), "event_id", "destination_id",
                F.col("payload").alias("message"), nothing.alias("error"), F.col("ingested_at").alias("dead_at"),
            )
        )
    if not parts:
        raise ValueError("dead_letter needs at least one source")
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table.select(*DEAD_LETTER)


def dlq_replay(
    dead: DataFrame, attempts: DataFrame, replayed_at: Column, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Dead deliveries put back on the delivery queue with attempt 1, unless delivered meanwhile.

    `dead` holds the chosen dead letters that name a destination. The event goes with them: the letter's
    message as JSON, or as text where it is none.
    """
    pair = ["event_id", "destination_id"]
    delivered = attempts.filter(F.col("status") == "delivered").select(*pair).distinct()
    open_letters = dead.select(*pair, "reason", "message", "dead_at")
    chosen = salted_join(
        open_letters, delivered, pair, "left_anti", spread=["dead_at", "reason", "message"], hot_rows=hot_rows
    )
    meta = F.struct(
        ids.content_id(F.lit("replay"), *pair, "reason", F.unix_millis("dead_at")).alias("messageId"),
        times.iso_millis(replayed_at).alias("timestamp"),
        F.lit("replay").alias("source"),
        F.lit(ENVELOPE_VERSION).alias("version"),
    )
    payload = F.struct(
        F.col("event_id").alias("eventId"),
        F.col("destination_id").alias("destinationId"),
        F.lit(1).alias("attempt"),
        "reason",
        F.coalesce(F.try_parse_json("message"), F.col("message").cast("variant")).alias("message"),
    )
    return chosen.select(
        *pair,
        F.lit("delivery.retry").alias("routing_key"),
        F.to_json(F.struct(meta.alias("meta"), payload.alias("payload"))).alias("value"),
    )
