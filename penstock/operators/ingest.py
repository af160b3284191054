"""From valid requests to stored rows, queue messages and per-batch replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penstock import schema
from penstock.functions import ids, times
from penstock.functions import variants as v
from penstock.operators.skew import HOT_ROWS, parts, salted_join, splits_of

ROUTING_KEY = "event.ingested"
ENVELOPE_SOURCE = "ingestion"
ENVELOPE_VERSION = "1.0"
# Orders arrivals of requests, including copies inside one batch call.
REQUEST_ORDER = ("arrived_at", "arrival_seq", "batch_id", "pos")


def correlation_fill(df: DataFrame, *identity: str) -> DataFrame:
    """Keep a correlation id where there is one, else derive it from the row's `identity`."""
    made = ids.content_id(F.lit("correlation"), *identity)
    return df.withColumn("correlation_id", F.coalesce("correlation_id", made))


def normalize_events(valid: DataFrame, clock: Column | None = None) -> DataFrame:
    """Valid requests as stored rows, plus batch_id, pos, arrived_at and arrival_seq.

    A missing event id becomes one derived from the request, so a recomputed task
    produces the same; a missing timestamp becomes the arrival time. `clock` is the
    store time, the arrival time unless given. `received_text` keeps the event time
    as the client wrote it.
    """
    m = F.col("m")
    arrived = F.date_trunc("MILLISECOND", "arrived_at")
    request = ("batch_id", "pos", "arrival_seq", F.unix_millis(arrived))

    def optional(name: str) -> Column:
        return v.text(m[name])

    def json_object(name: str) -> Column:
        return F.when(v.absent(m[name]), F.lit("{}")).otherwise(F.to_json(m[name]))

    stamp = F.coalesce(optional("timestamp"), times.iso_millis(arrived))
    return valid.select(
        ids.content_id(F.lit("row"), *request).alias("id"),
        "workspace_id",
        F.coalesce(optional("eventId"), ids.content_id(F.lit("event"), *request)).alias("event_id"),
        optional("correlationId").alias("correlation_id"),
        optional("event").alias("event_name"),
        optional("source").alias("source"),
        optional("version").alias("version"),
        optional("userId").alias("user_id"),
        optional("anonymousId").alias("anonymous_id"),
        optional("sessionId").alias("session_id"),
        json_object("properties").alias("properties"),
        json_object("context").alias("context"),
        times.parse_iso(stamp).alias("received_at"),
        F.date_trunc("MILLISECOND", clock if clock is not None else F.col("arrived_at")).alias(
            "ingested_at"
        ),
        stamp.alias("received_text"),
        "batch_id",
        "pos",
        "arrived_at",
        "arrival_seq",
    )


def dedupe_status(
    arrivals: DataFrame,
    store: DataFrame | None = None,
    ttl_seconds: int = schema.IDEMPOTENCY_SECONDS,
    hot_rows: int = HOT_ROWS,
    order: tuple[str, ...] = ("arrived_at", "arrival_seq"),
) -> DataFrame:
    """Add `status` to every arrival of an event id: accepted, duplicate or conflict.

    The first arrival of an id is accepted. Later ones within the idempotency window
    of the first are duplicates and do not renew it; after the window the key is
    gone but the store's unique index still refuses the row: conflict. Ids are
    global (not per workspace) and case-sensitive. `order`, which starts with
    arrived_at, puts the arrivals of an id in order and must tell them apart. `store` (event_id, ingested_at) counts as earlier
    arrivals, so labels do not depend on how a feed is cut into runs.

    Two hazards of a request-at-a-time service are left out on purpose: copies inside
    one batch do not race (the first is accepted), and a stored row cannot miss its
    message, which is a projection of it.

    One narrow pre-aggregated shuffle finds the first arrival per id and the hot ids,
    one shuffle joins it back; a hot id is cut over many tasks.
    """
    place = F.struct(*order)
    first = arrivals.groupBy("event_id").agg(
        F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    hot = splits_of(first, ["event_id"], hot_rows, also=["_first"])
    first = first.withColumn("_splits", parts(hot_rows)).drop("_n")
    if store is not None:
        stored = store.groupBy("event_id").agg(F.min("ingested_at").alias("_stored_at"))
        first = first.join(stored, "event_id", "left")
    else:
        first = first.withColumn("_stored_at", F.lit(None).cast("timestamp"))
    first_at = F.coalesce("_stored_at", F.col("_first.arrived_at"))
    expires = first_at + F.make_dt_interval(secs=F.lit(ttl_seconds))
    status = (
        F.when(F.col("_stored_at").isNull() & (place == F.col("_first")), "accepted")
        .when(F.col("arrived_at") < expires, "duplicate")
        .otherwise("conflict")
    )
    return (
        salted_join(arrivals, first, ["event_id"], "left", spread=list(order), hot=hot)
        .withColumn("status", status)
        .drop("_first", "_stored_at")
    )


def already_ingested(
    arrivals: DataFrame, store: DataFrame, keep: str = "new", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Arrivals whose id is not in the store, or with keep='known' those whose id is."""
    return salted_join(
        arrivals,
        store.select("event_id").distinct(),
        ["event_id"],
        "left_anti" if keep == "new" else "left_semi",
        spread=["arrived_at", "arrival_seq"],
        hot_rows=hot_rows,
    )


def accepted_rows(labelled: DataFrame) -> DataFrame:
    """The stored-row columns of accepted arrivals."""
    return labelled.filter(F.col("status") == "accepted").select(*schema.STORE_COLUMNS)


def event_envelope(stored: DataFrame) -> DataFrame:
    """One queue message per stored row: routing key and JSON text.

    Ids the event does not have stay out of the JSON; `receivedAt` is the client's text.
    """
    meta = F.struct(
        ids.content_id(F.lit("message"), "id").alias("messageId"),
        F.col("correlation_id").alias("correlationId"),
        times.iso_millis(F.col("ingested_at")).alias("timestamp"),
        F.lit(ENVELOPE_SOURCE).alias("source"),
        F.lit(ENVELOPE_VERSION).alias("version"),
        F.col("workspace_id").alias("workspaceId"),
    )
    payload = F.struct(
        F.col("event_id").alias("eventId"),
        F.col("event_name").alias("event"),
        "source",
        "version",
        F.col("user_id").alias("userId"),
        F.col("anonymous_id").alias("anonymousId"),
        F.col("session_id").alias("sessionId"),
        F.parse_json("properties").alias("properties"),
        F.parse_json("context").alias("context"),
        F.col("received_text").alias("receivedAt"),
    )
    return stored.select(
        F.lit(ROUTING_KEY).alias("routing_key"),
        F.to_json(F.struct(meta.alias("meta"), payload.alias("payload"))).alias("value"),
        "event_id",
        F.col("ingested_at").alias("published_at"),
    )


def ingest_results(labelled: DataFrame) -> DataFrame:
    """Reply per admitted batch: (pos, event_id, status) in request order.

    Admission limits a batch to 100 events, so the collected group is bounded.
    """
    entry = F.struct("pos", "event_id", "status")
    return labelled.groupBy("batch_id").agg(F.array_sort(F.collect_list(entry)).alias("results"))


def batch_summary(labelled: DataFrame) -> DataFrame:
    """Accepted and duplicate counts per batch; conflicts, an error of the store, separately."""
    return labelled.groupBy("batch_id").agg(
        *[
            F.count_if(F.col("status") == status).alias(name)
            for status, name in (("accepted", "accepted"), ("duplicate", "duplicates"), ("conflict", "conflicts"))
        ]
    )
