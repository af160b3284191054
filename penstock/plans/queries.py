"""Registered queries: every operator over whole derived tables.

Times leave as epoch milliseconds and JSON objects as text, so that results can be
compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from penstock.functions import backoff
from penstock.functions import variants as v
from penstock.operators import (
    config, delivery, feeds, ingest, metrics, people, requests, routing, steps,
)
from penstock.plans import ingestion
from penstock.plans.fixtures import fixture
from penstock.plans.serving import Serving
from penstock.session import prepare, scratch_dir, staged
from penstock.sources import queue, sinks, tables
from penstock.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

KEY_HEX = "000102030405060708090a0b0c0d0e0f101112131415161718191a1b1c1d1e1f"


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(prepare(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return run


def ms(name: str) -> Column:
    return F.unix_millis(name).alias(f"{name}_ms")


def error_text() -> Column:
    return F.array_join(
        F.transform("errors", lambda e: F.concat(e.field, F.lit(": "), e.message)), "; "
    ).alias("errors")


def raw_requests(spark: SparkSession, sf: str, name: str = "raw_events") -> DataFrame:
    return tables.spread(fixture(spark, sf, name), "batch_id")


def stored_events(spark: SparkSession, sf: str) -> DataFrame:
    return tables.spread(fixture(spark, sf, "stored"), "event_id")


# --- requests -----------------------------------------------------------------------------


@query
def parse_raw_events(spark, sf):
    parsed = requests.parse_raw_events(raw_requests(spark, sf))
    m = F.col("m")
    return parsed.select(
        "batch_id",
        F.array_join(F.array_sort(F.map_keys(m)), ",").alias("keys"),
        v.text(m["event"]).alias("event"),
        F.map_contains_key(m, "sessionId").alias("has_session"),
        v.absent(m["sessionId"]).alias("no_session"),
        F.when(v.is_object(m["properties"]), F.to_json(m["properties"])).alias("properties"),
    )


@query
def explode_event_batch(spark, sf):
    exploded = requests.explode_event_batch(fixture(spark, sf, "batch_bodies"))
    parsed = requests.parse_raw_events(exploded)
    return parsed.select(
        "batch_id", "pos", "batch_size", v.text(F.col("m")["eventId"]).alias("event_id"),
        F.size("unknown_fields").alias("n_unknown"),
    )


@query
def validate_events(spark, sf):
    validated = ingestion.validated_requests(raw_requests(spark, sf))
    return validated.select("batch_id", F.size("errors").alias("n_errors"), error_text())


@query
def valid_events(spark, sf):
    validated = ingestion.validated_requests(raw_requests(spark, sf))
    return requests.valid_events(validated).select("batch_id", "workspace_id", ms("arrived_at"))


@query
def quarantine_events(spark, sf):
    validated = ingestion.validated_requests(raw_requests(spark, sf))
    return requests.quarantine_events(validated).select(
        "batch_id", "workspace_id", "status_code", "error", F.array_join("message", "; ").alias("message"),
        "correlation_id", "raw",
    )


@query
def batch_admission(spark, sf):
    validated = ingestion.validated_batches(fixture(spark, sf, "batch_bodies"))
    return validated.select("batch_id", "pos", F.size("errors").alias("n_errors"), "admitted")


@query
def reject_summary(spark, sf):
    return requests.reject_summary(ingestion.validated_requests(raw_requests(spark, sf)))


@query
def normalize_events(spark, sf):
    valid = requests.valid_events(ingestion.validated_requests(raw_requests(spark, sf)))
    return ingest.normalize_events(valid).select(
        "id", "workspace_id", "event_id", "correlation_id", "event_name", "source", "version", "user_id",
        "anonymous_id", "session_id", "properties", "context", "received_text", ms("received_at"), ms("ingested_at"),
    )


@query
def correlation_fill(spark, sf):
    parsed = requests.parse_raw_events(raw_requests(spark, sf))
    rows = parsed.withColumn("correlation_id", v.text(F.col("m")["correlationId"]))
    return ingest.correlation_fill(rows, "batch_id", "pos").select("batch_id", "correlation_id")


# --- dedupe and store ---------------------------------------------------------------------


@query
def dedupe_status(spark, sf):
    labelled = ingest.dedupe_status(fixture(spark, sf, "arrivals"))
    return labelled.select("event_id", "arrival_seq", "workspace_id", ms("arrived_at"), "status")


@query
def dedupe_against_store(spark, sf):
    arrivals = fixture(spark, sf, "arrivals")
    store = fixture(spark, sf, "stored").filter(F.col("event_name") != "app.click")
    return ingest.dedupe_status(arrivals, store).select("event_id", "arrival_seq", "status")


@query
def already_ingested(spark, sf):
    store = fixture(spark, sf, "stored").filter(F.col("event_name") == "app.purchase")
    return ingest.already_ingested(fixture(spark, sf, "arrivals"), store).select("event_id", "arrival_seq")


@query
def events_store(spark, sf):
    path = scratch_dir(spark, "events_store")
    run = ingestion.ingest_requests(raw_requests(spark, sf, "raw_arrivals"))
    tables.append_events(run.stored, path)
    return tables.read_events(spark, path).select(
        "id", "event_id", "workspace_id", "event_name", F.col("received_date").cast("string").alias("received_date"),
        "properties", ms("received_at"),
    )


@query
def event_counts(spark, sf):
    """Accepted events per workspace and name, from raw text to counts."""
    run = ingestion.ingest_requests(raw_requests(spark, sf, "raw_arrivals"), columns=("workspace_id", "event_name"))
    return feeds.event_counts(run.labelled.filter(F.col("status") == "accepted"))


@query
def event_envelope(spark, sf):
    return ingest.event_envelope(fixture(spark, sf, "stored")).select("routing_key", "value")


@query
def ingest_results(spark, sf):
    run = ingestion.ingest_batches(fixture(spark, sf, "batch_bodies"), columns=())
    entry = F.array_join(
        F.transform("results", lambda r: F.concat_ws(":", r.pos.cast("string"), r.event_id, r.status)), ","
    )
    return run.results.select("batch_id", entry.alias("results"))


@query
def batch_summary(spark, sf):
    return ingestion.ingest_batches(fixture(spark, sf, "batch_bodies"), columns=()).summary


# --- config -------------------------------------------------------------------------------


def sealed_destinations(spark: SparkSession, sf: str) -> DataFrame:
    iv = F.substring(F.md5("id"), 1, 24)
    return config.encrypt_column(fixture(spark, sf, "destinations"), "config", F.lit(KEY_HEX), iv).drop("config")


@query
def config_scan(spark, sf):
    path = scratch_dir(spark, "pipelines")
    fixture(spark, sf, "pipelines").write.parquet(path)
    return tables.config_scan(spark, path).select(
        "id", "workspace_id", "name", "description", "enabled", F.size("steps").alias("n_steps"),
        F.array_join("trigger.events", ",").alias("events"),
    )


@query
def workspace_scope(spark, sf):
    """Destinations of the workspace that owns the most events."""
    counted = fixture(spark, sf, "stored").groupBy("workspace_id").agg((-F.count(F.lit(1))).alias("n"))
    busiest = counted.agg(F.min(F.struct("n", "workspace_id")).alias("b")).select("b.workspace_id")
    return fixture(spark, sf, "destinations").join(busiest, "workspace_id", "left_semi").select("id", "workspace_id", "name", "type")


@query
def workspace_list(spark, sf):
    return config.workspace_list(fixture(spark, sf, "pipelines")).select("workspace_id", "id", "name", ms("created_at"))


def config_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Requests for pipelines by id: patches name rows that exist, rows of others and no rows."""
    return fixture(spark, sf, "patches").select(
        "id",
        F.when(F.col("version") % 5 == 0, "ws_0").otherwise(F.col("workspace_id")).alias("workspace_id"),
        F.col("version").alias("request"),
    )


@query
def lookup_scoped(spark, sf):
    pipelines = fixture(spark, sf, "pipelines").select("id", "workspace_id", "name")
    return config.lookup_scoped(config_requests(spark, sf), pipelines).select("request", "id", "workspace_id", "found", "name")


@query
def not_found_report(spark, sf):
    return config.not_found_report(config_requests(spark, sf), fixture(spark, sf, "pipelines"), "Pipeline").select(
        "request", "workspace_id", "status_code", "message"
    )


@query
def enabled_pipelines(spark, sf):
    return config.enabled_pipelines(fixture(spark, sf, "pipelines")).select("id", "workspace_id")


@query
def public_destinations(spark, sf):
    public = config.public_destinations(sealed_destinations(spark, sf))
    return public.select("id", "workspace_id", "name", "type", ms("created_at"), ms("updated_at"))


@query
def validate_pipelines(spark, sf):
    validated = config.validate_pipelines(fixture(spark, sf, "pipeline_requests"))
    return validated.select("request_id", error_text())


@query
def pipeline_defaults(spark, sf):
    validated = config.validate_pipelines(fixture(spark, sf, "pipeline_requests"))
    rows = config.pipeline_rows(validated, F.timestamp_millis(F.lit(0)))
    return rows.select(
        "id", "name", "description", "enabled", F.size("steps").alias("n_steps"),
        F.array_join("trigger.events", ",").alias("events"),
    )


@query
def validate_destinations(spark, sf):
    validated = config.validate_destinations(fixture(spark, sf, "destination_requests"))
    return validated.select("request_id", error_text())


@query
def patch_outcomes(spark, sf):
    outcomes = config.patch_outcomes(fixture(spark, sf, "pipelines"), fixture(spark, sf, "patches"))
    return outcomes.select("id", "version", "op", "outcome")


@query
def apply_patches(spark, sf):
    state = config.apply_patches(fixture(spark, sf, "pipelines"), fixture(spark, sf, "patches"))
    return state.select(
        "id", "workspace_id", "name", "description", "enabled", F.size("steps").alias("n_steps"),
        F.array_join("trigger.events", ",").alias("events"), ms("created_at"), ms("updated_at"),
    )


@query
def encrypt_column(spark, sf):
    """Random IVs: shapes of the sealed columns (their values differ every time)."""
    sealed = config.encrypt_column(fixture(spark, sf, "destinations"), "config", F.lit(KEY_HEX))
    return sealed.select(
        "id", F.length("iv").alias("iv_digits"),
        (F.length("encrypted_config") / 2 - F.octet_length("config")).cast("int").alias("tag_bytes"),
        (F.instr("encrypted_config", F.hex("config")) == 0).alias("hidden"),
    )


@query
def decrypt_column(spark, sf):
    """Round trip; tampered rows (about a third, by the digest of their id) come back NULL."""
    tail = F.expr("right(encrypted_config, 4)")
    broken = F.concat(
        F.expr("left(encrypted_config, length(encrypted_config) - 4)"),
        F.translate(tail, "0123456789abcdef", "fedcba9876543210"),
    )
    tampered = F.substring(F.md5("id"), 1, 1) < "5"
    mixed = sealed_destinations(spark, sf).withColumn(
        "encrypted_config", F.when(tampered, broken).otherwise(F.col("encrypted_config"))
    )
    return config.decrypt_column(mixed, F.lit(KEY_HEX)).select("id", "config")


@query
def credentials_updated(spark, sf):
    """Half of the destinations get a new name, after another one, and a third of those new credentials."""
    changes = fixture(spark, sf, "destinations").filter(F.substring(F.md5("id"), 1, 1) < "8").select(
        "id", "workspace_id", F.lit(2).alias("version"), F.concat(F.lit("Renamed "), F.col("name")).alias("name"),
        F.lit(None).cast("string").alias("type"),
        F.when(F.substring(F.md5("id"), 2, 1) < "5", F.lit('{"token":"new"}')).alias("config"),
    )
    older = changes.withColumns({"version": F.lit(1), "name": F.lit("older"), "config": F.lit(None).cast("string")})
    changes = changes.unionByName(older)
    changed = config.reencrypt_changed(sealed_destinations(spark, sf), changes, F.lit(KEY_HEX), as_of())
    return config.decrypt_column(changed, F.lit(KEY_HEX)).select("id", "name", "type", "config", ms("updated_at"))


@query
def destination_outcomes(spark, sf):
    outcomes = config.destination_outcomes(sealed_destinations(spark, sf), fixture(spark, sf, "destination_patches"))
    return outcomes.select("id", "version", "op", "outcome")


@query
def destination_patches(spark, sf):
    """Destinations created, updated several times and deleted; the config is read back to compare."""
    before = sealed_destinations(spark, sf)
    after = config.apply_destination_changes(before, fixture(spark, sf, "destination_patches"), F.lit(KEY_HEX))
    return config.decrypt_column(after, F.lit(KEY_HEX)).select(
        "id", "workspace_id", "name", "type", "config", ms("created_at"), ms("updated_at")
    )


@query
def retry_schedule(spark, sf):
    planned = delivery.retry_schedule(fixture(spark, sf, "attempts"), backoff.BROKER)
    return planned.select("id", "attempt_number", "delay_ms", "exhausted", ms("next_attempt_at"))


# --- triggers, steps, fan-out -------------------------------------------------------------


def profiles(spark: SparkSession, sf: str) -> dict[str, steps.Enrichment]:
    return {"profiles": steps.Enrichment(fixture(spark, sf, "profiles"), key="user_id", on="userId", version=sf)}


def executed_rows(spark: SparkSession, sf: str) -> DataFrame:
    typed = steps.typed_pipelines(fixture(spark, sf, "pipelines"), fixture(spark, sf, "destinations"))
    return steps.run_steps(stored_events(spark, sf), typed, profiles(spark, sf))


def matched_rows(spark: SparkSession, sf: str) -> DataFrame:
    typed = steps.typed_pipelines(fixture(spark, sf, "pipelines"))
    return steps.attach_steps(steps.trigger_match(steps.with_props(stored_events(spark, sf)), typed), typed)


def step_of(kind: str) -> Column:
    """The first step of a kind; NULL where a pipeline has none."""
    return F.get(F.filter("steps", lambda s: s.type == kind), F.lit(0))


def props_columns() -> list[Column]:
    props = F.col("props")
    return [
        F.array_join(F.array_sort(F.map_keys(props)), ",").alias("keys"),
        v.text(props["total"]).alias("total"),
        F.coalesce(v.text(props["k"]), v.text(props["key"])).alias("k"),
    ]


@query
def trigger_match(spark, sf):
    return matched_rows(spark, sf).select("event_id", "pipeline_id", "event_name", F.size("steps").alias("n_steps"))


@query
def filter_step(spark, sf):
    kept = steps.filter_step(matched_rows(spark, sf), F.get("steps", F.lit(0)))
    return kept.select("event_id", "pipeline_id")


@query
def transform_step(spark, sf):
    """Every pipeline's transform step over all its events; pipelines without one leave them as they are."""
    rows = matched_rows(spark, sf).withColumn("_step", step_of("transform"))
    done = steps.transform_step(rows.filter(F.col("_step").isNotNull()), F.col("_step")).unionByName(rows.filter(F.col("_step").isNull()))
    return done.select("event_id", "pipeline_id", *props_columns())


@query
def enrich_step(spark, sf):
    rows = matched_rows(spark, sf).withColumn("_step", step_of("enrich"))
    done = steps.enrich_step(rows.filter(F.col("_step").isNotNull()), F.col("_step"), "profiles", profiles(spark, sf)["profiles"])
    done = done.unionByName(rows.filter(F.col("_step").isNull()))
    return done.select(
        "event_id", "pipeline_id", v.text(F.col("props")["customer_nation"]).alias("nation"),
        v.text(F.col("props")["customer_segment"]).alias("segment"), F.size("props").alias("n_props"),
    )


@query
def destination_fanout(spark, sf):
    fanned = steps.destination_fanout(executed_rows(spark, sf))
    return fanned.select("event_id", "pipeline_id", "destination_id", "type")


@query
def destination_sinks(spark, sf):
    path = scratch_dir(spark, "sinks")
    fanned = staged(steps.destination_fanout(executed_rows(spark, sf)), "fanned")
    sinks.write_deliveries(steps.deliveries(fanned), path)
    written = (
        spark.read.parquet(f"{path}/outbox").select("event_id", "destination_id", "type", "body")
        .unionByName(spark.read.option("basePath", f"{path}/database").parquet(f"{path}/database").select("event_id", "destination_id", "type", F.col("payload").alias("body")))
        .unionByName(spark.read.schema("event_id STRING, destination_id STRING, type STRING, payload STRING").json(f"{path}/objects").select("event_id", "destination_id", "type", F.col("payload").alias("body")))
    )
    return written


@query
def executions_by_status(spark, sf):
    executions = steps.pipeline_executions(executed_rows(spark, sf), F.col("received_at"), F.col("ingested_at"))
    return steps.execution_rollup(executions).withColumn("mean_ms", F.round("mean_ms", 3))


@query
def execution_rows(spark, sf):
    rows = steps.pipeline_executions(executed_rows(spark, sf), F.col("received_at"), F.col("ingested_at"))
    return rows.select("event_id", "pipeline_id", "status", "error", "n_sends", ms("started_at"), ms("completed_at"))


@query
def route_topics(spark, sf):
    routed = routing.route_topics(fixture(spark, sf, "messages"), fixture(spark, sf, "bindings"))
    return routed.select("message_id", "routing_key", "queue")


# --- delivery log -------------------------------------------------------------------------


@query
def delivery_latest(spark, sf):
    latest = delivery.delivery_latest(fixture(spark, sf, "attempts"))
    return latest.select("event_id", "destination_id", "status", "attempts", ms("last_attempt_at"))


@query
def delivery_outcomes(spark, sf):
    outcomes = delivery.delivery_outcomes(fixture(spark, sf, "attempts"))
    return outcomes.withColumns({c: F.round(c, 6) for c in ("mean_attempts", "first_try_rate")})


@query
def destination_health(spark, sf):
    health = delivery.destination_health(fixture(spark, sf, "attempts"), threshold=2)
    return health.select("destination_id", "trailing_failures", "state", ms("last_success_at"))


def as_of() -> Column:
    """2024-01-31T00:00:00Z, after the last event."""
    return F.timestamp_millis(F.lit(1706659200000))


@query
def expire_messages(spark, sf):
    expired = delivery.expire_messages(fixture(spark, sf, "queue_log"), as_of())
    return expired.select("message_id", "queue", "routing_key", ms("dead_at"))


def dead_letters(spark: SparkSession, sf: str) -> DataFrame:
    return delivery.dead_letter(
        expired=delivery.expire_messages(fixture(spark, sf, "queue_log"), as_of()),
        exhausted=fixture(spark, sf, "attempts"),
        unmatched=steps.unknown_destinations(steps.destination_fanout(executed_rows(spark, sf))),
        messages=ingest.event_envelope(fixture(spark, sf, "stored")),
    )


@query
def dead_letter(spark, sf):
    return dead_letters(spark, sf).select("reason", "queue", "routing_key", "event_id", "destination_id", "message", "error", ms("dead_at"))


@query
def dlq_replay(spark, sf):
    """Replay of everything exhausted, where each event with an even suffix was delivered meanwhile."""
    attempts = fixture(spark, sf, "attempts")
    dead = delivery.dead_letter(exhausted=attempts, messages=ingest.event_envelope(fixture(spark, sf, "stored")))
    meanwhile = attempts.filter("status = 'dead_lettered' and attempt_number = 1").withColumn("status", F.lit("delivered"))
    replayed = delivery.dlq_replay(dead, attempts.unionByName(meanwhile), as_of())
    return replayed.select(
        "event_id", "destination_id", "routing_key",
        F.get_json_object("value", "$.payload.attempt").cast("int").alias("attempt"),
        F.get_json_object("value", "$.meta.timestamp").alias("replayed_at"),
        *[F.get_json_object("value", f"$.payload.message.payload.{name}").alias(alias) for name, alias in (("event", "event_name"), ("properties", "properties"), ("receivedAt", "received_text"))],
    )


# --- people, feeds ------------------------------------------------------------------------


@query
def context_flatten(spark, sf):
    flat = people.context_flatten(fixture(spark, sf, "stored"))
    return flat.select("event_id", "app_name", "app_version", "campaign_source", "campaign_medium", "campaign_name", "locale", "timezone")


@query
def page_events(spark, sf):
    return people.page_events(fixture(spark, sf, "stored"))


@query
def identify_traits(spark, sf):
    return people.identify_traits(fixture(spark, sf, "identifies"))


@query
def group_membership(spark, sf):
    members = people.group_membership(fixture(spark, sf, "groups"))
    return members.select("user_id", "group_id", "calls", "traits", ms("first_at"), ms("last_at"))


@query
def session_rollup(spark, sf):
    sessions = people.session_rollup(fixture(spark, sf, "stored"), "2 hours")
    return sessions.select("workspace_id", "kind", "session", "events", ms("started_at"), ms("ended_at"))


@query
def latest_events(spark, sf):
    latest = feeds.latest_events(fixture(spark, sf, "stored"), 10)
    return latest.select("workspace_id", F.col("rank").cast("bigint").alias("rank"), "event_id", ms("received_at"))


@query
def correlation_trace(spark, sf):
    trace = feeds.correlation_trace(fixture(spark, sf, "stored"))
    return trace.select("correlation_id", "event_id", ms("received_at"), "gap_ms")


# --- measures and alerts ------------------------------------------------------------------


@query
def throughput_series(spark, sf):
    series = metrics.throughput_series(fixture(spark, sf, "stored"), "6 hours", totals=True)
    return series.select(ms("bucket"), "workspace_id", "event_name", "n", F.col("level").cast("int").alias("level"))


@query
def active_users(spark, sf):
    return metrics.active_users(fixture(spark, sf, "stored")).select(ms("bucket"), "workspace_id", "users")


@query
def active_users_approx(spark, sf):
    """The sketch next to the exact count: within three standard errors, or one person."""
    store = fixture(spark, sf, "stored")
    both = metrics.active_users(store).join(
        metrics.active_users_approx(store, rsd=0.02).withColumnRenamed("users", "estimate"), ["bucket", "workspace_id"]
    )
    allowed = F.greatest(F.lit(1.0), F.col("users") * 0.06)
    return both.select(ms("bucket"), "workspace_id", "users", (F.abs(F.col("users") - F.col("estimate")) <= allowed).alias("close"))


@query
def read_model(spark, sf):
    path = scratch_dir(spark, "read_model")
    daily = metrics.read_model(fixture(spark, sf, "stored"), fixture(spark, sf, "attempts"), fixture(spark, sf, "quotas"))
    tables.write_read_model(daily, path)
    return spark.read.parquet(path).withColumn("day", F.col("day").cast("string"))


@query
def read_model_runs(spark, sf):
    """The read model after three runs: early events, later ones, and a sixteenth that came late; attempts by their own time."""
    serving = Serving(scratch_dir(spark, "serving"), buckets=8)
    store, attempts, quotas = (staged(fixture(spark, sf, name), name) for name in ("stored", "attempts", "quotas"))
    late = F.substring(F.md5("event_id"), 1, 1) == "0"
    for number, (events, tries) in enumerate([
        (~late & (F.col("received_at") < CUTS[0]), F.col("attempted_at") < CUTS[0]),
        (~late & (F.col("received_at") >= CUTS[0]), (F.col("attempted_at") >= CUTS[0]) & (F.col("attempted_at") < FIVE[-1])),
        (late, F.col("attempted_at") >= FIVE[-1]),
    ]):
        serving.run(number, store.filter(events), attempts.filter(tries), quotas)
    return serving.model(spark).withColumn("day", F.col("day").cast("string"))


@query
def active_users_spans(spark, sf):
    """People of 7 and 28 days from stored sketches, next to the exact count: within three standard errors, or one person."""
    path, store, until = scratch_dir(spark, "sketches"), fixture(spark, sf, "stored"), F.lit("2024-01-31").cast("date")
    metrics.user_sketches(store).write.parquet(path)
    spans = metrics.active_users_spans(spark.read.parquet(path), until)
    days = store.select("workspace_id", F.coalesce("user_id", "anonymous_id").alias("who"), F.to_date("received_at").alias("at"), F.explode(F.array(F.lit(7), F.lit(28))).alias("span"))
    exact = days.distinct().select("workspace_id", "who", "span", F.explode(F.expr("sequence(at, least(date_add(at, span - 1), date '2024-01-31'))")).alias("day"))
    exact = exact.groupBy("span", "day", "workspace_id").agg(F.count_distinct("who").alias("exact"))
    both = spans.join(exact, ["span", "day", "workspace_id"], "full")
    allowed = F.greatest(F.lit(1.0), F.col("exact") * 3 * 1.04 / 2**7)
    return both.select("span", F.col("day").cast("string").alias("day"), "workspace_id", F.col("exact").alias("users"), (F.abs(F.col("exact") - F.col("users")) <= allowed).alias("close"))


@query
def workspace_quota(spark, sf):
    return metrics.workspace_quota(fixture(spark, sf, "stored"), fixture(spark, sf, "quotas"))


@query
def rate_limit_audit(spark, sf):
    audited = metrics.rate_limit_audit(
        fixture(spark, sf, "stored"), "workspace_id", "received_at", window_ms=6 * 3_600_000, limit=3, burst=2
    )
    return audited.select("event_id", "workspace_id", "in_window", "over_limit", "over_burst")


@query
def edge_limit_audit(spark, sf):
    audited = metrics.edge_limit_audit(fixture(spark, sf, "stored"), "workspace_id", "received_at", "event_id", rate=1, burst=2, per_ms=6 * 3_600_000)
    return audited.select("event_id", "workspace_id", "level", "over_limit")


@query
def alert_rules_with_silence(spark, sf):
    alerts = metrics.alert_rules_with_silence(fixture(spark, sf, "stored"), fixture(spark, sf, "rules"), F.timestamp_millis(F.lit(1704067200000)), as_of())
    return alerts.select("rule_id", "workspace_id", "window_start", "windows", "value", "suppressed", "repeats_suppressed")


@query
def alert_rules(spark, sf):
    alerts = metrics.alert_rules(fixture(spark, sf, "stored"), fixture(spark, sf, "rules"))
    return alerts.select("rule_id", "workspace_id", "window_start", F.col("value").cast("bigint").alias("value"), "suppressed")


# --- streams ------------------------------------------------------------------------------


CUTS = ["2024-01-16"]  # where the feed is cut into two runs
FIVE = ["2024-01-07", "2024-01-13", "2024-01-19", "2024-01-25"]


def in_runs(
    spark: SparkSession, df: DataFrame, time: str | Column, start: Callable[[DataFrame], object], cuts: list[str] = CUTS
) -> None:
    """Feed `df` to a stream in parts by time; `start` runs on the same checkpoint for each.

    A later run picks up where the one before stopped, as after a restart.
    """
    path = scratch_dir(spark, "feed")
    df = staged(df, "feed-rows")
    at = F.col(time) if isinstance(time, str) else time
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = F.lit(True) if low is None else at >= low
        df.filter(part if high is None else part & (at < high)).write.mode("append").parquet(path)
        start(spark.readStream.schema(df.schema).parquet(path)).awaitTermination()


def ingested_stream(spark: SparkSession, sf: str, name: str) -> str:
    root, checkpoint = scratch_dir(spark, "ingest"), scratch_dir(spark, "checkpoint")
    in_runs(spark, fixture(spark, sf, name), "arrived_at", lambda s: jobs.stream_ingest(s, root, checkpoint), FIVE)
    return root


@query
def stream_ingest(spark, sf):
    root = ingested_stream(spark, sf, "raw_events")
    kept = jobs.read_batches(spark, root, "labelled", "batch_id STRING, status STRING").select("batch_id", "status")
    refused = jobs.read_batches(spark, root, "quarantine", jobs.QUARANTINE)
    return kept.unionByName(refused.select("batch_id", F.lit("quarantined").alias("status")))


@query
def stream_dedupe(spark, sf):
    root = ingested_stream(spark, sf, "raw_arrivals")
    labelled = jobs.read_batches(spark, root, "labelled", "batch_id STRING, event_id STRING, arrival_seq BIGINT, status STRING")
    return labelled.select("batch_id", "event_id", "arrival_seq", "status")


@query
def stream_labels(spark, sf):
    root, checkpoint = scratch_dir(spark, "labels"), scratch_dir(spark, "checkpoint")
    in_runs(spark, fixture(spark, sf, "arrivals"), "arrived_at", lambda s: jobs.stream_labels(s, root, checkpoint), FIVE)
    return jobs.read_batches(spark, root, "labelled", "event_id STRING, arrival_seq BIGINT, status STRING").select("event_id", "arrival_seq", "status")


@query
def stream_accepted(spark, sf):
    out, checkpoint = scratch_dir(spark, "accepted"), scratch_dir(spark, "checkpoint")
    stream = files_stream(spark, fixture(spark, sf, "arrivals"))
    accepted = jobs.stream_accepted(stream).select("event_id", "arrived_at")
    accepted.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start().awaitTermination()
    return spark.read.parquet(out).select("event_id")


def files_stream(spark: SparkSession, df: DataFrame) -> DataFrame:
    path = scratch_dir(spark, "feed")
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


@query
def late_rows(spark, sf):
    """Rows of a tenth of the events that the closed windows of the others miss."""
    store = fixture(spark, sf, "stored")
    closed = metrics.throughput_series(store.filter(F.substring(F.md5("event_id"), 1, 1) != "0"), "6 hours")
    late = jobs.late_rows(store, closed, "6 hours")
    return late.select(ms("bucket"), "workspace_id", "event_name", "stored", "n", "late")


@query
def masked_failures(spark, sf):
    """The reply to an unexpected failure of every stored event."""
    masked = requests.masked_failures(fixture(spark, sf, "stored"))
    return masked.withColumn("message", F.array_join("message", ";"))


@query
def queue_source(spark, sf):
    """Messages put on a file queue, one third of them again between two runs, file by file, and consumed once.

    The envelopes are made once, by all cores, before the rows go to the two that write files; those
    that come again are read from the queue.
    """
    path, out, checkpoint = (scratch_dir(spark, part) for part in ("queue", "consumed", "checkpoint"))
    columns = "routing_key STRING, value STRING, published_at TIMESTAMP"
    for again in (False, True):
        if again:
            part = spark.read.schema(columns).parquet(path).filter(F.crc32("value") % 3 == 0)
        else:
            part = ingest.event_envelope(stored_events(spark, sf)).select("routing_key", "value", "published_at")
        # two files a time, also where a session deals out more partitions than it is asked for
        queue.publish(part.repartition(2, "value").coalesce(2), path)
        stream = queue.queue_source(spark, path, columns, files_per_trigger=1)
        jobs.consume_once(
            stream, lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/consumed/batch={n}"), out, checkpoint
        ).awaitTermination()
    consumed = spark.read.parquet(f"{out}/consumed")
    return consumed.select(
        "routing_key", F.get_json_object("value", "$.payload.eventId").alias("event_id"), ms("published_at")
    )


@query
def stream_pipeline(spark, sf):
    root, checkpoint = scratch_dir(spark, "flow"), scratch_dir(spark, "checkpoint")

    def read_config():
        return fixture(spark, sf, "pipelines"), fixture(spark, sf, "destinations"), profiles(spark, sf)

    in_runs(
        spark, fixture(spark, sf, "stored"), "received_at",
        lambda s: jobs.stream_pipeline(s, root, checkpoint, read_config),
    )
    columns = "pipeline_id STRING, event_id STRING, status STRING, error STRING, n_sends INT"
    return jobs.read_batches(spark, root, "executions", columns).drop("batch")


def delayed(at: str) -> Column:
    """When a row reaches its stream: a seventh of the rows come three days after their time."""
    return F.col(at) + F.expr("interval 3 days") * F.when(F.crc32("event_id") % 7 == 0, 1).otherwise(0)


@query
def stream_sessions(spark, sf):
    """Sessions closed by the fifth run, with late rows between open ones."""
    out, checkpoint = scratch_dir(spark, "sessions"), scratch_dir(spark, "checkpoint")
    in_runs(
        spark, fixture(spark, sf, "stored"), delayed("received_at"),
        lambda s: jobs.stream_sessions(s, out, checkpoint, "2 hours", "24 hours", lateness="4 days"), FIVE,
    )
    merged = jobs.merged_sessions(spark.read.parquet(out))
    return merged.select("workspace_id", "kind", "session", "events", ms("started_at"), ms("ended_at"))


@query
def stream_expiry(spark, sf):
    """Messages expired by the fifth run; both feeds come by their own times."""
    out, checkpoint, log = scratch_dir(spark, "expiry"), scratch_dir(spark, "checkpoint"), staged(fixture(spark, sf, "queue_log"), "queue-log")
    sides = [log.drop("consumed_at"), log.filter("consumed_at IS NOT NULL").select("message_id", "consumed_at")]
    paths = [scratch_dir(spark, "feed") for _ in sides]
    for low, high in zip(["2000-01-01", *FIVE], [*FIVE, "2100-01-01"], strict=True):
        for side, path, at in zip(sides, paths, ("published_at", "consumed_at"), strict=True):
            side.filter((F.col(at) >= low) & (F.col(at) < high)).write.mode("append").parquet(path)
        feeds_ = [spark.readStream.schema(side.schema).parquet(path) for side, path in zip(sides, paths, strict=True)]
        jobs.stream_expiry(*feeds_, out, checkpoint).awaitTermination()
    return spark.read.parquet(out).select("message_id", "queue", "routing_key", ms("dead_at"))


@query
def stream_throughput(spark, sf):
    """Closed six-hour windows, tumbling; the last ones stay open until later events arrive."""
    out, checkpoint = scratch_dir(spark, "throughput"), scratch_dir(spark, "checkpoint")
    in_runs(
        spark, fixture(spark, sf, "stored"), "received_at",
        lambda s: jobs.stream_throughput(s, out, checkpoint, "6 hours"),
    )
    return spark.read.parquet(out).select(ms("bucket"), "workspace_id", "event_name", "n")


@query
def stream_throughput_sliding(spark, sf):
    out, checkpoint = scratch_dir(spark, "sliding"), scratch_dir(spark, "checkpoint")
    in_runs(
        spark, fixture(spark, sf, "stored"), "received_at",
        lambda s: jobs.stream_throughput(s, out, checkpoint, "12 hours", "6 hours"),
    )
    return spark.read.parquet(out).select(ms("bucket"), "workspace_id", "event_name", "n")
