"""Table schemas and the fixed vocabularies of the data model."""

from __future__ import annotations

# Vocabularies of the model.
STEP_TYPES = ("filter", "transform", "enrich", "destination")
DESTINATION_TYPES = (
    "postgres", "mysql", "slack", "discord", "webhook", "s3", "email", "elasticsearch",
)
DELIVERY_STATUSES = ("pending", "delivered", "failed", "dead_lettered")

# Request fields in declaration order; anything else is refused.
EVENT_FIELDS = (
    "event", "correlationId", "eventId", "timestamp", "source", "version",
    "userId", "anonymousId", "sessionId", "properties", "context",
)

IDEMPOTENCY_SECONDS = 86_400
MESSAGE_TTL_MS = 86_400_000
BATCH_MIN, BATCH_MAX = 1, 100

STORE = """
    id STRING, workspace_id STRING, event_id STRING, correlation_id STRING,
    event_name STRING, source STRING, version STRING,
    user_id STRING, anonymous_id STRING, session_id STRING,
    properties STRING, context STRING,
    received_at TIMESTAMP, ingested_at TIMESTAMP, received_text STRING
"""
STORE_COLUMNS = [part.split()[0] for part in STORE.replace("\n", " ").split(",")]

CONTEXT = """
    app STRUCT<name: STRING, version: STRING>,
    os STRUCT<name: STRING, version: STRING>,
    locale STRING, timezone STRING, ip STRING, userAgent STRING,
    page STRUCT<url: STRING, title: STRING, referrer: STRING>,
    campaign STRUCT<source: STRING, medium: STRING, name: STRING>
"""

STEP = "STRUCT<id: STRING, type: STRING, name: STRING, config: STRING>"
TRIGGER = "STRUCT<type: STRING, events: ARRAY<STRING>>"
PIPELINE = f"""
    id STRING, workspace_id STRING, name STRING, description STRING,
    trigger {TRIGGER}, steps ARRAY<{STEP}>, enabled BOOLEAN,
    created_at TIMESTAMP, updated_at TIMESTAMP
"""
ERRORS = "array<struct<field:string,message:string>>"
