"""Raw requests: parsing, batch bodies, validation, admission and rejects."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penstock import schema
from penstock.functions import ids, times
from penstock.functions import variants as v

# Texts of the validation errors.
EVENT_NAME = r"\A[a-z][a-z0-9]*(\.[a-z][a-z0-9]*)+\z"
EVENT_NAME_MESSAGE = 'event must be dot notation lowercase, e.g. "order.created"'
WHO_MESSAGE = "userId or anonymousId is required"
WORKSPACE_MESSAGE = "x-workspace-id header is required"
MALFORMED_MESSAGE = "body must be a JSON object"
TIMESTAMP_FORM_MESSAGE = "unsupported timestamp form"
BATCH_MESSAGES = {
    "array": "events must be an array",
    "min": f"events must contain at least {schema.BATCH_MIN} elements",
    "max": f"events must contain no more than {schema.BATCH_MAX} elements",
}


def parse_raw_events(requests: DataFrame) -> DataFrame:
    """Add `m`, the JSON object in `raw` as MAP<STRING, VARIANT>; NULL when it is not one.

    Keeps JSON types, unknown keys and the difference between null and absent.
    """
    return v.with_object(requests, "raw", "m")


def explode_event_batch(bodies: DataFrame) -> DataFrame:
    """One row per event of `{"events": […]}` with its position and `batch_size`.

    A body without a usable `events` array yields one row with a NULL position and
    size, an empty one a NULL position and size 0, so that no batch vanishes.
    """
    return (
        event_body(bodies)
        .select(
            *[c for c in bodies.columns if c not in ("raw", "pos")],
            "unknown_fields",
            "batch_size",
            F.posexplode_outer("_events").alias("pos", "_event"),
        )
        .withColumn("raw", F.to_json("_event"))
        .drop("_event")
    )


def event_body(bodies: DataFrame) -> DataFrame:
    """Add `_events` (the array of a batch body, NULL without one), `batch_size` and `unknown_fields`."""
    outside = F.array_except(F.map_keys("_body"), F.array(F.lit("events")))
    # two projections, so that the array is built once and not once per use
    return v.with_object(bodies, "raw", "_body").select(
        *[c for c in bodies.columns if c not in ("raw", "pos")],
        F.col("_body")["events"].try_cast("array<variant>").alias("_events"),
        F.coalesce(outside, F.array().cast("array<string>")).alias("unknown_fields"),
    ).withColumn("batch_size", F.when(F.col("_events").isNotNull(), F.size("_events")))


def _error(field: str, message: Column | str) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.struct(F.lit(field).alias("field"), text.alias("message"))


def collect_errors(checks: list[tuple[str, Column | str, Column]]) -> Column:
    """ARRAY of (field, message) for the checks whose condition does not hold, in order."""
    none = F.array().cast(schema.ERRORS)
    return F.concat(
        *[
            F.when(F.coalesce(holds, F.lit(False)), none).otherwise(F.array(_error(field, message)))
            for field, message, holds in checks
        ]
    )


def unknown_field_errors(keys: Column, known: tuple[str, ...]) -> Column:
    return F.transform(
        F.array_except(keys, F.array(*[F.lit(k) for k in known])),
        lambda k: F.struct(
            k.alias("field"),
            F.concat(F.lit("property "), k, F.lit(" should not exist")).alias("message"),
        ),
    )


def event_checks(kind: Callable[[str], Column], text: Callable[[str], Column], moment: Column) -> list[tuple[str, Column | str, Column]]:
    """The rules of one event in field order, over the kind and text of each field and the parsed timestamp."""

    def missing(f: str) -> Column:
        return kind(f).isNull() | (kind(f) == "VOID")

    def string(f: str) -> Column:
        return kind(f) == "STRING"

    def filled(f: str) -> Column:
        return ~missing(f) & ~(string(f) & (text(f) == ""))

    def truthy(f: str) -> Column:
        is_number = kind(f).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
        zero = is_number & F.coalesce(text(f).try_cast("double") == 0, F.lit(False))
        return filled(f) & ~zero & ~((kind(f) == "BOOLEAN") & (text(f) == "false"))

    def uuid(f: str) -> Column:
        return string(f) & ids.is_uuid_v4(text(f))

    def plain_object(f: str) -> Column:
        return missing(f) | kind(f).startswith("OBJECT")

    stamp = text("timestamp")
    stamp_message = F.when(
        string("timestamp") & stamp.rlike(times.ISO_UNSUPPORTED), F.lit(TIMESTAMP_FORM_MESSAGE)
    ).otherwise(F.lit("timestamp must be a valid ISO 8601 date string"))
    return [
        ("event", EVENT_NAME_MESSAGE, string("event") & text("event").rlike(EVENT_NAME)),
        ("event", "event should not be empty", filled("event")),
        ("event", "event must be a string", string("event")),
        ("correlationId", "correlationId must be a UUID", uuid("correlationId")),
        ("eventId", "eventId must be a UUID", missing("eventId") | uuid("eventId")),
        (
            "timestamp",
            stamp_message,
            missing("timestamp") | (string("timestamp") & moment.isNotNull()),
        ),
        ("source", "source should not be empty", filled("source")),
        ("source", "source must be a string", string("source")),
        ("version", "version should not be empty", filled("version")),
        ("version", "version must be a string", string("version")),
        ("userId", WHO_MESSAGE, truthy("anonymousId") | filled("userId")),
        ("userId", "userId must be a string", truthy("anonymousId") | string("userId")),
        ("anonymousId", WHO_MESSAGE, truthy("userId") | filled("anonymousId")),
        ("anonymousId", "anonymousId must be a string", truthy("userId") | string("anonymousId")),
        ("sessionId", "sessionId must be a string", missing("sessionId") | string("sessionId")),
        ("properties", "properties must be an object", plain_object("properties")),
        ("context", "context must be an object", plain_object("context")),
    ]


def _workspace_errors() -> Column:
    return collect_errors([("x-workspace-id", WORKSPACE_MESSAGE, F.coalesce("workspace_id", F.lit("")) != "")])


def _body_errors(m: Column, checks: list[tuple[str, Column | str, Column]]) -> Column:
    malformed = F.array(_error("body", MALFORMED_MESSAGE)).cast(schema.ERRORS)
    body = F.concat(collect_errors(checks), unknown_field_errors(F.map_keys(m), schema.EVENT_FIELDS))
    return F.when(m.isNull(), malformed).otherwise(body)


def with_fields(parsed: DataFrame, m: Column) -> DataFrame:
    """Adds what the rules ask of the object `m`: kinds and texts of its fields and the parsed timestamp."""
    return parsed.select(
        "*",
        *[v.kind(m[f]).alias(f"_k_{f}") for f in schema.EVENT_FIELDS],
        *[v.text(m[f]).alias(f"_t_{f}") for f in schema.EVENT_FIELDS if f not in ("properties", "context")],
    ).withColumn("_timestamp", times.parse_iso(F.col("_t_timestamp")))


def field_checks() -> list[tuple[str, Column | str, Column]]:
    """The rules over the columns of `with_fields`."""
    return event_checks(lambda f: F.col(f"_k_{f}"), lambda f: F.col(f"_t_{f}"), F.col("_timestamp"))


def validate_events(parsed: DataFrame) -> DataFrame:
    """Add `errors`: every broken rule as (field, message); empty means valid.

    A body that is not one JSON object has a single error. The workspace check
    comes last, as in the request path where the header is read after the body.
    """
    fields = with_fields(parsed, F.col("m"))
    errors = F.concat(_body_errors(F.col("m"), field_checks()), _workspace_errors())
    extras = [c for c in fields.columns if c.startswith(("_k_", "_t_")) or c == "_timestamp"]
    return v.fenced(fields.withColumn("errors", errors).drop(*extras), "errors")


def valid_events(validated: DataFrame) -> DataFrame:
    return validated.filter(F.size("errors") == 0)


def quarantine_events(validated: DataFrame) -> DataFrame:
    """Refused rows in the shape of the error reply, with the raw text kept.

    `correlationId` stays NULL (and so out of JSON) when the request had none.
    """
    return validated.filter(F.size("errors") > 0).select(
        "batch_id",
        "pos",
        "workspace_id",
        "arrived_at",
        F.lit(400).alias("status_code"),
        F.lit("Bad Request").alias("error"),
        F.col("errors")["message"].alias("message"),
        v.text(F.col("m")["correlationId"]).alias("correlation_id"),
        "errors",
        "raw",
    )


def _batch_errors(size: Column) -> Column:
    """What is wrong with the batch itself: not an array, too short, too long, fields beside `events`."""
    is_array = size.isNotNull()
    checks = collect_errors(
        [
            ("events", BATCH_MESSAGES["array"], is_array),
            ("events", BATCH_MESSAGES["min"], is_array & (size >= schema.BATCH_MIN)),
            ("events", BATCH_MESSAGES["max"], is_array & (size <= schema.BATCH_MAX)),
        ]
    )
    return F.concat(checks, unknown_field_errors(F.col("unknown_fields"), ()))


def _holds(event: Column) -> Column:
    """Whether an event of a body breaks no rule, for use in a lambda: never NULL.

    Spark evaluates a lambda's terms at each use. So the object, the values of its fields, and
    their kinds and texts are each bound once, as the only element of an array.
    """

    def with_object(m: Column) -> Column:
        known = F.size(F.array_except(F.map_keys(m), F.array(*[F.lit(f) for f in schema.EVENT_FIELDS]))) == 0
        values = F.struct(known.alias("known"), *[m[f].alias(f) for f in schema.EVENT_FIELDS])
        return F.forall(F.array(values), with_values)

    def with_values(e: Column) -> Column:
        kinds = [v.kind(e[f]).alias(f"k_{f}") for f in schema.EVENT_FIELDS]
        texts = [v.text(e[f]).alias(f"t_{f}") for f in schema.EVENT_FIELDS if f not in ("sessionId", "properties", "context")]
        return F.coalesce(e["known"], F.lit(False)) & F.forall(F.array(F.struct(*kinds, *texts)), with_fields)

    def with_fields(e: Column) -> Column:
        checks = event_checks(lambda f: e[f"k_{f}"], lambda f: e[f"t_{f}"], times.moment(e["t_timestamp"]))
        return reduce(Column.__and__, [F.coalesce(holds, F.lit(False)) for _, _, holds in checks])

    return F.forall(F.array(v.object_of(event)), with_object)


def batch_admission(bodies: DataFrame) -> DataFrame:
    """One row per event of a batch body, as `explode_event_batch` gives them, with `m`, `errors` and `admitted`.

    `admitted` holds only where every event of the batch is valid and the batch itself is. A
    body's row has all that decides this, so it is parsed and judged as one row: nothing is
    shuffled or joined, and the events part afterwards. A body is judged as far as its first
    invalid event, and the errors of its events are listed once they have parted, which they
    need not where nobody asks for them. The verdict is fenced: a filter on it would have every
    body parsed and judged twice.
    """
    own = event_body(bodies).withColumns({"_batch": _batch_errors(F.col("batch_size")), "_workspace": _workspace_errors()})
    # a batch without events has no event that lacks a workspace
    placed = (F.size("_workspace") == 0) | F.coalesce(F.col("batch_size") == 0, F.lit(True))
    admitted = (F.size("_batch") == 0) & placed & F.coalesce(F.forall("_events", _holds), F.lit(True))
    judged = v.fenced(own.withColumn("admitted", admitted), "admitted")
    rows = judged.select(*[c for c in judged.columns if c != "_events"], F.posexplode_outer("_events").alias("pos", "_event"))
    parted = rows.withColumn("m", v.object_of(F.col("_event")))
    fields = with_fields(parted.withColumn("_refused", F.when(~F.col("admitted"), F.col("m"))), F.col("_refused"))
    none = F.array().cast(schema.ERRORS)
    own_errors = F.when(F.col("admitted"), none).otherwise(_body_errors(F.col("_refused"), field_checks()))
    per_event = F.when(F.col("pos").isNotNull(), F.concat(own_errors, "_workspace")).otherwise(none)
    return fields.select(
        *[c for c in rows.columns if not c.startswith("_") and c not in ("admitted", "pos")], "pos",
        F.to_json("_event").alias("raw"), "m", F.concat("_batch", per_event).alias("errors"), "admitted",
    )


def reject_summary(validated: DataFrame) -> DataFrame:
    """Rejects by field and message, with the log level of their status class."""
    return (
        validated.select(F.explode("errors").alias("e"))
        .groupBy(F.col("e.field").alias("field"), F.col("e.message").alias("message"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("status_code", F.lit(400))
        .withColumn("level", F.when(F.col("status_code") >= 500, "error").otherwise("warn"))
    )


def masked_failures(failures: DataFrame) -> DataFrame:
    """Error rows for unexpected failures: status 500 with the cause hidden."""
    return failures.select(
        F.lit(500).alias("status_code"),
        F.lit("Internal Server Error").alias("error"),
        F.array(F.lit("An unexpected error occurred")).alias("message"),
        "correlation_id",
        F.lit("error").alias("level"),
    )
