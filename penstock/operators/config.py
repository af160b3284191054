"""Pipeline and destination definitions: validation, patches, scoped reads, credentials."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penstock import schema
from penstock.functions import crypto, ids
from penstock.functions import variants as v
from penstock.operators.requests import (
    MALFORMED_MESSAGE,
    collect_errors,
    parse_raw_events,
    unknown_field_errors,
)
from penstock.operators.skew import HOT_ROWS, previous_value

PUBLIC_DESTINATION = ("id", "workspace_id", "name", "type", "created_at", "updated_at")


# --- scoped reads -------------------------------------------------------------------------


def workspace_scope(config: DataFrame, workspace_id: str) -> DataFrame:
    return config.filter(F.col("workspace_id") == workspace_id)


def workspace_list(config: DataFrame, workspace_id: str | None = None) -> DataFrame:
    """Newest first, id as tie-break; one workspace, or all of them workspace by workspace."""
    newest = (F.col("created_at").desc(), F.col("id"))
    if workspace_id is None:
        return config.orderBy("workspace_id", *newest)
    return workspace_scope(config, workspace_id).orderBy(*newest)


def lookup_scoped(requests: DataFrame, config: DataFrame) -> DataFrame:
    """Requests (id, workspace_id, …) with the row they name and `found`.

    A row of another workspace is as good as none.
    """
    rows = config.withColumn("found", F.lit(True))
    joined = requests.join(rows, ["id", "workspace_id"], "left")
    return joined.withColumn("found", F.coalesce("found", F.lit(False)))


def not_found_report(requests: DataFrame, config: DataFrame, kind: str) -> DataFrame:
    """Requests that name no row of their workspace, with the text of the reply."""
    known = config.select("id", "workspace_id")
    missing = requests.join(known, ["id", "workspace_id"], "left_anti")
    return missing.withColumn("status_code", F.lit(404)).withColumn(
        "message", F.concat(F.lit(f"{kind} "), F.col("id"), F.lit(" not found"))
    )


def enabled_pipelines(pipelines: DataFrame) -> DataFrame:
    return pipelines.filter(F.coalesce("enabled", F.lit(True)))


def public_destinations(destinations: DataFrame) -> DataFrame:
    """An allow-list, so that a new column stays hidden until somebody adds it here."""
    return destinations.select(*PUBLIC_DESTINATION)


# --- validation ---------------------------------------------------------------------------


def _at(path: Column | str, checks: list[tuple[Column | str, Column]]) -> Column:
    """Errors under a path that is itself a column."""
    none = F.array().cast(schema.ERRORS)
    where = F.lit(path) if isinstance(path, str) else path
    return F.concat(
        *[
            F.when(F.coalesce(holds, F.lit(False)), none).otherwise(
                F.array(F.struct(F.concat(where, F.lit(f".{field}")).alias("field"), F.lit(message).alias("message")))
            )
            for field, message, holds in checks
        ]
    )


def _one_of(names: tuple[str, ...]) -> str:
    return "must be one of the following values: " + ", ".join(names)


def _step_errors(step: Column, index: Column) -> Column:
    path = F.concat(F.lit("steps."), index.cast("string"))
    fields = step.try_cast("map<string,variant>")
    is_object = v.is_object(step)
    inside = _at(
        path,
        [
            ("id", "id must be a UUID", v.is_string(fields["id"]) & ids.is_uuid(v.text(fields["id"]))),
            (
                "type",
                f"type {_one_of(schema.STEP_TYPES)}",
                v.is_string(fields["type"]) & v.text(fields["type"]).isin(*schema.STEP_TYPES),
            ),
            ("name", "name must be a string", v.is_string(fields["name"])),
            ("config", "config must be an object", v.is_object(fields["config"])),
        ],
    )
    whole = F.array(
        F.struct(path.alias("field"), F.lit("steps must contain objects").alias("message"))
    ).cast(schema.ERRORS)
    unknown = F.transform(
        unknown_field_errors(F.map_keys(fields), ("id", "type", "name", "config")),
        lambda e: F.struct(F.concat(path, F.lit("."), e.field).alias("field"), e.message.alias("message")),
    )
    return F.when(is_object, F.concat(inside, unknown)).otherwise(whole)


def validate_pipelines(requests: DataFrame, partial: bool = False) -> DataFrame:
    """Add `m` and `errors` to submitted pipeline definitions (raw JSON text).

    A missing trigger is an error here: the store would refuse it. Steps may be empty.
    With `partial`, as for updates, any field may be absent or null.
    """
    return _with_errors(requests, pipeline_errors(partial))


def pipeline_errors(partial: bool) -> Column:
    """Errors of a pipeline definition parsed into `m`."""
    m = F.col("m")

    def skipped(field: str) -> Column:
        return v.absent(m[field]) if partial else F.lit(False)

    trigger = m["trigger"].try_cast("map<string,variant>")
    events = F.when(v.is_array(trigger["events"]), trigger["events"].try_cast("array<variant>"))
    steps = F.when(v.is_array(m["steps"]), m["steps"].try_cast("array<variant>"))
    none = F.array().cast(schema.ERRORS)
    trigger_errors = F.when(skipped("trigger"), none).when(
        v.is_object(m["trigger"]),
        _at(
            "trigger",
            [
                ("type", f"type {_one_of(('event',))}", v.is_string(trigger["type"]) & (v.text(trigger["type"]) == "event")),
                ("events", "events must contain at least 1 elements", F.size(events) >= 1),
                (
                    "events",
                    "each value in events must be a string",
                    events.isNotNull() & F.forall(events, v.is_string),
                ),
                ("events", "events must be an array", events.isNotNull()),
            ],
        ),
    ).otherwise(collect_errors([("trigger", "trigger must be an object", F.lit(False))]))
    return F.concat(
        collect_errors(
            [
                ("name", "name must be a string", skipped("name") | v.is_string(m["name"])),
                ("description", "description must be a string", v.absent(m["description"]) | v.is_string(m["description"])),
            ]
        ),
        trigger_errors,
        collect_errors([("steps", "steps must be an array", skipped("steps") | steps.isNotNull())]),
        F.coalesce(F.flatten(F.transform(steps, _step_errors)), none),
        collect_errors(
            [("enabled", "enabled must be a boolean value", v.absent(m["enabled"]) | v.is_boolean(m["enabled"]))]
        ),
        unknown_field_errors(F.map_keys(m), ("name", "description", "trigger", "steps", "enabled")),
    )


def validate_destinations(requests: DataFrame, partial: bool = False) -> DataFrame:
    """Add `m` and `errors` to submitted destinations (raw JSON text); `partial` as for pipelines."""
    return _with_errors(requests, destination_errors(partial))


def destination_errors(partial: bool) -> Column:
    """Errors of a destination parsed into `m`."""
    m = F.col("m")

    def skipped(field: str) -> Column:
        return v.absent(m[field]) if partial else F.lit(False)

    return F.concat(
        collect_errors(
            [
                ("name", "name must be a string", skipped("name") | v.is_string(m["name"])),
                (
                    "type",
                    f"type {_one_of(schema.DESTINATION_TYPES)}",
                    skipped("type") | (v.is_string(m["type"]) & v.text(m["type"]).isin(*schema.DESTINATION_TYPES)),
                ),
                ("config", "config must be an object", skipped("config") | v.is_object(m["config"])),
            ]
        ),
        unknown_field_errors(F.map_keys(m), ("name", "type", "config")),
    )


def _with_errors(requests: DataFrame, body: Column) -> DataFrame:
    malformed = collect_errors([("body", MALFORMED_MESSAGE, F.lit(False))])
    return parse_raw_events(requests).withColumn(
        "errors", F.when(F.col("m").isNull(), malformed).otherwise(body)
    )


def pipeline_rows(validated: DataFrame, created_at: Column) -> DataFrame:
    """Valid definitions as pipeline rows; `enabled` is true unless given."""
    m = F.col("m")
    return validated.filter(F.size("errors") == 0).select(
        ids.content_id(F.lit("definition"), "request_id").alias("id"),
        "workspace_id",
        v.text(m["name"]).alias("name"),
        v.text(m["description"]).alias("description"),
        F.try_variant_get(m["trigger"], "$", schema.TRIGGER).alias("trigger"),
        F.try_variant_get(m["steps"], "$", f"ARRAY<{schema.STEP}>").alias("steps"),
        F.coalesce(F.try_variant_get(m["enabled"], "$", "boolean"), F.lit(True)).alias("enabled"),
        created_at.alias("created_at"),
        created_at.alias("updated_at"),
    )


# --- patches ------------------------------------------------------------------------------

PATCH_FIELDS = {
    "name": "string",
    "description": "string",
    "trigger": schema.TRIGGER,
    "steps": f"ARRAY<{schema.STEP}>",
    "enabled": "boolean",
}
REQUIRED_FIELDS = ("name", "trigger", "steps", "enabled")


def patch_outcomes(current: DataFrame, patches: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add `m` and `outcome` to patches (id, workspace_id, version, op, changed_at, patch).

    applied: takes effect. not_found: its row does not exist at that version, or belongs
    to another workspace. exists: a creation of a row that is there. invalid: no JSON
    object, a field that breaks the rules of definitions (all of them for a creation,
    those of the given fields for an update), or a null for a column that must not be
    null; refused as a whole. What a deletion carries is not looked at.
    """
    return _outcomes(current, patches, pipeline_errors, REQUIRED_FIELDS, hot_rows)


def _outcomes(
    current: DataFrame, patches: DataFrame, errors_of: Callable[[bool], Column], required: tuple[str, ...], hot_rows: int
) -> DataFrame:
    key = ["id", "workspace_id"]
    parsed = v.with_object(patches, "patch", "m")
    broken = F.col("m").isNull()
    for field in required:
        value = F.col("m")[field]
        broken = broken | (value.isNotNull() & F.coalesce(F.is_variant_null(value), F.lit(False)))
    errors = F.when(F.col("op") == "create", errors_of(False)).otherwise(errors_of(True))
    broken = broken | ((F.col("op") != "delete") & (F.size(errors) > 0))
    known = current.select(*key, F.lit(True).alias("_known"))
    rows = parsed.withColumn("_broken", broken).join(known, key, "left")
    life = F.when(~F.col("_broken") & F.col("op").isin("create", "delete"), F.col("op"))
    part = F.floor(F.col("version") / 100_000)
    seen = previous_value(rows, key, ["version"], life, "_life", part, hot_rows)
    alive = F.when(F.col("_life").isNotNull(), F.col("_life") == "create").otherwise(
        F.coalesce("_known", F.lit(False))
    )
    outcome = (
        F.when(F.col("_broken"), "invalid")
        .when((F.col("op") == "create") & alive, "exists")
        .when((F.col("op") != "create") & ~alive, "not_found")
        .otherwise("applied")
    )
    return seen.withColumn("outcome", outcome).drop("_broken", "_known", "_life")


def apply_patches(current: DataFrame, patches: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Current rows after all applied patches, in the columns of `current`.

    A field that is absent keeps its value, a present one wins, an explicit null
    clears `description`. Creation sets every field, so nothing older than the last
    creation shows through; a deletion that nothing follows removes the row.
    """
    joined = _folded(current, patch_outcomes(current, patches, hot_rows), tuple(PATCH_FIELDS))
    recreated = F.col("_life").isNotNull()

    def merged(field: str, kind: str) -> Column:
        new = F.try_variant_get(f"_new_{field}", "$", kind)
        if field == "enabled":
            new = F.coalesce(new, F.lit(True))
        return F.when(F.col(f"_set_{field}").isNotNull(), new).otherwise(F.col(field)).alias(field)

    return joined.select(
        "id",
        "workspace_id",
        *[merged(field, kind) for field, kind in PATCH_FIELDS.items()],
        F.when(recreated, F.col("_created_at")).otherwise(F.col("created_at")).alias("created_at"),
        F.coalesce("_updated_at", "updated_at").alias("updated_at"),
    )


def _folded(current: DataFrame, outcomes: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Current rows beside the last value set in each field (`_new_`, `_set_`); rows that end deleted are gone."""
    m, version = F.col("m"), F.col("version")
    created = F.col("op") == "create"
    folded = []
    for field in fields:
        when_set = F.when(created | F.map_contains_key("m", field), version)
        folded += [F.max_by(m[field], when_set).alias(f"_new_{field}"), F.max(when_set).alias(f"_set_{field}")]
    latest = outcomes.filter(F.col("outcome") == "applied").groupBy("id", "workspace_id").agg(
        *folded,
        F.max_by("op", F.when(F.col("op") != "update", version)).alias("_life"),
        F.max(F.when(created, F.col("changed_at"))).alias("_created_at"),
        F.max_by("changed_at", "version").alias("_updated_at"),
    )
    joined = current.join(latest, ["id", "workspace_id"], "full_outer")
    return joined.filter(F.coalesce(F.col("_life") != "delete", F.lit(True)))


DESTINATION_FIELDS = ("name", "type", "config")


def destination_outcomes(current: DataFrame, changes: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """As `patch_outcomes`, for destinations."""
    return _outcomes(current, changes, destination_errors, DESTINATION_FIELDS, hot_rows)


def apply_destination_changes(
    current: DataFrame, changes: DataFrame, key_hex: Column, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Sealed destinations after all applied creations, updates and deletions.

    Ciphertext and IV stay untouched unless a config is given, which is then sealed
    with a new IV.
    """
    joined = _folded(current, destination_outcomes(current, changes, hot_rows), DESTINATION_FIELDS)
    recreated = F.col("_life").isNotNull()

    def merged(field: str) -> Column:
        return F.when(F.col(f"_set_{field}").isNotNull(), v.text(F.col(f"_new_{field}"))).otherwise(F.col(field)).alias(field)

    given = F.when(F.col("_set_config").isNotNull(), F.to_json("_new_config"))
    fresh = joined.withColumn("_plain", given).withColumn("_iv", F.when(F.col("_plain").isNotNull(), crypto.random_iv()))
    return fresh.select(
        "id",
        "workspace_id",
        merged("name"),
        merged("type"),
        F.coalesce(crypto.encrypt(F.col("_plain"), key_hex, F.col("_iv")), "encrypted_config").alias("encrypted_config"),
        F.coalesce("_iv", "iv").alias("iv"),
        F.when(recreated, F.col("_created_at")).otherwise(F.col("created_at")).alias("created_at"),
        F.coalesce("_updated_at", "updated_at").alias("updated_at"),
    )


# --- credentials --------------------------------------------------------------------------


def encrypt_column(df: DataFrame, column: str, key_hex: Column, iv_hex: Column | None = None) -> DataFrame:
    """Add `encrypted_config` and `iv`. Without `iv_hex` every row gets a random IV."""
    return df.withColumn("iv", crypto.random_iv() if iv_hex is None else iv_hex).withColumn(
        "encrypted_config", crypto.encrypt(F.col(column), key_hex, F.col("iv"))
    )


def decrypt_column(df: DataFrame, key_hex: Column) -> DataFrame:
    """Add `config`, NULL where it cannot be decrypted; such rows belong in quarantine."""
    return df.withColumn("config", crypto.try_decrypt(F.col("encrypted_config"), key_hex, F.col("iv")))


def reencrypt_changed(
    destinations: DataFrame, changes: DataFrame, key_hex: Column, changed_at: Column
) -> DataFrame:
    """Apply destination changes (id, workspace_id, version, name, type, config; NULL = absent).

    Of several changes to one destination the last given value of each field counts.
    Ciphertext and IV stay untouched unless a new config is given.
    """
    renamed = changes.groupBy("id", "workspace_id").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("version"))).alias(f"_{c}") for c in ("name", "type", "config")]
    )
    joined = destinations.join(renamed.withColumn("_hit", F.lit(True)), ["id", "workspace_id"], "left")
    fresh = joined.withColumn("_iv", F.when(F.col("_config").isNotNull(), crypto.random_iv()))
    return fresh.select(
        "id",
        "workspace_id",
        F.coalesce("_name", "name").alias("name"),
        F.coalesce("_type", "type").alias("type"),
        F.coalesce(crypto.encrypt(F.col("_config"), key_hex, F.col("_iv")), "encrypted_config").alias("encrypted_config"),
        F.coalesce("_iv", "iv").alias("iv"),
        "created_at",
        F.when(F.col("_hit"), changed_at).otherwise(F.col("updated_at")).alias("updated_at"),
    )
