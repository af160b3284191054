"""Triggers and steps: which pipelines an event starts, and what they do with it.

Step configs are data, not code: they are parsed once per pipeline on the small
side, and evaluated against every matched event with built-in functions.

Clauses: `{field, op, value}` with op eq, ne, gt, gte, lt, lte, in, exists,
contains or regex; all must hold; a field that is missing, or not a number where
one is compared, does not hold. `field` is `properties.<key>`, `context.<path>` or
an envelope field (event, source, version, userId, anonymousId, sessionId).
`minTotal: n` is short for `properties.total >= n`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penstock.functions import ids
from penstock.functions import variants as v
from penstock.operators.config import enabled_pipelines

CLAUSES = "array<struct<field:string,op:string,value:string>>"
SENDS = "array<struct<step_id:string,destination_id:string,payload:string>>"
# Envelope fields a clause may name, and the columns behind them.
ENVELOPE = {
    "event": "event_name",
    "source": "source",
    "version": "version",
    "userId": "user_id",
    "anonymousId": "anonymous_id",
    "sessionId": "session_id",
}


#: Versions of reference tables whose keys were found to be unique.
_CHECKED: set[tuple[str, str]] = set()


@dataclass(frozen=True)
class Enrichment:
    """A reference table that enrich steps may name: `key` holds the values of the event field `on`.

    `version` names the state of the table (a snapshot's path, say); its keys are
    checked once per version, or each time where there is none.
    """

    table: DataFrame
    key: str
    on: str = "userId"
    version: str | None = None

    def checked(self) -> Enrichment:
        """Refuse a table with repeated keys, which would multiply events."""
        if (self.version, self.key) not in _CHECKED:
            if not self.table.groupBy(self.key).count().filter("count > 1").isEmpty():
                raise ValueError(f"enrichment key {self.key} is not unique")
            if self.version is not None:
                _CHECKED.add((self.version, self.key))
        return self


# --- config side --------------------------------------------------------------------------


def _parsed_step(step: Column) -> Column:
    """A step with its config parsed, once, for the many uses in `_typed_step`."""
    return F.struct(
        step.id.alias("id"),
        step.type.alias("type"),
        F.from_json(step.config, "map<string,variant>").alias("config"),
    )


OPERATIONS = ("eq", "ne", "gt", "gte", "lt", "lte", "in", "exists", "contains", "regex")


def _checked_clause(clause: Column) -> Column:
    """The clause, without its operation if that is unknown or its pattern doesn't compile."""
    compiles = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), clause.value).isNotNull()
    sound = clause.op.isin(*OPERATIONS) & ((clause.op != "regex") | compiles)
    return F.struct(clause.field.alias("field"), F.when(sound, clause.op).alias("op"), clause.value.alias("value"))


def _typed_step(step: Column) -> Column:
    config = step.config
    shorthand = F.transform(
        F.filter(F.map_keys(config), lambda k: k.rlike("^min[A-Z]")),
        lambda k: F.struct(
            F.concat(F.lit("properties."), F.lower(F.substr(k, F.lit(4), F.lit(1))), F.substr(k, F.lit(5))).alias("field"),
            F.lit("gte").alias("op"),
            v.text(config[k]).alias("value"),
        ),
    )
    none = F.array().cast(CLAUSES)
    given = F.concat(F.coalesce(F.from_json(v.text(config["clauses"]), CLAUSES), none), F.coalesce(shorthand, none))
    clauses = F.transform(given, _checked_clause)
    return F.struct(
        step.id.alias("id"),
        step.type.alias("type"),
        clauses.alias("clauses"),
        F.exists(clauses, lambda c: c.op.isNull()).alias("bad_filter"),
        F.coalesce(F.try_variant_get(config["remove"], "$", "array<string>"), F.array().cast("array<string>")).alias("remove"),
        F.try_variant_get(config["rename"], "$", "map<string,string>").alias("rename"),
        config["set"].try_cast("map<string,variant>").alias("set"),
        v.text(config["table"]).alias("table"),
        v.text(config["on"]).alias("on"),
        F.try_variant_get(config["select"], "$", "array<string>").alias("select"),
        F.coalesce(v.text(config["prefix"]), F.lit("")).alias("prefix"),
        v.text(config["destinationId"]).alias("destination_id"),
    )


def typed_pipelines(pipelines: DataFrame, destinations: DataFrame | None = None) -> DataFrame:
    """Enabled pipelines with parsed steps and the destinations they may send to.

    Destinations are resolved here, between the two config tables, so that the
    events need no join of their own for it. `targets` maps the ids found in the
    pipeline's workspace to type and name.
    """
    typed = enabled_pipelines(pipelines).select(
        F.col("id").alias("pipeline_id"),
        "workspace_id",
        F.array_distinct("trigger.events").alias("trigger_events"),
        F.transform(F.transform("steps", _parsed_step), _typed_step).alias("steps"),
    )
    if destinations is None:
        return typed
    wanted = typed.select(
        "pipeline_id",
        "workspace_id",
        F.explode(F.array_distinct(F.transform("steps", lambda s: s.destination_id))).alias("destination_id"),
    ).filter(F.col("destination_id").isNotNull())
    found = destinations.select(
        F.col("id").alias("destination_id"), "workspace_id", F.struct("type", "name").alias("_target")
    )
    targets = (
        wanted.join(found, ["workspace_id", "destination_id"])
        .groupBy("pipeline_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("destination_id", "_target"))).alias("targets"))
    )
    return typed.join(targets, "pipeline_id", "left")


# --- trigger ------------------------------------------------------------------------------


def trigger_match(events: DataFrame, typed: DataFrame) -> DataFrame:
    """One row per event and enabled pipeline of its workspace that lists its name, with the `pipeline_id`.

    Names match exactly. `typed` comes from `typed_pipelines`; a name listed twice
    in one trigger counts once. Only ids and names are shuffled with the events: `attach_steps` brings the steps.
    """
    triggers = typed.select("pipeline_id", "workspace_id", F.explode("trigger_events").alias("event_name"))
    return events.join(triggers, ["workspace_id", "event_name"])


def attach_steps(matched: DataFrame, typed: DataFrame) -> DataFrame:
    """Add what `typed` has of each pipeline (steps, targets), as the last thing before steps run."""
    return matched.join(typed.drop("workspace_id", "trigger_events"), "pipeline_id")


# --- single steps as column expressions ---------------------------------------------------


def field_text(field: Column, props: Column) -> Column:
    """Text of the value a clause names; NULL when missing or null."""
    envelope = F.create_map(
        *[part for name, column in ENVELOPE.items() for part in (F.lit(name), F.col(column))]
    )
    return (
        F.when(field.startswith("properties."), v.text(F.element_at(props, F.substr(field, F.lit(12)))))
        .when(
            field.startswith("context."),
            F.call_function(
                "get_json_object", F.col("context"), F.concat(F.lit("$."), F.substr(field, F.lit(9)))
            ),
        )
        .otherwise(F.element_at(envelope, field))
    )


def clause_holds(clause: Column, props: Column) -> Column:
    actual = field_text(clause.field, props)
    wanted = clause.value
    a, w = actual.try_cast("double"), wanted.try_cast("double")
    same = F.when(a.isNotNull() & w.isNotNull(), a == w).otherwise(actual == wanted)
    held = (
        F.when(clause.op == "eq", same)
        .when(clause.op == "ne", ~same)
        .when(clause.op == "gt", a > w)
        .when(clause.op == "gte", a >= w)
        .when(clause.op == "lt", a < w)
        .when(clause.op == "lte", a <= w)
        .when(clause.op == "in", F.array_contains(F.from_json(wanted, "array<string>"), actual))
        .when(clause.op == "exists", actual.isNotNull())
        .when(clause.op == "contains", F.contains(actual, wanted))
        .when(clause.op == "regex", F.rlike(actual, wanted))
    )
    return F.coalesce(held, F.lit(False))


def filter_holds(step: Column, props: Column) -> Column:
    return F.forall(step.clauses, lambda c: clause_holds(c, props))


def transformed(step: Column, props: Column) -> Column:
    """Properties after remove, then rename, then set; types of the values are kept."""
    no_names = F.create_map().cast("map<string,string>")
    no_values = F.create_map().cast("map<string,variant>")
    names = F.coalesce(step.rename, no_names)
    values = F.coalesce(step["set"], no_values)
    kept = F.map_filter(props, lambda k, _: ~F.array_contains(step.remove, k))
    # A renamed key replaces one that already has the new name.
    taken = F.map_values(F.map_filter(names, lambda k, _: F.map_contains_key(kept, k)))
    free = F.map_filter(kept, lambda k, _: F.map_contains_key(names, k) | ~F.array_contains(taken, k))
    renamed = F.transform_keys(free, lambda k, _: F.coalesce(F.element_at(names, k), k))
    left = F.map_filter(renamed, lambda k, _: ~F.map_contains_key(values, k))
    return F.map_concat(left, values)


def enriched(step: Column, props: Column, found: Column) -> Column:
    """Properties plus the selected reference fields, prefixed; `found` is a map, NULL when unmatched."""
    chosen = F.map_filter(
        found, lambda k, _: F.coalesce(F.array_contains(step["select"], k), F.lit(True))
    )
    added = F.transform_values(
        F.transform_keys(chosen, lambda k, _: F.concat(step.prefix, k)),
        lambda _, value: value.cast("variant"),
    )
    left = F.map_filter(props, lambda k, _: ~F.map_contains_key(added, k))
    return F.when(found.isNull(), props).otherwise(F.map_concat(left, added))


# --- single steps as operators ------------------------------------------------------------


def with_props(events: DataFrame) -> DataFrame:
    """Add `props`, the open properties as MAP<STRING, VARIANT>."""
    return events.withColumn("props", F.from_json("properties", "map<string,variant>"))


def filter_step(rows: DataFrame, step: Column) -> DataFrame:
    """Keep the rows whose clauses in `step` all hold."""
    return rows.filter(filter_holds(step, F.col("props")))


def transform_step(rows: DataFrame, step: Column) -> DataFrame:
    return rows.withColumn("props", transformed(step, F.col("props")))


def attach_reference(rows: DataFrame, name: str, enrichment: Enrichment) -> DataFrame:
    """Add `_ref_<name>`, the matching reference row as a map: the left outer join of an enrich step."""
    checked = enrichment.checked()
    columns = [c for c in checked.table.columns if c != checked.key]
    entries = F.create_map(
        *[part for c in columns for part in (F.lit(c), F.col(c).cast("string"))]
    )
    event_column = ENVELOPE[checked.on]
    reference = checked.table.select(F.col(checked.key).alias(event_column), entries.alias(f"_ref_{name}"))
    return rows.join(reference, event_column, "left")


def enrich_step(rows: DataFrame, step: Column, name: str, enrichment: Enrichment) -> DataFrame:
    """Widen `props` from one reference table; unmatched rows stay as they are."""
    joined = attach_reference(rows, name, enrichment)
    return joined.withColumn("props", enriched(step, F.col("props"), F.col(f"_ref_{name}"))).drop(
        f"_ref_{name}"
    )


# --- all steps in order -------------------------------------------------------------------


def run_steps(events: DataFrame, typed: DataFrame, enrichments: dict[str, Enrichment]) -> DataFrame:
    """Run the steps of every pipeline that an event triggers, in order: one row per event and pipeline.

    Adds `props` (the final properties), `alive` (no filter dropped it), `error`
    (first data error, which ends the run) and `sends`, one entry per destination
    step reached. The steps are folded over a state of these four, whatever their
    number. Events are parsed and meet the reference tables before they multiply by their
    pipelines, and the steps come last, when no shuffle is left to carry them.
    """
    rows = with_props(events)
    for name, enrichment in enrichments.items():
        rows = attach_reference(rows, name, enrichment)
    rows = attach_steps(trigger_match(rows, typed), typed)
    kept = [c for c in rows.columns if c != "props" and not c.startswith("_ref_")]
    start = F.struct(
        F.col("props").alias("props"),
        F.lit(True).alias("alive"),
        F.lit(None).cast("string").alias("error"),
        F.array().cast(SENDS).alias("sends"),
    )

    def advance(state: Column, step: Column) -> Column:
        props = state.props
        active = state.alive & state.error.isNull()
        known = _known_reference(step, enrichments)
        widened = props
        for name in enrichments:
            widened = F.when(step.table == name, enriched(step, props, F.col(f"_ref_{name}"))).otherwise(widened)
        send = F.array(
            F.struct(
                step.id.alias("step_id"),
                step.destination_id.alias("destination_id"),
                F.to_json(F.to_variant_object(props)).alias("payload"),  # keys in order
            )
        ).cast(SENDS)
        sending = (step.type == "destination") & step.destination_id.isNotNull()
        broken = (
            F.when((step.type == "filter") & step.bad_filter, "bad_filter")
            .when((step.type == "enrich") & ~known, "bad_enrichment")
            .when((step.type == "destination") & ~sending, "bad_destination")
        )
        moved = F.struct(
            F.when(step.type == "transform", transformed(step, props))
            .when((step.type == "enrich") & known, widened)
            .otherwise(props)
            .alias("props"),
            F.when(step.type == "filter", filter_holds(step, props)).otherwise(F.lit(True)).alias("alive"),
            broken.alias("error"),
            F.when(sending, F.concat(state.sends, send)).otherwise(state.sends).alias("sends"),
        )
        return F.when(active, moved).otherwise(state)

    folded = rows.withColumn("_state", F.aggregate("steps", start, advance))
    return folded.select(*kept, "_state.props", "_state.alive", "_state.error", "_state.sends")


def _known_reference(step: Column, enrichments: dict[str, Enrichment]) -> Column:
    known = F.lit(False)
    for name, enrichment in enrichments.items():
        known = known | ((step.table == name) & (F.coalesce(step.on, F.lit(enrichment.on)) == enrichment.on))
    return F.coalesce(known, F.lit(False))


# --- results ------------------------------------------------------------------------------


def destination_fanout(executed: DataFrame) -> DataFrame:
    """One row per send, with the destination's type, or NULL type where it does not exist.

    The outer generator with a filter behind it keeps the optimizer from copying the
    whole fold into a filter before the explode.
    """
    return (
        executed.select("*", F.explode_outer("sends").alias("_send"))
        .filter(F.col("_send").isNotNull())
        .withColumn("_target", F.element_at("targets", F.col("_send.destination_id")))
        .select(
            ids.content_id(F.lit("delivery"), "event_id", "pipeline_id", F.col("_send.step_id")).alias("id"),
            "workspace_id",
            "event_id",
            "event_name",
            "correlation_id",
            "pipeline_id",
            F.col("_send.step_id").alias("step_id"),
            F.col("_send.destination_id").alias("destination_id"),
            F.col("_target.type").alias("type"),
            F.col("_send.payload").alias("payload"),
            "ingested_at",
        )
    )


def deliveries(fanned: DataFrame) -> DataFrame:
    return fanned.filter(F.col("type").isNotNull())


def unknown_destinations(fanned: DataFrame) -> DataFrame:
    return fanned.filter(F.col("type").isNull())


def pipeline_executions(executed: DataFrame, started_at: Column, completed_at: Column) -> DataFrame:
    """One row per (event, pipeline): failed on a data error or an unknown destination, else completed.

    An event that a filter dropped is completed, with no deliveries.
    """
    unknown = F.exists("sends", lambda s: F.element_at("targets", s.destination_id).isNull() | F.col("targets").isNull())
    error = F.coalesce("error", F.when(unknown, "unknown_destination"))
    return executed.select(
        ids.content_id(F.lit("execution"), "event_id", "pipeline_id").alias("id"),
        "pipeline_id",
        "event_id",
        "correlation_id",
        F.when(error.isNotNull(), "failed").otherwise("completed").alias("status"),
        started_at.alias("started_at"),
        completed_at.alias("completed_at"),
        error.alias("error"),
        F.size("sends").alias("n_sends"),
    )


def execution_rollup(executions: DataFrame) -> DataFrame:
    """Per pipeline and status: executions, sends, and mean and longest duration in milliseconds."""
    took = F.unix_millis("completed_at") - F.unix_millis("started_at")
    return executions.groupBy("pipeline_id", "status").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("n_sends").alias("n_sends"),
        F.avg(took).alias("mean_ms"),
        F.max(took).alias("max_ms"),
    )
