"""Identify, group and page events, typed context, and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penstock import schema


def context_flatten(events: DataFrame) -> DataFrame:
    """Typed columns out of the open context; other keys of it stay where they are."""
    c = F.from_json("context", schema.CONTEXT)
    typed = events.withColumn("_c", c)
    nested = {
        "app": ("name", "version"),
        "os": ("name", "version"),
        "page": ("url", "title", "referrer"),
        "campaign": ("source", "medium", "name"),
    }
    return typed.select(
        *events.columns,
        *[F.col(f"_c.{group}.{leaf}").alias(f"{group}_{leaf}") for group, leaves in nested.items() for leaf in leaves],
        F.col("_c.locale").alias("locale"),
        F.col("_c.timezone").alias("timezone"),
        F.col("_c.ip").alias("ip"),
        F.col("_c.userAgent").alias("user_agent"),
    )


def page_events(events: DataFrame, names: tuple[str, ...] = ("app.view",)) -> DataFrame:
    """Page rows: name of the page, who, properties and context."""
    page_name = F.coalesce(F.get_json_object("context", "$.page.title"), F.col("event_name"))
    return events.filter(F.col("event_name").isin(*names)).select(
        "event_id", page_name.alias("name"), "user_id", "anonymous_id", "properties", "context"
    )


def _latest_by_key(calls: DataFrame, owner: str) -> DataFrame:
    """Latest value of every trait key per owner, as JSON text."""
    entries = calls.select(
        owner, "seen_at", "id", F.explode(F.from_json("traits", "map<string,variant>")).alias("key", "_value")
    )
    return (
        entries.withColumn("value", F.to_json("_value"))
        .groupBy(owner, "key")
        .agg(F.max_by("value", F.struct("seen_at", "id")).alias("value"))
    )


def _merged(latest: DataFrame, owner: str) -> DataFrame:
    """One JSON object per owner, keys in order. A group is as large as the owner has trait names."""
    pairs = F.array_sort(F.collect_list(F.struct("key", "value")))
    merged = F.transform_values(F.map_from_entries(pairs), lambda _, text: F.parse_json(text))
    return latest.groupBy(owner).agg(F.to_json(merged).alias("traits"))


def identify_traits(identifies: DataFrame) -> DataFrame:
    """Latest traits per user, merged key by key: a key keeps its last value."""
    return _merged(_latest_by_key(identifies, "user_id"), "user_id")


def group_membership(groups: DataFrame) -> DataFrame:
    """Groups of each user with first and last call, and the merged traits of the group."""
    members = groups.groupBy("user_id", "group_id").agg(
        F.min("seen_at").alias("first_at"), F.max("seen_at").alias("last_at"), F.count(F.lit(1)).alias("calls")
    )
    traits = _merged(_latest_by_key(groups, "group_id"), "group_id")
    return members.join(traits, "group_id", "left")


def session_rollup(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Events per session: by session id where there is one, else by gaps per person.

    With the library's session settings, gap sessions are merged within each input partition
    first, so that a busy person reaches the shuffle as sessions, not as events.
    """
    rows = events.withColumn("who", F.coalesce("user_id", "anonymous_id"))

    def measures() -> list[Column]:
        return [
            F.count(F.lit(1)).alias("events"),
            F.min("received_at").alias("started_at"),
            F.max("received_at").alias("ended_at"),
        ]

    named = (
        rows.filter(F.col("session_id").isNotNull())
        .groupBy("workspace_id", "session_id")
        .agg(*measures())
        .select("workspace_id", F.lit("id").alias("kind"), F.col("session_id").alias("session"), "events", "started_at", "ended_at")
    )
    gaps = (
        rows.filter(F.col("session_id").isNull())
        .groupBy("workspace_id", "who", F.session_window("received_at", gap).alias("w"))
        .agg(*measures())
        .select("workspace_id", F.lit("gap").alias("kind"), F.col("who").alias("session"), "events", "started_at", "ended_at")
    )
    return named.unionByName(gaps)
