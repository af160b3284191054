"""Writes of deliveries by destination type.

Databases get a JDBC append and object stores get files. The other kinds are
services behind somebody's network endpoint; their requests are rendered into an
outbox table, partitioned by type, for a sender to work off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How each destination type is served.
JDBC_TYPES = ("postgres", "mysql")
FILE_TYPES = ("s3",)
OUTBOX_TYPES = ("slack", "discord", "webhook", "email", "elasticsearch")


def rendered_body() -> Column:
    """Request body for an outbox type, from the columns of a delivery."""
    line = F.concat(F.col("event_name"), F.lit(" "), F.col("payload"))
    kind = F.col("type")
    document = F.struct("event_id", "event_name", F.parse_json("payload").alias("properties"))
    return (
        F.when(kind == "slack", F.to_json(F.struct(line.alias("text"))))
        .when(kind == "discord", F.to_json(F.struct(line.alias("content"))))
        .when(kind == "email", F.to_json(F.struct(F.col("event_name").alias("subject"), line.alias("body"))))
        .otherwise(F.to_json(document))
    )


def outbox(deliveries: DataFrame) -> DataFrame:
    """Outbox rows of the types that have no Spark writer."""
    return deliveries.filter(F.col("type").isin(*OUTBOX_TYPES)).select(
        "id", "event_id", "destination_id", "type", rendered_body().alias("body")
    )


def database_rows(deliveries: DataFrame, kind: str) -> DataFrame:
    return deliveries.filter(F.col("type") == kind).select(
        "id", "workspace_id", "event_id", "event_name", "destination_id", "payload"
    )


def write_deliveries(
    deliveries: DataFrame, path: str, jdbc: dict[str, dict[str, str]] | None = None, mode: str = "append"
) -> None:
    """Write deliveries by type under `path`.

    `jdbc` maps postgres / mysql to writer options (url, dbtable, …). A database type
    without options goes to files under its name, so no delivery is lost. Pass a
    written or persisted frame: each branch scans it.
    """
    for kind in JDBC_TYPES:
        rows = database_rows(deliveries, kind)
        options = (jdbc or {}).get(kind)
        if options:
            rows.write.format("jdbc").options(**options).mode("append").save()
        else:
            rows.write.mode(mode).parquet(f"{path}/database/type={kind}")
    files = deliveries.filter(F.col("type").isin(*FILE_TYPES))
    files.hint("rebalance", "workspace_id").write.mode(mode).partitionBy("workspace_id").json(f"{path}/objects")
    outbox(deliveries).write.mode(mode).partitionBy("type").parquet(f"{path}/outbox")
