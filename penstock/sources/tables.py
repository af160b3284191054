"""The event store, config tables, and versioned table folders on Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penstock import schema


#: Splits from which an input is left as it is, however many cores there are.
SPLITS = 8


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hand an input of few splits (an unsplittable file or two) to all cores; any larger one passes without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= min(cores, SPLITS) else df.repartition(cores, *keys)


def append_events(stored: DataFrame, path: str, mode: str = "append") -> None:
    """Append accepted rows, partitioned by the day of the event.

    Rows are brought together by day, and a day is cut into parts by its size: small
    days become one file, large ones as many as the advisory partition size asks for.
    """
    (
        stored.withColumn("received_date", F.to_date("received_at"))
        .hint("rebalance", "received_date")
        .write.mode(mode)
        .partitionBy("received_date")
        .parquet(path)
    )


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{schema.STORE}, received_date DATE").parquet(path)


def config_scan(spark: SparkSession, path: str, workspace_id: str | None = None) -> DataFrame:
    """Pipelines or destinations, of one workspace if given; the filter reaches the Parquet scan."""
    rows = spark.read.parquet(path)
    return rows if workspace_id is None else rows.filter(F.col("workspace_id") == workspace_id)


def write_read_model(daily: DataFrame, path: str) -> None:
    """Write daily rows partitioned by day, replacing only the days present; large days are cut by size."""
    (
        daily.hint("rebalance", "day")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("day")
        .parquet(path)
    )
