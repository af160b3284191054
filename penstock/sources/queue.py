"""Replayable queues as streaming sources: folders of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: A file is read by its row groups; of small ones every core gets some, however few the files are.
ROW_GROUP_BYTES = 16 << 20


def publish(envelopes: DataFrame, path: str, mode: str = "append") -> None:
    """Put envelope messages (routing_key, value, …) on a file queue."""
    envelopes.write.mode(mode).option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)


def queue_source(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1000) -> DataFrame:
    """Stream of a file queue. The checkpoint of the reading query holds its position,
    so an unfinished batch is delivered again; consumers must tolerate that."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(path)
    )


def identified(messages: DataFrame) -> DataFrame:
    """Adds the `message_id` that stands in the envelope."""
    return messages.withColumn("message_id", F.get_json_object("value", "$.meta.messageId"))


def consumed_once(messages: DataFrame) -> DataFrame:
    """Messages of a table without the copies that redelivery causes, by message id; `jobs.consume_once` does so over a stream."""
    return identified(messages).dropDuplicates(["message_id"])
