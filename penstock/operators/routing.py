"""Topic routing of messages to queues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penstock.functions import topics


def route_topics(messages: DataFrame, bindings: DataFrame) -> DataFrame:
    """Add `queue`: one row per message and queue with a binding that matches its routing key.

    Patterns meet distinct routing keys, not messages: a key is matched once however
    many messages carry it. Both sides join on the literal words a pattern starts and
    ends with: a key of n words offers its (n + 1)² pairs of ends, so the regular
    expression only decides what lies between. The result joins back to the messages
    by key. A message that several bindings send to one queue reaches it once.
    """
    prefixes, suffixes = topics.possible_ends(F.col("routing_key"))
    ends = ["_prefix", "_suffix"]
    keys = (
        messages.select("routing_key")
        .distinct()
        .select("routing_key", topics.dotted(F.col("routing_key")).alias("_dotted"), F.explode(prefixes).alias("_prefix"))
        .select("*", F.explode(suffixes).alias("_suffix"))
    )
    prefix, suffix = topics.literal_ends(F.col("pattern"))
    patterns = bindings.select(
        "queue", topics.topic_regex(F.col("pattern")).alias("_regex"), prefix.alias("_prefix"), suffix.alias("_suffix")
    )
    routes = (
        keys.join(patterns, ends)
        .filter(F.rlike("_dotted", F.col("_regex")))
        .select("routing_key", "queue")
        .distinct()
    )
    return messages.join(routes, "routing_key")
