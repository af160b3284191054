"""Identifiers: v4-shaped ids from content, and the v4 check."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UUID_V4 = r"(?i)\A[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\z"
UUID_ANY = r"(?i)\A[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"


def v4_from_hex(digest: Column) -> Column:
    """Shape the first digits of a hex digest as a v4 UUID."""
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("4"), F.substring(digest, 14, 3)),
        F.concat(F.lit("a"), F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def content_id(*parts: Column | str) -> Column:
    """An id that depends only on the row, so a recomputed task yields the same one.

    `uuid()` would give a retried task new ids after a shuffle has used the old ones.
    """
    text = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return v4_from_hex(F.sha2(F.concat_ws("|", *text), 256))


def is_uuid_v4(text: Column) -> Column:
    return text.rlike(UUID_V4)


def is_uuid(text: Column) -> Column:
    return text.rlike(UUID_ANY)
