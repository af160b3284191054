"""ISO-8601 text and millisecond timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO = (
    r"\A\d{4}(-\d{2}(-\d{2}([T ]\d{2}(:\d{2}(:\d{2}(\.\d+)?)?)?"
    r"([zZ]|[+-]\d{2}(:?\d{2})?)?)?)?)?\z"
)
# The form that a cast reads as it is, whatever stands in the other parts.
WHOLE = r"\A\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?Z\z"
# Valid ISO-8601 that a date constructor cannot read: basic, week and ordinal dates, comma fractions.
ISO_UNSUPPORTED = r"\A\d{4}(\d{4}|-?W\d{2}(-?[1-7])?|-?\d{3})([T ].*)?\z|\A\d{4}-\d{2}-\d{2}[T ][\d:]+,\d+.*\z"


def moment(text: Column) -> Column:
    """Timestamp of an ISO-8601 text, NULL unless a real calendar moment."""
    upper = F.upper(text)
    seconds = F.regexp_replace(upper, r"\A(.{10}[T ]\d{2}:\d{2})(?!:|\d)", "$1:00")
    hours = F.regexp_replace(seconds, r"\A(.{10}[T ]\d{2})(?!:|\d)", "$1:00:00")
    offset = F.regexp_replace(hours, r"([T ].*[+-]\d{2})\z", "$1:00")
    return F.when(text.rlike(WHOLE), text.try_cast("timestamp")).when(text.rlike(ISO), offset.try_cast("timestamp"))


def parse_iso(text: Column) -> Column:
    """Timestamp at millisecond precision, NULL unless a real calendar moment."""
    return F.date_trunc("MILLISECOND", moment(text))


def iso_millis(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
