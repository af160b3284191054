"""Exponential retry delays."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Backoff:
    """`base_ms * 2 ** (attempt - first_attempt)`, capped, for at most `max_retries` retries."""

    base_ms: int
    cap_ms: int
    max_retries: int
    first_attempt: int


# Fixed values of the two schedules in use: key store and message broker.
KEY_STORE = Backoff(base_ms=500, cap_ms=30_000, max_retries=10, first_attempt=1)
BROKER = Backoff(base_ms=1000, cap_ms=30_000, max_retries=10, first_attempt=0)


def delay_ms(attempt: Column, policy: Backoff) -> Column:
    doubled = policy.base_ms * F.pow(F.lit(2.0), attempt - policy.first_attempt)
    return F.least(doubled, F.lit(float(policy.cap_ms))).cast("bigint")


def exhausted(attempt: Column, policy: Backoff) -> Column:
    return (attempt - policy.first_attempt) >= policy.max_retries
