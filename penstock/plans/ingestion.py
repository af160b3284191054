"""The ingestion job: raw requests to stored events, messages, replies and rejects."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penstock.operators import ingest, requests
from penstock.session import staged


@dataclass(frozen=True)
class Ingested:
    """What a run of requests leads to; all frames are lazy over staged tables."""

    validated: DataFrame
    labelled: DataFrame

    @property
    def quarantine(self) -> DataFrame:
        return requests.quarantine_events(self.validated)

    @property
    def stored(self) -> DataFrame:
        return ingest.accepted_rows(self.labelled)

    @property
    def messages(self) -> DataFrame:
        return ingest.event_envelope(self.labelled.filter(F.col("status") == "accepted"))

    @property
    def results(self) -> DataFrame:
        return ingest.ingest_results(self.labelled)

    @property
    def summary(self) -> DataFrame:
        return ingest.batch_summary(self.labelled)


def validated_requests(raw: DataFrame) -> DataFrame:
    return requests.validate_events(requests.parse_raw_events(raw))


def validated_batches(bodies: DataFrame) -> DataFrame:
    """Events of batch bodies with `errors` and `admitted`."""
    return requests.batch_admission(bodies)


def ingest_requests(raw: DataFrame, store: DataFrame | None = None, stage: bool = True, columns: tuple[str, ...] | None = None) -> Ingested:
    """Single requests. Staging writes the normalized rows once, so that JSON is parsed
    once and the search for first arrivals reads three columns. `columns` names the ones
    that are wanted of the labelled rows, beside those that dedupe needs."""
    validated = validated_requests(raw)
    rows = ingest.normalize_events(requests.valid_events(validated))
    if columns is not None:
        rows = rows.select("event_id", *ingest.REQUEST_ORDER, *columns)
    rows = staged(rows, "arrivals") if stage else rows
    return Ingested(validated, ingest.dedupe_status(rows, store, order=ingest.REQUEST_ORDER))


def ingest_batches(bodies: DataFrame, store: DataFrame | None = None, stage: bool = True, columns: tuple[str, ...] | None = None) -> Ingested:
    """Batch calls: all events of a batch are admitted or none is. `columns` as in `ingest_requests`."""
    validated = validated_batches(bodies)
    rows = ingest.normalize_events(validated.filter("admitted"))
    if columns is not None:
        rows = rows.select("event_id", *ingest.REQUEST_ORDER, *columns)
    rows = staged(rows, "arrivals") if stage else rows
    return Ingested(validated, ingest.dedupe_status(rows, store, order=ingest.REQUEST_ORDER))
