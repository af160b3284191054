"""Batch bodies: judged once, and as single requests are judged."""

import datetime
import json
import uuid

import pytest
from pyspark.sql import functions as F

from penstock.operators import ingest, requests
from penstock.plans import ingestion

BODY = "batch_id string, arrival_seq long, workspace_id string, arrived_at timestamp, raw string"
GOOD = {"event": "order.created", "source": "shop", "version": "1.0", "userId": "u"}


def good(**fields):
    return GOOD | {"correlationId": str(uuid.uuid4()), "eventId": str(uuid.uuid4())} | fields


def frame(spark, bodies):
    at = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(name, 0, place, at, raw if raw is None else json.dumps(raw)) for name, place, raw in bodies], BODY)


ODD = [
    None, 5, "x", [], {}, good(event="X"), good(event="order.created\n"), good(correlationId=None), good(eventId=""), good(eventId=7),
    good(timestamp="2024-02-30T00:00:00Z"), good(timestamp="2024-02-29T10:00:00.5z"), good(timestamp="2024-02-29 10:00:00Z"), good(timestamp="2024-02-29T24:00:00Z"),
    good(timestamp="20240229"), good(timestamp=1), good(timestamp=None), good(source=""), good(version=1), good(userId=None), good(userId=0), good(userId=""),
    good(userId=None, anonymousId="a"), good(userId=0, anonymousId="a"), good(anonymousId=False), good(anonymousId=0.0), good(sessionId=1), good(sessionId=None),
    good(properties=[1]), good(properties=None), good(properties={}), good(context="x"), good(context={"a": {"b": 1}}), good(foo=1),
]
BODIES = [
    *[(f"odd_{i}", "ws", {"events": [good(), event, good()]}) for i, event in enumerate(ODD)],
    ("two", "ws", {"events": [good(foo=1), good(), good(event=1)]}), ("nowhere", None, {"events": [good()]}), ("blank", "", {"events": [good()]}),
    ("stray", "ws", {"events": [good()], "extra": 1}), ("none", None, {"events": []}), ("scalar", "ws", {"events": 5}), ("object", "ws", {"events": {"a": 1}}),
    ("null", "ws", {"events": None}), ("other", "ws", {}), ("list", "ws", [good()]), ("missing", "ws", None),
    ("full", "ws", {"events": [good() for _ in range(100)]}), ("over", "ws", {"events": [good() for _ in range(101)]}), ("late", "ws", {"events": [*[good() for _ in range(101)], 1]}),
]


def test_bodies_are_judged_as_single_requests_are(spark):
    """Errors of each event, and the verdict that follows from all of a body's errors."""
    bodies = frame(spark, BODIES)
    listed = requests.batch_admission(bodies).collect()
    alone = requests.validate_events(requests.parse_raw_events(requests.explode_event_batch(bodies).filter("pos is not null"))).collect()
    alone = {(r.batch_id, r.pos): [tuple(e) for e in r.errors] for r in alone}
    broken = {}
    for r in listed:
        errors = [tuple(e) for e in r.errors]
        own = [e for e in errors if e[0] == "events" or e == ("extra", "property extra should not exist")]
        assert r.pos is None or [e for e in errors if e not in own] == alone[r.batch_id, r.pos], r.batch_id
        broken[r.batch_id] = broken.get(r.batch_id, 0) + len(errors)
    assert {r.batch_id: r.admitted for r in listed} == {name: n == 0 for name, n in broken.items()}
    assert {"full", "odd_11", "odd_22"} <= {r.batch_id for r in listed if r.admitted} and len(broken) == len(BODIES)
    assert {(r.batch_id, r.pos) for r in listed if r.pos is not None} == set(alone)


def test_bodies_are_parsed_and_judged_once(spark):
    """A filter on the verdict doesn't take the parse and the rules along."""
    admitted = ingestion.validated_batches(frame(spark, BODIES[:1])).filter("admitted").select("batch_id", "pos", "m")
    plan = admitted._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1
    assert plan.count(requests.EVENT_NAME) == 1  # the rule for event names


@pytest.mark.parametrize("columns", [None, ()])
def test_replies_and_counts_need_few_columns(spark, columns):
    same = str(uuid.uuid4())
    bodies = frame(spark, [*BODIES, ("copies", "ws", {"events": [good(eventId=same), good(eventId=None), good(eventId=same)]})])
    run = ingestion.ingest_batches(bodies, columns=columns)
    [reply] = run.results.filter("batch_id = 'copies'").collect()
    assert [(r.pos, r.status) for r in reply.results] == [(0, "accepted"), (1, "accepted"), (2, "duplicate")]
    assert reply.results[0].event_id == reply.results[2].event_id == same
    admitted = requests.batch_admission(bodies).filter("admitted").groupBy("batch_id").count().collect()
    assert {r.batch_id: r.accepted + r.duplicates + r.conflicts for r in run.summary.collect()} == {r.batch_id: r["count"] for r in admitted}
    assert set(ingest.REQUEST_ORDER) < set(run.labelled.columns)
    assert (len(run.labelled.columns) > 10) == (columns is None)
