"""The validation matrix, with generated names, ids and moments."""

import datetime
import json
import re
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from penstock.functions import ids, times
from penstock.operators import ingest, requests

GOOD = {
    "event": "order.created", "correlationId": str(uuid.uuid4()), "source": "order-service", "version": "1.0", "userId": "user_123",
}


def errors_of(spark, bodies, workspace="ws"):
    raws = [(i, b if isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)]
    df = spark.createDataFrame(raws, "pos int, raw string").withColumn("workspace_id", F.lit(workspace))
    out = requests.validate_events(requests.parse_raw_events(df)).orderBy("pos").collect()
    return [[(e["field"], e["message"]) for e in row["errors"]] for row in out]


def fields_of(spark, bodies, workspace="ws"):
    return [sorted({field for field, _ in errors}) for errors in errors_of(spark, bodies, workspace)]


def changed(**fields):
    body = {**GOOD, **fields}
    return {k: x for k, x in body.items() if x is not ...}


CASES = [
    (GOOD, []),
    (changed(event="user.signed_up"), ["event"]),
    (changed(event="order.created\n"), ["event"]),
    (changed(event="Order.created"), ["event"]),
    (changed(event="order"), ["event"]),
    (changed(event=5), ["event"]),
    (changed(correlationId="not-a-uuid"), ["correlationId"]),
    (changed(correlationId=...), ["correlationId"]),
    (changed(correlationId=str(uuid.uuid1())), ["correlationId"]),
    (changed(correlationId=str(uuid.uuid4()).upper()), []),
    (changed(eventId=None), []),
    (changed(eventId=""), ["eventId"]),
    (changed(timestamp="2024-02-29T10:00:00.123Z"), []),
    (changed(timestamp="2024-02-29T10:00+05:30"), []),
    (changed(timestamp="2024-02-29"), []),
    (changed(timestamp="2023-02-29"), ["timestamp"]),
    (changed(timestamp="2024-W10-1"), ["timestamp"]),
    (changed(timestamp="yesterday"), ["timestamp"]),
    (changed(timestamp=1700000000), ["timestamp"]),
    (changed(source=" "), []),
    (changed(source=""), ["source"]),
    (changed(version=...), ["version"]),
    (changed(userId=...), ["anonymousId", "userId"]),
    (changed(userId="", anonymousId="a"), []),
    (changed(userId="", anonymousId=""), ["anonymousId", "userId"]),
    (changed(userId=5), ["userId"]),
    (changed(userId=0), ["anonymousId", "userId"]),
    (changed(userId="u", anonymousId=5), []),
    (changed(sessionId=""), []),
    (changed(sessionId=7), ["sessionId"]),
    (changed(properties=[1]), ["properties"]),
    (changed(properties="x"), ["properties"]),
    (changed(properties={"a": [1, {"b": None}]}), []),
    (changed(context=3), ["context"]),
    (changed(foo=1, bar=2), ["bar", "foo"]),
    ('{"event":"a.b"', ["body"]),
    ('{"a":1} x', ["body"]),
    # a repeated key is no error: its last value counts
    ('{"foo":1,"foo":2}', ["anonymousId", "correlationId", "event", "foo", "source", "userId", "version"]),
    (json.dumps(changed())[:-1] + ',"userId":"","userId":"u"}', []),
    (json.dumps(changed())[:-1] + ',"userId":"u","userId":5}', ["userId"]),
    ("{'a':1}", ["body"]),
    ("[1]", ["body"]),
    ("null", ["body"]),
    ("", ["body"]),
]


def test_matrix(spark):
    got = fields_of(spark, [body for body, _ in CASES])
    assert [(body, fields) for (body, _), fields in zip(CASES, got)] == CASES


def test_all_rules_report_and_workspace_comes_last(spark):
    [errors] = errors_of(spark, [{"event": "X", "foo": 1}], workspace="")
    fields = [field for field, _ in errors]
    assert fields[0] == "event" and fields[-1] == "x-workspace-id" and fields[-2] == "foo"
    assert ("foo", "property foo should not exist") in errors
    assert ("userId", "userId or anonymousId is required") in errors


def test_timestamp_messages(spark):
    first, second = errors_of(spark, [changed(timestamp="20240229"), changed(timestamp="2024-02-30T00:00:00Z")])
    assert first == [("timestamp", "unsupported timestamp form")]
    assert second == [("timestamp", "timestamp must be a valid ISO 8601 date string")]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text("aZ0._\n", max_size=8), min_size=30, max_size=30))
def test_event_names(spark, names):
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(F.col("n").rlike(requests.EVENT_NAME)).collect()]
    assert got == [re.fullmatch(r"[a-z][a-z0-9]*(\.[a-z][a-z0-9]*)+", n) is not None for n in names]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.uuids(), min_size=20, max_size=20))
def test_uuid_version(spark, values):
    df = spark.createDataFrame([(str(u),) for u in values], "u string")
    got = [r[0] for r in df.select(ids.is_uuid_v4(F.col("u"))).collect()]
    assert got == [u.version == 4 for u in values]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.datetimes(datetime.datetime(1971, 1, 1), datetime.datetime(2090, 1, 1)), min_size=20, max_size=20))
def test_iso_moments(spark, moments):
    df = spark.createDataFrame([(m.isoformat() + "Z",) for m in moments], "t string")
    got = [r[0] for r in df.select(F.unix_millis(times.parse_iso(F.col("t")))).collect()]
    epoch = datetime.datetime(1970, 1, 1)
    assert got == [(m - epoch) // datetime.timedelta(milliseconds=1) for m in moments]


def test_made_ids_are_v4_and_stable(spark):
    df = spark.range(200).select(ids.content_id("id").alias("u"))
    values = [r[0] for r in df.collect()]
    assert values == [r[0] for r in df.collect()] and len(set(values)) == 200
    assert all(uuid.UUID(u).version == 4 for u in values)


def normalized(spark, body):
    df = spark.createDataFrame(
        [("b", 0, 0, "ws", datetime.datetime(2024, 1, 1), json.dumps(body))],
        "batch_id string, pos int, arrival_seq long, workspace_id string, arrived_at timestamp, raw string",
    )
    return ingest.normalize_events(requests.valid_events(requests.validate_events(requests.parse_raw_events(df))))


def test_stored_row_defaults(spark):
    row = normalized(spark, changed(userId=..., anonymousId="anon_abc")).first()
    assert row["user_id"] is None and row["anonymous_id"] == "anon_abc"
    assert row["properties"] == "{}" and row["context"] == "{}"
    assert uuid.UUID(row["event_id"]).version == 4
    assert row["received_text"] == "2024-01-01T00:00:00.000Z"


def test_provided_id_is_kept(spark):
    event_id = str(uuid.uuid4())
    assert normalized(spark, changed(eventId=event_id)).first()["event_id"] == event_id


def test_envelope(spark):
    body = changed(properties={"total": 149.99}, timestamp="2024-05-01T10:00:00+02:00")
    message = json.loads(ingest.event_envelope(normalized(spark, body)).first()["value"])
    assert set(message["meta"]) == {"messageId", "correlationId", "timestamp", "source", "version", "workspaceId"}
    assert message["meta"]["source"] == "ingestion" and message["meta"]["version"] == "1.0"
    assert message["payload"]["receivedAt"] == "2024-05-01T10:00:00+02:00"
    assert message["payload"]["properties"] == {"total": 149.99}
    assert "anonymousId" not in message["payload"] and "sessionId" not in message["payload"]


@pytest.mark.parametrize("size, admitted", [(0, False), (1, True), (100, True), (101, False)])
def test_batch_size(spark, size, admitted):
    from penstock.plans import ingestion

    body = json.dumps({"events": [changed(eventId=str(uuid.uuid4())) for _ in range(size)]})
    df = spark.createDataFrame(
        [("b", 0, "ws", datetime.datetime(2024, 1, 1), body)],
        "batch_id string, arrival_seq long, workspace_id string, arrived_at timestamp, raw string",
    )
    rows = ingestion.validated_batches(df).select("admitted").distinct().collect()
    assert [r["admitted"] for r in rows] == [admitted]


def test_one_bad_event_refuses_the_batch_and_replies_keep_order(spark):
    from penstock.plans import ingestion

    same = str(uuid.uuid4())
    events = [changed(eventId=same), changed(eventId=same), changed(eventId=str(uuid.uuid4()))]
    bodies = [
        ("mixed", json.dumps({"events": events})),
        ("bad", json.dumps({"events": [*events, changed(event="X")]})),
    ]
    df = spark.createDataFrame(
        [(b, 0, "ws", datetime.datetime(2024, 1, 1), raw) for b, raw in bodies],
        "batch_id string, arrival_seq long, workspace_id string, arrived_at timestamp, raw string",
    )
    run = ingestion.ingest_batches(df)
    [reply] = run.results.collect()
    assert reply["batch_id"] == "mixed"
    assert [r["status"] for r in reply["results"]] == ["accepted", "duplicate", "accepted"]
    [summary] = run.summary.collect()
    assert (summary["accepted"], summary["duplicates"]) == (2, 1)
