"""Clauses, transforms, enrichment, failures, credentials, retries."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from penstock import schema
from penstock.functions import backoff
from penstock.operators import config, delivery, steps

NOW = datetime.datetime(2024, 1, 1)


def run(spark, step_list, properties, context="{}", destinations=(), enrichments=None):
    pipeline = [("p", "w", "n", None, ("event", ["a.b", "a.b"]), [(f"s{i}", t, "n", json.dumps(c)) for i, (t, c) in enumerate(step_list)], True, NOW, NOW)]
    pipelines = spark.createDataFrame(pipeline, schema.PIPELINE)
    known = spark.createDataFrame([(d, "w", d, "slack") for d in destinations], "id string, workspace_id string, name string, type string")
    events = spark.createDataFrame(
        [("e", "w", "a.b", "web", "1.0", "u1", None, None, json.dumps(properties), context, "c", NOW, NOW)],
        "event_id string, workspace_id string, event_name string, source string, version string, user_id string,"
        " anonymous_id string, session_id string, properties string, context string, correlation_id string,"
        " received_at timestamp, ingested_at timestamp",
    )
    typed = steps.typed_pipelines(pipelines, known)
    return steps.run_steps(events, typed, enrichments or {})


def props_of(df):
    return json.loads(df.select(F.to_json("props")).first()[0])


CLAUSES = [
    ("properties.total", "gt", "10", True), ("properties.total", "gt", "12.5", False), ("properties.total", "gte", "12.5", True),
    ("properties.total", "lt", "13", True), ("properties.total", "lte", "12.4", False), ("properties.total", "eq", "12.50", True),
    ("properties.total", "ne", "3", True), ("properties.name", "gt", "1", False), ("properties.none", "ne", "1", False),
    ("properties.none", "exists", None, False), ("properties.name", "exists", None, True), ("properties.name", "contains", "ob", True),
    ("properties.name", "regex", "^B.b$", True), ("properties.name", "in", '["Al","Bob"]', True), ("properties.name", "in", '["Al"]', False),
    ("event", "eq", "a.b", True), ("context.page.url", "contains", "/x", True), ("context.page.title", "exists", None, False),
    ("properties.name", "unheard", "1", False), ("secret", "exists", None, False),
]


def test_clauses(spark):
    for field, op, value, expected in CLAUSES:
        clause = {"field": field, "op": op} | ({"value": value} if value is not None else {})
        df = run(spark, [("filter", {"clauses": [clause]})], {"total": 12.5, "name": "Bob"}, '{"page":{"url":"/x"}}')
        assert df.first()["alive"] is expected, (field, op, value)


def test_shorthand(spark):
    assert run(spark, [("filter", {"minTotal": 1000})], {"total": 1000}).first()["alive"]
    assert not run(spark, [("filter", {"minTotal": 1000})], {"total": 999}).first()["alive"]
    assert not run(spark, [("filter", {"minTotal": 1000})], {}).first()["alive"]


def test_transform_order_and_types(spark):
    step = ("transform", {"remove": ["x"], "rename": {"a": "b", "gone": "c"}, "set": {"n": 1.5, "b2": [1]}})
    assert props_of(run(spark, [step], {"a": 1, "b": 2, "c": 3, "x": 4, "n": "old"})) == {"b": 1, "c": 3, "n": 1.5, "b2": [1]}


def test_enrich_and_unmatched(spark):
    table = spark.createDataFrame([("u1", "gold", "FR")], "user_id string, tier string, nation string")
    enrichment = {"people": steps.Enrichment(table, key="user_id")}
    step = ("enrich", {"table": "people", "select": ["tier"], "prefix": "p_"})
    assert props_of(run(spark, [step], {"a": 1}, enrichments=enrichment)) == {"a": 1, "p_tier": "gold"}
    nobody = {"people": steps.Enrichment(table.filter("false"), key="user_id")}
    assert props_of(run(spark, [step], {"a": 1}, enrichments=nobody)) == {"a": 1}


def test_enrichment_keys_must_be_unique(spark):
    table = spark.createDataFrame([("u1", "x"), ("u1", "y")], "user_id string, tier string")
    with pytest.raises(ValueError):
        steps.Enrichment(table, key="user_id").checked()


def test_steps_run_in_order_and_filter_ends_the_run(spark):
    chain = [("destination", {"destinationId": "d1"}), ("filter", {"minTotal": 5}), ("destination", {"destinationId": "d1"})]
    executed = run(spark, chain, {"total": 1}, destinations=["d1"])
    row = steps.pipeline_executions(executed, F.col("received_at"), F.col("ingested_at")).first()
    assert (row["status"], row["n_sends"], row["error"]) == ("completed", 1, None)


def test_data_errors_fail_the_run(spark):
    unknown = run(spark, [("destination", {"destinationId": "nope"})], {}, destinations=["d1"])
    row = steps.pipeline_executions(unknown, F.col("received_at"), F.col("ingested_at")).first()
    assert (row["status"], row["error"]) == ("failed", "unknown_destination")
    fanned = steps.destination_fanout(unknown)
    assert steps.deliveries(fanned).count() == 0 and steps.unknown_destinations(fanned).count() == 1
    for bad in [("destination", {}), ("enrich", {"table": "nowhere"})]:
        row = run(spark, [bad, ("destination", {"destinationId": "d1"})], {}, destinations=["d1"]).first()
        assert row["error"] == ("bad_destination" if bad[0] == "destination" else "bad_enrichment") and row["sends"] == []


def test_random_iv_and_tampering(spark):
    key = F.lit("00" * 32)
    df = spark.range(2).select(F.lit('{"webhookUrl":"x"}').alias("config"))
    sealed = config.encrypt_column(df, "config", key)
    rows = sealed.collect()
    assert rows[0]["encrypted_config"] != rows[1]["encrypted_config"] and rows[0]["iv"] != rows[1]["iv"]
    fixed = spark.createDataFrame([(r["encrypted_config"], r["iv"]) for r in rows], "encrypted_config string, iv string")
    assert {r["config"] for r in config.decrypt_column(fixed, key).collect()} == {'{"webhookUrl":"x"}'}
    swapped = spark.createDataFrame([(rows[0]["encrypted_config"], rows[1]["iv"])], "encrypted_config string, iv string")
    assert config.decrypt_column(swapped, key).first()["config"] is None
    cut = spark.createDataFrame([(rows[0]["encrypted_config"][:-4] + "0000", rows[0]["iv"])], "encrypted_config string, iv string")
    assert config.decrypt_column(cut, key).first()["config"] is None


def test_backoff_grows_and_caps(spark):
    attempts = spark.createDataFrame([(n, "failed", NOW) for n in range(1, 14)], "attempt_number int, status string, attempted_at timestamp")
    broker = [r["delay_ms"] for r in delivery.retry_schedule(attempts, backoff.BROKER).orderBy("attempt_number").collect()]
    assert broker == [1000, 2000, 4000, 8000, 16000, 30000, 30000, 30000, 30000, 30000, None, None, None]
    keys = [r["delay_ms"] for r in delivery.retry_schedule(attempts, backoff.KEY_STORE).orderBy("attempt_number").collect()]
    assert keys == [500, 1000, 2000, 4000, 8000, 16000, 30000, 30000, 30000, 30000, None, None, None]


def test_defaults_of_definitions(spark):
    body = json.dumps({"name": "n", "trigger": {"type": "event", "events": ["a.b"]}, "steps": []})
    df = spark.createDataFrame([("r", "w", body)], "request_id string, workspace_id string, raw string")
    row = config.pipeline_rows(config.validate_pipelines(df), F.current_timestamp()).first()
    assert row["enabled"] is True and row["description"] is None and row["steps"] == []


def test_updates_may_leave_fields_out(spark):
    bodies = ["{}", '{"name":null}', '{"name":1}', '{"type":"ftp"}', '{"config":[]}', '{"iv":"0"}', '{"steps":{}}', '{"trigger":{"type":"event","events":[]}}']
    df = spark.createDataFrame([(str(i), b) for i, b in enumerate(bodies)], "request_id string, raw string")

    def fields(validated):
        return [sorted(e["field"] for e in r["errors"]) for r in validated.orderBy("request_id").collect()]

    assert fields(config.validate_destinations(df, partial=True)) == [[], [], ["name"], ["type"], ["config"], ["iv"], ["steps"], ["trigger"]]
    assert fields(config.validate_pipelines(df, partial=True)) == [[], [], ["name"], ["type"], ["config"], ["iv"], ["steps"], ["trigger.events"]]
    assert fields(config.validate_destinations(df.filter("request_id = '0'"))) == [["config", "name", "type"]]


def test_bad_patterns_and_operations_fail_the_run(spark):
    for clause in ({"op": "regex", "value": "("}, {"op": "like", "value": "x"}, {"value": "x"}):
        done = run(spark, [("filter", {"clauses": [{"field": "event", **clause}]})], {}).first()
        assert done.error == "bad_filter" and done.sends == []


def test_field_names_of_any_length(spark):
    name = "m" * 20_000
    clause = {"field": f"properties.{name}", "op": "eq", "value": "7"}
    assert run(spark, [("filter", {"clauses": [clause], f"minX{name}": 3})], {name: 7, f"x{name}": 5}).first().alive
    assert not run(spark, [("filter", {f"minX{name}": 6})], {name: 7, f"x{name}": 5}).first().alive


def test_a_replay_is_later_than_the_first_attempts(spark):
    at = [NOW + datetime.timedelta(hours=h) for h in range(4)]
    rows = [("a", "e", "d", "failed", 1, at[0]), ("b", "e", "d", "dead_lettered", 2, at[1]), ("c", "e", "d", "delivered", 1, at[3])]
    attempts = spark.createDataFrame(rows, "id string, event_id string, destination_id string, status string, attempt_number int, attempted_at timestamp")
    last = delivery.delivery_latest(attempts).first()
    assert (last.status, last.attempts, last.last_attempt_at) == ("delivered", 3, at[3])
