"""Hot keys: the cut paths must give what the plain ones give."""

import random

import pytest
from pyspark.sql import functions as F

from penstock.operators import config, feeds, ingest, metrics, routing, skew


@pytest.fixture
def slices(spark, request):
    """So many slices, however small the table."""
    keys = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(k) for k in keys]
    for key, value in zip(keys, (str(request.param), "false"), strict=True):
        spark.conf.set(key, value)
    yield request.param
    for key, value in zip(keys, before, strict=True):
        spark.conf.set(key, value)


def rows_of(df, *columns):
    return sorted(df.select(*columns).collect(), key=str)


@pytest.fixture(scope="module")
def facts(spark):
    """A third of all rows share one key; some have none."""
    rng = random.Random(1)
    data = [(i, "hot" if i % 3 == 0 else None if i % 50 == 1 else f"k{rng.randrange(40)}") for i in range(3000)]
    return spark.createDataFrame(data, "id long, key string")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, facts, how):
    dimension = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("k2", 4), (None, 5)], "key string, v int")
    plain = facts.join(dimension, "key", how)
    cut = skew.salted_join(facts, dimension, ["key"], how, spread=["id"], hot_rows=100)
    assert rows_of(cut, *plain.columns) == rows_of(plain, *plain.columns)


def test_hot_key_is_spread(spark, facts):
    hot = skew.hot_keys(facts, ["key"], hot_rows=100).collect()
    assert [(r["key"], r["_splits"]) for r in hot] == [("hot", 11)]


def test_previous_value_over_slices(spark):
    rng = random.Random(2)
    data = [(i, "hot" if i % 3 else f"k{i % 7}", rng.choice([None, i])) for i in range(600)]
    df = spark.createDataFrame(data, "at long, key string, v long")
    got = skew.previous_value(df, ["key"], ["at"], F.col("v"), "before", F.floor(F.col("at") / 25), hot_rows=200)
    expected, last = {}, {}
    for at, key, value in data:
        expected[at] = last.get(key)
        if value is not None:
            last[key] = value
    assert {r["at"]: r["before"] for r in got.collect()} == expected


def brute_labels(arrivals, ttl=86_400):
    first, labels = {}, {}
    for event_id, at, seq in sorted(arrivals, key=lambda a: (a[1], a[2])):
        if event_id not in first:
            first[event_id], labels[event_id, seq] = at, "accepted"
        else:
            labels[event_id, seq] = "duplicate" if at < first[event_id] + ttl else "conflict"
    return labels


@pytest.mark.parametrize("hot_rows", [50, 1_000_000])
def test_dedupe_with_a_hot_id(spark, hot_rows):
    rng = random.Random(3)
    data = [("hot" if i % 3 == 0 else f"e{rng.randrange(100)}", rng.randrange(200_000), i) for i in range(900)]
    arrivals = spark.createDataFrame(data, "event_id string, s long, arrival_seq long").withColumn(
        "arrived_at", F.timestamp_seconds("s")
    )
    got = ingest.dedupe_status(arrivals, hot_rows=hot_rows)
    assert {(r["event_id"], r["arrival_seq"]): r["status"] for r in got.collect()} == brute_labels(data)


def test_dedupe_does_not_depend_on_the_cut_into_runs(spark):
    rng = random.Random(4)
    data = [(f"e{rng.randrange(60)}", i * 700, i) for i in range(400)]
    arrivals = spark.createDataFrame(data, "event_id string, s long, arrival_seq long").withColumn(
        "arrived_at", F.timestamp_seconds("s")
    )
    early, late = arrivals.filter("arrival_seq < 150"), arrivals.filter("arrival_seq >= 150")
    first = ingest.dedupe_status(early)
    store = first.filter("status = 'accepted'").select("event_id", F.col("arrived_at").alias("ingested_at"))
    both = first.unionByName(ingest.dedupe_status(late, store))
    assert rows_of(both, "arrival_seq", "status") == rows_of(ingest.dedupe_status(arrivals), "arrival_seq", "status")


def test_ids_are_case_sensitive_and_global(spark):
    data = [("A", "ws_1", 0, 0), ("a", "ws_1", 0, 1), ("A", "ws_2", 5, 2)]
    arrivals = spark.createDataFrame(data, "event_id string, ws string, s long, arrival_seq long").withColumn(
        "arrived_at", F.timestamp_seconds("s")
    )
    got = {r["arrival_seq"]: r["status"] for r in ingest.dedupe_status(arrivals).collect()}
    assert got == {0: "accepted", 1: "accepted", 2: "duplicate"}


@pytest.mark.parametrize("slices", [1, 7], indirect=True)
def test_previous_value_in_slices(spark, slices):
    """One key with nearly all rows at one instant, one without a key, some without a value."""
    rng = random.Random(3)
    data = [(i, "hot" if i % 4 else None if i % 8 else f"k{i % 5}", 7 if i % 3 else rng.randrange(9), rng.choice([None, i])) for i in range(800)]
    df = spark.createDataFrame(data, "id long, key string, at long, v long")
    got = skew.previous_in_slices(df, ["key"], ["at", "id"], F.col("v"), "before").collect()
    expected, last = {}, {}
    for id_, key, _, value in sorted(data, key=lambda r: (r[2], r[0])):
        expected[id_] = last.get(key)
        if value is not None:
            last[key] = value
    assert {r["id"]: r["before"] for r in got} == expected


@pytest.mark.parametrize("slices", [4], indirect=True)
def test_an_instant_is_cut(spark, slices):
    """All rows of one key at one time still make several slices."""
    df = spark.range(4000).selectExpr("id", "'k' as key", "timestamp_millis(0) as at")
    assert skew.sliced(df, ["key"], ["at", "id"]).select("_slice").distinct().count() == 4
    assert skew.spanning_keys(skew.sliced(df, ["key"], ["at", "id"]), ["key"]).count() == 1


def test_trace_of_a_hot_correlation_id(spark):
    data = [(f"e{i:04}", "hot" if i % 3 == 0 else f"c{i % 11}", i * 97) for i in range(500)]
    store = spark.createDataFrame(data, "event_id string, correlation_id string, m long").withColumn(
        "received_at", F.timestamp_seconds(F.col("m") * 60)
    )
    expected, last = [], {}
    for event, key, m in data:
        expected.append((event, None if key not in last else (m - last[key]) * 60_000))
        last[key] = m
    assert [tuple(r) for r in rows_of(feeds.correlation_trace(store), "event_id", "gap_ms")] == sorted(expected, key=str)
    assert feeds.correlation_trace(store, "hot").count() == 167


@pytest.mark.parametrize("slices", [1, 5], indirect=True)
def test_draining_bucket_against_brute_force(spark, slices):
    rng = random.Random(slices)
    at, data = 0, []
    for i in range(900):
        at += rng.choice([0, 0, 1, 20, 60, 400])
        data.append((i, "hot" if i % 3 else f"k{i % 5}", at))
    requests = spark.createDataFrame(data, "id long, key string, ms long").withColumn("at", F.timestamp_millis("ms"))
    got = metrics.edge_limit_audit(requests, "key", "at", "id", rate=30, burst=5).collect()
    levels, expected = {}, {}
    for i, key, ms in data:
        level, before = levels.get(key, (0, ms))
        levels[key] = max(0, level - 30 * (ms - before)) + 1000, ms
        expected[i] = levels[key][0], levels[key][0] > 6000
    assert {r["id"]: (r["level"], r["over_limit"]) for r in got} == expected
    assert any(over for _, over in expected.values())


def test_rate_audit_against_brute_force(spark):
    rng = random.Random(5)
    data = [(i, "hot" if i % 3 else f"k{i % 5}", rng.randrange(100_000)) for i in range(500)]
    requests = spark.createDataFrame(data, "id long, key string, ms long").withColumn("at", F.timestamp_millis("ms"))
    got = metrics.rate_limit_audit(requests, "key", "at", window_ms=1000, limit=3, burst=2)
    for row in got.collect():
        count = sum(1 for _, key, ms in data if key == row["key"] and row["ms"] - 1000 <= ms <= row["ms"])
        assert (row["in_window"], row["over_limit"], row["over_burst"]) == (count, count > 3, count > 5)


def matches(pattern, words):
    if not pattern:
        return not words
    if pattern[0] == "#":
        return any(matches(pattern[1:], words[i:]) for i in range(len(words) + 1))
    return bool(words) and pattern[0] in ("*", words[0]) and matches(pattern[1:], words[1:])


def test_topics_against_brute_force(spark):
    patterns = ["#", "event.#", "event.*", "*", "#.created", "order.*.created", "a.#.b", "*.x.#", "event", "a.#.#", "#.a.*", "a.b"]
    keys = ["event", "event.a", "event.a.b", "order.x.created", "order.created", "created", "a.b", "a.x.y.b", "q.x", "a", "x.a.c", "eventful"]
    messages = spark.createDataFrame([(f"m{i}", k) for i, k in enumerate(keys * 3)], "message_id string, routing_key string")
    bindings = spark.createDataFrame([(f"q{i}", p) for i, p in enumerate(patterns)], "queue string, pattern string")
    got = {(r["message_id"], r["queue"]) for r in routing.route_topics(messages, bindings).collect()}
    expected = {
        (f"m{i}", f"q{j}")
        for i, k in enumerate(keys * 3)
        for j, p in enumerate(patterns)
        if matches(p.split("."), k.split("."))
    }
    assert got == expected


def test_patches_of_a_hot_row(spark):
    current = spark.createDataFrame([("p", "w", "old")], "id string, workspace_id string, name string").select(
        "*", F.lit("d").alias("description"), F.expr("named_struct('type','event','events',array('a'))").alias("trigger"),
        F.array().cast("array<struct<id:string,type:string,name:string,config:string>>").alias("steps"),
        F.lit(True).alias("enabled"), F.timestamp_seconds(F.lit(0)).alias("created_at"), F.timestamp_seconds(F.lit(0)).alias("updated_at"),
    )
    rng = random.Random(6)
    ops = [("p" if i % 3 else f"x{i % 4}", i * 30_000, rng.choice(["update", "update", "update", "delete", "create"])) for i in range(200)]
    create = '{"name":"n","trigger":{"type":"event","events":["b"]},"steps":[]}'
    rows = [(i, "w", v, op, create if op == "create" else "{}" if op == "delete" else f'{{"name":"n{v}"}}') for i, v, op in ops]
    patches = spark.createDataFrame(rows, "id string, workspace_id string, version long, op string, patch string").withColumn(
        "changed_at", F.timestamp_seconds("version")
    )
    alive, expected = {"p"}, {}
    for row_id, version, op in ops:
        if op == "create":
            expected[version] = "exists" if row_id in alive else "applied"
            alive.add(row_id)
        else:
            expected[version] = "applied" if row_id in alive else "not_found"
            if op == "delete":
                alive.discard(row_id)
    for hot_rows in (20, 1_000_000):
        got = config.patch_outcomes(current, patches, hot_rows=hot_rows)
        assert {r["version"]: r["outcome"] for r in got.collect()} == expected
        state = config.apply_patches(current, patches, hot_rows=hot_rows)
        assert {r["id"] for r in state.collect()} == alive


def test_silence_costs_rows_per_gap(spark):
    """An `lt` rule over a month without events is one row; a breach after a gap counts from the gap's last window."""
    store = spark.createDataFrame([("ws", "a", "{}", 3_600 * 50), ("ws", "a", "{}", 3_600 * 52 + 60)], "workspace_id string, event_name string, properties string, s long")
    store = store.withColumn("received_at", F.timestamp_seconds("s"))
    rules = spark.createDataFrame(
        [("low", "ws", None, "count", 3600, "lt", 1.0, 7200), ("any", "ws", None, "count", 3600, "gte", 0.0, 3600), ("dead", "other", "x", "total", 86400, "lte", 0.0, 0), ("high", "ws", None, "count", 3600, "gt", 5.0, 0)],
        "rule_id string, workspace_id string, event_name string, metric string, window_seconds long, op string, threshold double, cooldown_seconds long",
    )
    got = metrics.alert_rules_with_silence(store, rules, F.timestamp_seconds(F.lit(1800)), F.timestamp_seconds(F.lit(86400 * 30)))
    rows = sorted((r.rule_id, r.window_start // 3600, r.windows, r.value, r.suppressed, r.repeats_suppressed) for r in got.collect())
    assert rows == [
        ("any", 1, 49, 0, False, False), ("any", 50, 1, 1, False, False), ("any", 51, 1, 0, False, False), ("any", 52, 1, 1, False, False), ("any", 53, 667, 0, False, False),
        ("dead", 24, 29, 0, False, False),
        ("low", 1, 49, 0, False, True), ("low", 51, 1, 0, False, False), ("low", 53, 667, 0, False, True),
    ]
