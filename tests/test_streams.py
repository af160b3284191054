"""Streams against their batch forms, over several runs; what state and look-ups grow with."""

import random

import pytest
from pyspark.sql import functions as F

from penstock.operators import delivery, metrics, people
from penstock.plans.fixtures import fixture
from penstock.plans.serving import Serving
from penstock.session import scratch_dir
from penstock.sources import queue
from penstock.streaming import idtable, jobs
from penstock.streaming.idtable import IdTable

IDS = "event_id STRING, first_us BIGINT"


@pytest.mark.parametrize("fan", [2, 3, 8])
def test_runs_cover_each_batch_once(fan):
    table = IdTable("x", fan=fan)
    for batch in range(200):
        covered = [b for level, run in table.runs(batch) for b in range(run * fan**level, (run + 1) * fan**level)]
        assert sorted(covered) == list(range(batch))
        assert len(table.runs(batch)) < fan * 9


def test_look_ups_follow_the_batch(spark):
    """Over ten batches a look-up of few ids reads their buckets and no more, whatever has been stored."""
    table = IdTable(scratch_dir(spark, "ids"), buckets=50, fan=3)
    draw, stored = random.Random(1), {}
    for batch in range(10):
        rows = [(f"id-{batch}-{i}", batch * 1000 + i) for i in range(400)]
        wanted = draw.sample(list(stored), min(3, len(stored))) + [f"new-{batch}"]
        frame = spark.createDataFrame([(w,) for w in wanted], "event_id STRING")
        assert {(r.event_id, r.first_us) for r in table.find(frame, batch).collect()} == {(w, stored[w]) for w in wanted if w in stored}
        assert table.touched(frame, batch).count() <= len(wanted) * len(stored) * 2 / 50
        table.add(spark.createDataFrame(rows, IDS), batch)
        stored |= dict(rows)
    # a batch that runs again reads what it read, and leaves one copy
    table.add(spark.createDataFrame(rows, IDS), 9)
    assert table.read(spark, 10).count() == len(stored)


def test_ids_of_expired_messages_are_forgotten(spark):
    table = IdTable(scratch_dir(spark, "ids"), buckets=2, fan=2, keep_us=3_000)
    sizes = []
    for batch in range(12):
        table.add(spark.createDataFrame([(f"{batch}-{i}", batch * 1000) for i in range(10)], IDS), batch)
        sizes.append(table.read(spark, batch + 1).count())
    assert max(sizes[6:]) <= 80 and sizes[7] <= 40


def test_output_belongs_to_one_checkpoint(spark):
    root = scratch_dir(spark, "root")
    idtable.claim(spark, root, "a")
    idtable.claim(spark, root, "a")
    with pytest.raises(ValueError, match="written from checkpoint a"):
        idtable.claim(spark, root, "b")


def test_labels_need_no_state(spark):
    """The query keeps nothing in Spark's state store, and labels hold across runs and at the window's edge."""
    at = [(0, "x", 0), (0, "y", 0), (86_399, "x", 1), (86_400, "x", 2), (200_000, "x", 3), (86_400, "z", 0), (86_400, "z", 1), (200_000, "y", 1)]
    rows = spark.createDataFrame(at, "s INT, event_id STRING, arrival_seq LONG").select("event_id", F.timestamp_seconds("s").alias("arrived_at"), "arrival_seq")
    path, root, checkpoint = (scratch_dir(spark, x) for x in ("feed", "root", "checkpoint"))
    for low, high in ((-1, 86_399), (86_399, 86_400), (86_400, 10**6)):
        rows.filter((F.unix_seconds("arrived_at") >= low) & (F.unix_seconds("arrived_at") < high)).write.mode("append").parquet(path)
        query = jobs.stream_labels(spark.readStream.schema(rows.schema).parquet(path), root, checkpoint)
        query.awaitTermination()
        assert all(not p["stateOperators"] for p in query.recentProgress)
    got = {(r.event_id, r.arrival_seq): r.status for r in jobs.read_batches(spark, root, "labelled", "event_id STRING, arrival_seq LONG, status STRING").collect()}
    assert got == {
        ("x", 0): "accepted", ("x", 1): "duplicate", ("x", 2): "conflict", ("x", 3): "conflict", ("y", 0): "accepted", ("y", 1): "conflict",
        ("z", 0): "accepted", ("z", 1): "duplicate",
    }


def fed(spark, frames, cuts, start):
    """Run `start` on streams over growing folders, cut by each frame's first column."""
    paths = [scratch_dir(spark, "feed") for _ in frames]
    for low, high in zip([0, *cuts], [*cuts, 10**9], strict=True):
        for frame, path in zip(frames, paths, strict=True):
            frame.filter((F.col(frame.columns[0]) >= low) & (F.col(frame.columns[0]) < high)).write.mode("append").parquet(path)
        start(*[spark.readStream.schema(f.schema).parquet(p) for f, p in zip(frames, paths, strict=True)]).awaitTermination()


def test_messages_expire_at_their_millisecond(spark):
    """Consumed a millisecond before the end, at it, after it, never, before publication, and in an earlier run than published."""
    day = 86_400_000
    published = [(0, "m1", 0), (0, "m2", 0), (0, "m3", 0), (0, "m4", 0), (1, "m5", 5_000_000), (3, "late", 4 * day)]
    consumed = [(1, "m1", day - 1), (1, "m2", day), (2, "m3", day + 7), (0, "m5", 4_000_000), (3, "late", 4 * day + 1)]
    frames = [
        spark.createDataFrame(published, "run long, message_id string, ms long").selectExpr("run", "message_id", "'q' as queue", "timestamp_millis(ms + 864000000) as published_at"),
        spark.createDataFrame(consumed, "run long, message_id string, ms long").selectExpr("run", "message_id", "timestamp_millis(ms + 864000000) as consumed_at"),
    ]
    out, checkpoint = scratch_dir(spark, "out"), scratch_dir(spark, "checkpoint")
    fed(spark, frames, [1, 2, 3], lambda p, c: jobs.stream_expiry(p, c, out, checkpoint))
    got = sorted((r.message_id, r.routing_key, r.at) for r in spark.read.parquet(out).withColumn("at", F.unix_millis("dead_at")).collect())
    log = frames[0].join(frames[1].drop("run"), "message_id", "left").filter("message_id <> 'late'")
    batch = delivery.expire_messages(log, F.timestamp_millis(F.lit(14 * day - 3_600_000)))
    assert got == sorted((r.message_id, r.routing_key, r.at) for r in batch.withColumn("at", F.unix_millis("dead_at")).collect())
    assert [g[0] for g in got] == ["m2", "m3", "m4"]


def test_late_event_joins_two_open_sessions(spark):
    """At 1 and 50 minutes with a gap of 30: two sessions, until the event at 25 comes a run later."""
    minutes = [(0, "s", 1), (0, "s", 50), (1, "s", 25), (1, "t", 60), (2, "s", 1_000), (2, "id", 1_000), (3, "s", 9_000)]
    rows = spark.createDataFrame(minutes, "run long, who string, m long").selectExpr(
        "run", "'ws' as workspace_id", "if(who = 'id', 'sess', null) as session_id", "who as user_id", "cast(null as string) as anonymous_id", "timestamp_seconds(m * 60) as received_at", "who || m as event_id"
    )
    out, checkpoint = scratch_dir(spark, "out"), scratch_dir(spark, "checkpoint")
    fed(spark, [rows], [1, 2, 3], lambda s: jobs.stream_sessions(s, out, checkpoint, lateness="2 hours"))
    closed = jobs.merged_sessions(spark.read.parquet(out))
    got = sorted((r.kind, r.session, r.events, r.a, r.b) for r in closed.withColumns({"a": F.unix_seconds("started_at") / 60, "b": F.unix_seconds("ended_at") / 60}).collect())
    assert got == [("gap", "s", 1, 1_000, 1_000), ("gap", "s", 3, 1, 50), ("gap", "t", 1, 60, 60), ("id", "sess", 1, 1_000, 1_000)]
    batch = people.session_rollup(rows.filter("received_at < timestamp_seconds(9000 * 60)")).select(*closed.columns)
    assert sorted(map(str, batch.collect())) == sorted(map(str, closed.collect()))


def test_read_model_reads_touched_days(spark):
    serving = Serving(scratch_dir(spark, "serving"), buckets=4)
    store, attempts, quotas = (fixture(spark, "/root/testdata/sf0.001", name) for name in ("stored", "attempts", "quotas"))
    early = F.col("received_at") < "2024-01-20"
    first = serving.run(0, store.filter(early), attempts.limit(0), quotas)
    assert len(first) == 19
    event = store.filter(early).orderBy("received_at").first()
    tries = attempts.filter(F.col("event_id") == event.event_id)
    assert serving.run(1, store.limit(0), tries, quotas) == [event.received_at.date()]
    plan = serving.rebuilt(spark, [event.received_at.date()], quotas)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [") >= 2 and "PartitionFilters: []" not in plan.split("quotas")[0].split("customer")[0]
    # an attempt whose event comes a run later waits for it
    later = store.filter(~early).first()
    assert serving.run(2, store.limit(0), attempts.filter(F.col("event_id") == later.event_id), quotas) == []
    assert serving.run(3, store.filter(F.col("event_id") == later.event_id), attempts.limit(0), quotas) == [later.received_at.date()]
    held = store.filter(early | (F.col("event_id") == later.event_id))
    known = attempts.filter(F.col("event_id").isin(event.event_id, later.event_id))
    full, kept = metrics.read_model(held, known, quotas), serving.model(spark)
    assert sorted(map(str, full.select(*sorted(full.columns)).collect())) == sorted(map(str, kept.select(*sorted(full.columns)).collect()))


def sent(spark, path, runs, start):
    """Publish envelopes run by run, in two files each, and consume what is there file by file."""
    rows = [(f'{{"payload":{{}},"meta":{{"messageId":{name}}}}}', at) for run in runs for name, at in run]
    schema = "value STRING, published_at TIMESTAMP"
    done = 0
    for run in runs:
        part = rows[done : (done := done + len(run))]
        queue.publish(spark.createDataFrame(part, "value STRING, s LONG").select("value", F.timestamp_seconds("s").alias("published_at")).coalesce(1), path)
        start(queue.queue_source(spark, path, schema, files_per_trigger=1)).awaitTermination()


def test_known_messages_leave_before_anything_is_written(spark):
    """Copies in one batch, in a later one and after a restart; messages without an id are kept once a batch."""
    path, root, checkpoint = (scratch_dir(spark, x) for x in ("queue", "root", "checkpoint"))
    first, copies = [(f'"m{i}"', 100 + i) for i in range(40)], [('"m1"', 900), ("null", 901), ("null", 902)]
    runs = [[*first, *first[:5], *copies[1:]], [*copies, ('"n"', 1000)], [*first, ('"n"', 1001), ('"o"', 1002)]]
    seen = []

    def work(rows, batch):
        assert rows.columns == ["value", "published_at"]
        seen.append(sorted(r[0] for r in rows.select(F.coalesce(F.get_json_object("value", "$.meta.messageId"), F.lit("?"))).collect()))

    sent(spark, path, runs, lambda s: jobs.consume_once(s, work, root, checkpoint))
    assert seen == [sorted(["?", *[f"m{i}" for i in range(40)]]), ["?", "n"], ["o"]]
    written = spark.read.parquet(f"{root}/messages").groupBy("batch").count().collect()
    assert {r["batch"]: r["count"] for r in written} == {0: 41, 1: 2, 2: 1}


def test_a_queue_file_is_read_by_many_tasks(spark, tmp_path, monkeypatch):
    import pyarrow.parquet as pq

    monkeypatch.setattr(queue, "ROW_GROUP_BYTES", 1 << 16, raising=False)
    rows = spark.range(4000, numPartitions=1).select(F.concat(*[F.sha2(F.concat("id", F.lit(str(i))), 256) for i in range(4)]).alias("value"))
    queue.publish(rows, str(tmp_path / "queue"))
    [file] = (tmp_path / "queue").glob("*.parquet")
    assert pq.ParquetFile(file).metadata.num_row_groups > 4


def test_envelopes_are_made_once_and_by_all_cores(spark, monkeypatch):
    """The messages that come again are read from the queue, not made again inside a filter; what is published is shuffled to its writers."""
    from penstock.plans.queries import QUERIES

    plans, publish = [], queue.publish
    monkeypatch.setattr(queue, "publish", lambda df, *a: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), publish(df, *a)))
    assert QUERIES["queue_source"](spark, "/root/testdata/sf0.001").count() == fixture(spark, "/root/testdata/sf0.001", "stored").count()
    assert [p.count("StructsToJsonEvaluator") for p in plans] == [1, 0] and all(p.startswith("RepartitionByExpression") for p in plans)
