"""What the plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

from penstock.operators import feeds, ingest
from penstock.plans.queries import QUERIES
from penstock.sources import tables

SF = "/root/testdata/sf0.001"
STREAMS = {name for name in QUERIES if name.startswith("stream") or name == "queue_source"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMS))
def test_no_cross_join_and_no_python(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    assert not re.search(r"NestedLoop|Cartesian|PythonUDF|InPandas|InArrow", plan)


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store"))
    rows = ingest.accepted_rows(
        ingest.normalize_events(_valid(spark)).withColumn("status", F.lit("accepted"))
    )
    tables.append_events(rows, path)
    return path


def _valid(spark):
    from penstock.operators import requests
    from penstock.plans import ingestion
    from penstock.plans.fixtures import fixture

    return requests.valid_events(ingestion.validated_requests(fixture(spark, SF, "raw_events")))


def test_store_prunes_days_and_columns(spark, store):
    read = tables.read_events(spark, store).filter("received_date = date '2024-01-05' and workspace_id = 'ws_1'")
    plan = plan_of(feeds.event_counts(read))
    assert "PartitionFilters: [isnotnull(received_date" in plan
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(workspace_id,ws_1\)", plan)
    assert "properties" not in plan


def test_latest_events_limits_before_the_shuffle(spark, store):
    plan = plan_of(feeds.latest_events(tables.read_events(spark, store), 5))
    assert plan.count("WindowGroupLimit") == 2 and len(re.findall(r"(?<!Broadcast)Exchange ", plan)) == 1


def test_texts_are_parsed_once(spark):
    from penstock.plans.fixtures import fixture

    raw = ingest.normalize_events(_valid(spark))
    assert plan_of(raw).count("from_json(") == 1
    assert fixture(spark, SF, "raw_events").columns[-1] == "raw"
