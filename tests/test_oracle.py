"""Every registered query against its SQL check, whole tables, smallest scale."""

import duckdb
import pytest

from penstock.plans.fixtures import TABLES
from penstock.plans.oracle import oracle_sql
from penstock.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
CHECKS = oracle_sql()


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return connection


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        tuple(f"{row[i]:.6f}" if isinstance(row[i], float) else str(row[i]) for i in order) for row in rows
    )


def test_every_query_has_a_check():
    assert set(QUERIES) == set(CHECKS)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    result = QUERIES[name](spark, SF)
    expected = db.sql(CHECKS[name])
    assert sorted(result.columns) == sorted(expected.columns)
    assert canonical(result.columns, result.collect()) == canonical(expected.columns, expected.fetchall())
