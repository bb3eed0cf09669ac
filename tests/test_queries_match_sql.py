"""Every registered query against its SQL twin, over whole tables at the smallest scale."""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from tools.check import TABLES, rows_of  # noqa: E402

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf, name):
    df = QUERIES[name](spark, sf)
    got = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert got
        return
    cursor = con.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, got, 6) == rows_of(columns, cursor.fetchall(), 6)


def test_entry_is_the_sweep(spark):
    row = entry.entry(spark).first()
    assert row["scanned"] == row["orphans"] + row["expired"] + (row["scanned"] - row["deleted"])
