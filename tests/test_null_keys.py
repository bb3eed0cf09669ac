"""Null keys are keys like others, on either side of the block threshold."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from darkroom.functions import payloads
from darkroom.operators import evaluation, jobs
from darkroom.operators.folds import rate_limit
from darkroom.operators.ordered import by_sequence, scan
from darkroom.operators.ranks import exact_percentile
from darkroom.operators.tuning import rounded_half_even


@pytest.mark.parametrize("heavy", [1, 2, 7, 1 << 20])
def test_scan(spark, heavy):
    rows = [(k, i, 0.5 if i == 0 else None) for k in (None, "a") for i in range(6)]
    df = spark.createDataFrame(rows, "k string, id long, v double")
    got = scan(df, ["k"], ["id"], by_sequence("id", 2), last_value={"last": F.col("v")}, heavy_rows=heavy)
    assert [r["last"] for r in got.collect()] == [0.5] * 12


@pytest.mark.parametrize("rows", [2, 7, 1 << 20])
def test_rate_limit_keeps_rows(spark, rows):
    data = [(who, 1_700_000_000 + 40 * i) for who in (None, "x") for i in range(6)]
    df = spark.createDataFrame(data, "identity string, s long").select("identity", F.col("s").alias("id"), F.timestamp_seconds("s").alias("at"))
    got = rate_limit(df, 1, rows=rows)
    seen = {(r.identity, r.id): r.allowed for r in got.collect()}
    assert len(seen) == 12 and all(seen[None, s] == seen["x", s] for _, s in data)


def test_percentile_of_a_null_group(spark):
    df = spark.createDataFrame([(None, 5.0), (None, 7.0), ("a", 1.0), ("a", None)], "k string, v double")
    for few in (False, True):
        got = {r.k: r.p for r in exact_percentile(df, ["k"], "v", "p", few_groups=few).collect()}
        assert got == {None: 6.0, "a": 1.0}


def test_gate_scores_round_as_stored(spark):
    df = spark.createDataFrame([(0.00125,), (0.00135,), (2.5,), (None,)], "v double")
    got = [r[0] for r in df.select(rounded_half_even(F.col("v"), 4)).collect()]
    assert got == [round(0.00125, 4), round(0.00135, 4), 2.5, None]


def test_rank_variants(spark):
    df = spark.createDataFrame(
        [("c", 0.5, 2.0, 1), ("c", None, 1.0, 2), ("c", 0.0, 1.0, 3), ("c", 0.1, None, 4), (None, 0.2, 1.0, 5)],
        "case string, iou double, cost double, line int")
    got = {r.line: r["rank"] for r in evaluation.rank_variants(df, "case").collect()}
    assert got == {1: 1, 4: 2, 2: 3, 3: 3, 5: 1}


def test_upsert_rejects_an_unnamed_owner(spark):
    now = spark.createDataFrame([("j", "u", "done")], "id string, user_id string, state string")
    new = spark.createDataFrame([("j", None, "failed", 1), ("j", "u", "failed", 2)], "id string, user_id string, state string, seq long")
    after, rejected = jobs.upsert_jobs(now, new, "seq")
    assert [tuple(r) for r in after.collect()] == [("j", "u", "failed")] and rejected.count() == 1


def test_redact_hides_what_is_no_json(spark):
    df = spark.createDataFrame([('{"a":',), ('{"a":1,"a":2}',), ('{"a":1}',), (None,)], "j string")
    got = [r[0] for r in df.select(payloads.redact(F.col("j"))).collect()]
    assert got[0] == got[1] == '"[redacted]"' and got[2] == '{"a":1}'
