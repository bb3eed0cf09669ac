"""Order statistics by counting in ranges, against sorting."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from darkroom.operators import selection

WANTED = {"low": 0.0, "p10": 0.1, "p50": 0.5, "p90": 0.9, "top": 1.0}


def plain(rows):
    of = {}
    for k, v in rows:
        if v is not None:
            of.setdefault(k, []).append(v)
    return {k: tuple(np.quantile(v, p) for p in WANTED.values()) for k, v in of.items()}


def several(seed):
    """One key with most rows, one of few different values, a null key and small ones."""
    r = random.Random(seed)
    rows = [("hot", r.gauss(0, 5)) for _ in range(6000)] + [("hot", 1.5)] * 700
    rows += [("ties", float(r.choice((1, 1, 1, 2)))) for _ in range(3000)] + [("same", 7.0)] * 900
    rows += [(None, r.random()) for _ in range(800)] + [("few", -3.0), ("few", 4.0), ("one", 2.0), ("none", None), (None, None)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("accuracy,most,listed,ranges", [(10_000, 100_000, 10_000, 64), (200, 100_000, 10_000, 64), (100, 5, 10_000, 4), (100, 5, 0, 3), (1, 2, 0, 64)])
def test_percentiles_of_keys_of_any_size(spark, monkeypatch, accuracy, most, listed, ranges):
    monkeypatch.setattr(selection, "LISTED", listed)
    monkeypatch.setattr(selection, "RANGES", ranges)
    rows = several(accuracy + most)
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = selection.exact_quantiles(df, ["k"], "v", WANTED, accuracy, most).collect()
    want = plain(rows)
    assert {r.k for r in got} == set(want)
    for r in got:
        assert tuple(r)[1:] == pytest.approx(want[r.k], abs=1e-9)


def test_several_keys_and_none(spark):
    rows = [(a, b, float(i)) for i in range(40) for a in (None, 1) for b in ("x", None)]
    df = spark.createDataFrame(rows, "a int, b string, v double")
    got = selection.exact_quantiles(df, ["a", "b"], F.col("v") * 2, {"m": 0.5}, accuracy=10, most=3)
    assert sorted([tuple(r) for r in got.collect()], key=str) == sorted([(a, b, 39.0) for a in (None, 1) for b in ("x", None)], key=str)
    assert [tuple(r) for r in selection.exact_quantiles(df, [], "v", {"m": 0.5, "t": 1.0}, accuracy=10, most=3).collect()] == [(19.5, 39.0)]
    assert selection.exact_quantiles(df.limit(0), ["a"], "v", WANTED).collect() == []
    assert selection.exact_quantiles(df.where("false"), [], "v", WANTED).collect() == []


def test_one_large_key(spark):
    """A million values of one key: nothing but a sliver of them is ordered."""
    df = spark.range(0, 1_000_000, 1, 8).select(F.lit("all").alias("k"), (F.col("id") * 7919 % 1_000_000).cast("double").alias("v"))
    got = selection.exact_quantiles(df, ["k"], "v", WANTED, most=1000).first()
    assert tuple(got)[1:] == pytest.approx((0.0, 99_999.9, 499_999.5, 899_999.1, 999_999.0))
