"""Block scans, ranks and percentiles against plain Python."""

from __future__ import annotations

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from darkroom.operators import folds
from darkroom.operators.ordered import by_sequence, mark_heavy, scan, top_per_key
from darkroom.operators.ranks import exact_percentile, ordinal_rank, spearman


@pytest.fixture(scope="module")
def history(spark):
    """One key holds a third of the rows; values have gaps."""
    rng = random.Random(7)
    rows = [
        ("hot" if i % 3 == 0 else f"k{rng.randrange(20)}", i, rng.choice([None, None, float(rng.randrange(9))]))
        for i in range(900)
    ]
    return rows, spark.createDataFrame(rows, "k string, id bigint, v double").repartition(5)


@pytest.mark.parametrize("heavy", [5, 40, 10_000])
def test_scan_equals_a_plain_pass_whatever_is_cut(history, heavy):
    rows, df = history
    out = scan(
        df, ["k"], ["id"], by_sequence("id", 50), heavy_rows=heavy,
        previous={"was": F.col("v")}, following={"next": F.col("id")},
        running_sum={"total": F.coalesce("v", F.lit(0.0))}, last_value={"last": F.col("v")},
    )
    got = {r["id"]: (r["was"], r["next"], r["total"], r["last"]) for r in out.collect()}
    want = {}
    for key in {k for k, _, _ in rows}:
        mine = sorted((i, v) for k, i, v in rows if k == key)
        total, last = 0.0, None
        for at, (i, v) in enumerate(mine):
            total += v or 0.0
            last = v if v is not None else last
            want[i] = (mine[at - 1][1] if at else None, mine[at + 1][0] if at + 1 < len(mine) else None, total, last)
    assert got == want


def test_only_heavy_keys_are_marked(history):
    _, df = history
    marked = mark_heavy(df, ["k"], 100).where("__heavy").select("k").distinct().collect()
    assert [r["k"] for r in marked] == ["hot"]


def test_top_per_key_limits_before_the_shuffle(history):
    _, df = history
    top = top_per_key(df, ["k"], [F.col("id").desc()], 2)
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    assert top.where("k = 'hot'").count() == 2


def test_ordinal_rank_is_a_permutation_with_ties_in_given_order(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("v")).repartition(7)
    ranked = {r["id"]: r["r"] for r in ordinal_rank(df, ["v", "id"], "r").collect()}
    order = sorted(range(1000), key=lambda i: (i % 3, i))
    assert [ranked[i] for i in order] == list(range(1000))


def _spearman(xs, ys):
    if len(xs) < 3:
        return 0.0
    place = lambda v: np.argsort(np.argsort(np.asarray(v), kind="stable"), kind="stable")
    return float(np.corrcoef(place(xs), place(ys))[0, 1])


@pytest.mark.parametrize("n", [0, 2, 3, 50])
def test_spearman_keeps_ties_in_order(spark, n):
    rng = random.Random(n)
    rows = [(i, float(rng.randrange(5)), float(rng.randrange(7))) for i in range(n)]
    got = spearman(spark.createDataFrame(rows, "i int, x double, y double"), "x", "y", ["i"]).first()["rho"]
    assert got == pytest.approx(_spearman([r[1] for r in rows], [r[2] for r in rows]))


@pytest.mark.parametrize("n", [1, 2, 5, 6, 999, 5000])
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_median_is_exact_also_when_bracketed(spark, n, keys):
    rng = random.Random(n)
    values = [rng.gauss(0, 1) if rng.random() > 0.2 else 0.5 for _ in range(n)]
    df = spark.createDataFrame([("a", v) for v in values] + [("a", None)], "k string, x double")
    got = exact_percentile(df, keys, "x", "m", accuracy=200).first()["m"]
    assert got == pytest.approx(statistics.median(values), abs=1e-12)


def test_percentile_of_nothing_is_no_row(spark):
    assert exact_percentile(spark.createDataFrame([], "x double"), [], "x", "m").count() == 0


def _rate(times, limit, window):
    end, count, out = -1, 0, []
    for t in times:
        if end < 0 or t >= end:
            end, count = t + window, 0
        count += 1
        left = (end - t) // 1000
        out.append((count, count <= limit, max(limit - count, 0), 0 if count <= limit else max((left + 500) // 1000, 1)))
    return out


def _breaker(calls, threshold, cooldown):
    opened_at, streak, out = None, 0, []
    for t, ok in calls:
        if opened_at is not None and t - opened_at >= cooldown:
            opened_at, streak = None, 0
        if opened_at is not None:
            out.append((True, False, threshold))
            continue
        streak = 0 if ok else streak + 1
        trips = streak >= threshold
        opened_at = t if trips else None
        out.append((False, trips, streak))
    return out


@pytest.fixture(scope="module")
def traffic(spark):
    """A client with a third of the requests, busy enough to fill many windows, and quiet ones."""
    rng = random.Random(3)
    rows = [
        ("hot" if i % 3 == 0 else f"c{rng.randrange(8)}", i, rng.randrange(4_000), rng.random() < 0.4)
        for i in range(1500)
    ]
    df = spark.createDataFrame(rows, "who string, id bigint, s bigint, ok boolean").select(
        "who", "id", "ok", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("at")
    )
    return rows, df.repartition(6)


def _by_client(rows):
    for who in {r[0] for r in rows}:
        yield sorted((s * 1_000_000, i, ok) for w, i, s, ok in rows if w == who)


@pytest.mark.parametrize("cut", [15, 60, 1 << 20])
def test_rate_limit_in_blocks_equals_one_pass(traffic, cut):
    rows, df = traffic
    out = folds.rate_limit(df.withColumnRenamed("who", "identity"), 4, 60.0, rows=cut)
    got = {r["id"]: (r["used"], r["allowed"], r["remaining"], r["retry_after"]) for r in out.collect()}
    want = {}
    for mine in _by_client(rows):
        want |= dict(zip([i for _, i, _ in mine], _rate([t for t, _, _ in mine], 4, 60_000_000), strict=True))
    assert got == want


def test_no_limit_allows_everything(traffic):
    _, df = traffic
    out = folds.rate_limit(df.withColumnRenamed("who", "identity"), 0)
    assert out.where("NOT allowed OR retry_after <> 0 OR remaining <> 0").count() == 0


@pytest.mark.parametrize("cut", [15, 60, 1 << 20])
def test_breaker_in_blocks_equals_one_pass(traffic, cut):
    rows, df = traffic
    out = folds.breaker_state(df.withColumnRenamed("who", "provider"), 3, 60.0, rows=cut)
    got = {r["id"]: (r["skipped"], r["opened"], r["failures_in_a_row"]) for r in out.collect()}
    want = {}
    for mine in _by_client(rows):
        want |= dict(zip([i for _, i, _ in mine], _breaker([(t, ok) for t, _, ok in mine], 3, 60_000_000), strict=True))
    assert got == want


@pytest.mark.parametrize("cut", [20, 1 << 20])
def test_guard_in_blocks_equals_one_pass(spark, traffic, cut):
    from darkroom.functions import fixed

    rows, df = traffic
    states = F.array(*[F.lit(s) for s in fixed.STATES])
    steps = df.withColumnRenamed("who", "job_id").withColumn("state", states[(F.col("id") * 5 % 7).cast("int")])
    out = folds.guard_transitions(steps.drop("ok"), rows=cut)
    got = {r["id"]: (r["held"], r["verdict"]) for r in out.collect()}
    for mine in _by_client(rows):
        held = None
        for _, i, _ in mine:
            move = fixed.STATES[i * 5 % 7]
            legal = held is None or move in fixed.TRANSITIONS[held]
            says = "accepted" if legal else (
                "after cancel" if held == "cancelled" else "redelivered" if held in fixed.TERMINAL else "illegal"
            )
            assert got[i] == (held, says)
            held = move if legal else held
