"""Sequential rules on awkward keys and cut at any place, against plain loops."""

from __future__ import annotations

import random
from functools import reduce

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from darkroom.functions import fixed
from darkroom.operators import folds
from darkroom.plans.tables import table
from darkroom.session import scratch_dir
from darkroom.streaming import sequential
from darkroom.streaming.landing import land

SECOND = 1_000_000


def plain_rate(times, limit, window):
    end, count, out = None, 0, []
    for t in times:
        if end is None or t >= end:
            end, count = t + window, 0
        count += 1
        out.append((count, count <= limit))
    return out


def plain_breaker(calls, threshold, cooldown):
    opened, streak, out = None, 0, []
    for t, ok in calls:
        if opened is not None and t - opened >= cooldown:
            opened, streak = None, 0
        if opened is not None:
            out.append((True, False, threshold))
            continue
        streak = 0 if ok else streak + 1
        trips = streak >= threshold
        opened = t if trips else None
        out.append((False, trips, streak))
    return out


def plain_guard(states):
    held, out = None, []
    for s in states:
        if s not in fixed.STATES:
            out.append((held, "unknown state"))
        elif held is None or s in fixed.TRANSITIONS[held]:
            out.append((held, "accepted"))
            held = s
        else:
            out.append((held, "after cancel" if held == "cancelled" else "redelivered" if held in fixed.TERMINAL else "illegal"))
    return out


KEYS = {
    "long": ("k long", [(None,), (2**53,), (2**53 + 1,), (-1,)]),
    "string": ("k string", [(None,), ("",), ("a",), ("A",)]),
    "double": ("k double", [(None,), (float("nan"),), (0.5,), (float("inf"),)]),
    "composite": ("a long, b string", [(None, None), (None, "x"), (2**53, None), (2**53 + 1, "x"), (2**53, "x")]),
}


def awkward(kind, n=240, seed=4):
    r = random.Random(seed)
    schema, keys = KEYS[kind]
    named = lambda k: "nan" if k != k else k
    rows, when = [], 1_700_000_000
    for i in range(n):
        when += r.choice((0, 1, 5, 30))
        k = keys[0] if i % 3 == 0 else r.choice(keys)
        state = r.choice([*fixed.STATES, "running", "review", "odd", None])
        rows.append((*k, i, when if i % 29 else None, r.random() < 0.4 if i % 31 else None, state, None if i % 2 else 2**60 + i))
    of = {}
    for row in rows:
        of.setdefault(tuple(named(x) for x in row[:len(keys[0])]), []).append(row[len(keys[0]):])
    return f"{schema}, id long, s long, ok boolean, state string, other long", rows, of, [c.split()[0] for c in schema.split(", ")]


def timed(df):
    return df.withColumns({"t": F.expr("s * 1000000"), "okay": F.col("ok").cast("bigint")}).repartition(5)


def collected(df, columns):
    out = {}
    for r in df.collect():
        assert r["other"] == (None if r["id"] % 2 else 2**60 + r["id"])
        out[r["id"]] = tuple(r[c] for c in columns)
    return out


@pytest.mark.parametrize("kind", KEYS)
@pytest.mark.parametrize("cut", [1, 2, 7, folds.DEFAULT_ROWS])
def test_awkward_keys_equal_the_plain_loop(spark, monkeypatch, kind, cut):
    if cut == 2:  # several rounds of composed maps
        monkeypatch.setattr(folds, "FAN_BITS", 2)
        monkeypatch.setattr(folds, "FAN", 4)
    schema, rows, of, keys = awkward(kind)
    df = timed(spark.createDataFrame(rows, schema))
    want = {r[0]: (None, None) for mine in of.values() for r in mine}
    for mine in of.values():
        known = [r for r in mine if r[1] is not None]
        want |= dict(zip([r[0] for r in known], plain_rate([r[1] for r in known], 2, 60), strict=True))
    got = collected(folds.fold(df, keys, ["t", "id"], folds.rate_rule(2, 60.0), rows=cut), ["used", "allowed"])
    assert got == want
    if cut in (2, 7):
        breaker = folds.breaker_rule(2, 40.0)
        given_ok = df.drop("ok").withColumnRenamed("okay", "ok")
        want = {r[0]: (None, None, None) for mine in of.values() for r in mine}
        for mine in of.values():
            known = [r for r in mine if r[1] is not None and r[2] is not None]
            want |= dict(zip([r[0] for r in known], plain_breaker([(r[1], r[2]) for r in known], 2, 40), strict=True))
        got = collected(folds.fold(given_ok, keys, ["t", "id"], breaker, rows=cut), ["skipped", "opened", "failures_in_a_row"])
        assert got == want


@pytest.mark.parametrize("cut", [1, 7, folds.DEFAULT_ROWS])
def test_unknown_states_are_refused(spark, cut):
    schema, rows, of, _ = awkward("long")
    steps = spark.createDataFrame(rows, schema).withColumnRenamed("k", "job_id").withColumn("at", F.timestamp_seconds("s"))
    got = collected(folds.guard_transitions(steps, rows=cut), ["held", "verdict"])
    want = {r[0]: (None, None) for mine in of.values() for r in mine}
    for mine in of.values():
        known = [r for r in mine if r[1] is not None]
        want |= dict(zip([r[0] for r in known], plain_guard([r[3] for r in known]), strict=True))
    assert got == want and {v for _, v in got.values()} > {"unknown state", "accepted"}


def test_map_of_even_traffic_is_bounded():
    t = np.arange(10**6, dtype=np.int64) * SECOND
    rate = folds.rate_rule(30, 60.0)
    one = rate.summarise({"t": t})
    assert len(one) <= 3 + 3 * 61
    two = rate.summarise({"t": t + 10**6 * SECOND})
    assert len(rate.compose(one, two)) <= len(one)
    breaker = folds.breaker_rule(3, 60.0)
    ok = (np.arange(10**6) % 7 == 0).astype(np.int64)
    assert len(breaker.summarise({"t": t, "ok": ok})) <= 3 + 4 * 61 + 9


traffic = st.lists(st.tuples(st.integers(0, 12), st.booleans(), st.integers(0, 7)), min_size=4, max_size=40)


@settings(max_examples=150, deadline=None)
@given(traffic, st.integers(1, 6), st.integers(1, 4))
def test_composed_maps_lead_where_rows_lead(rows, size, threshold):
    t = np.cumsum([r[0] for r in rows]) * SECOND
    columns = {"t": t, "ok": np.array([r[1] for r in rows], np.int64), "move": np.array([r[2] for r in rows], np.int64)}
    for rule in (folds.rate_rule(2, 10.0), folds.breaker_rule(threshold, 10.0), folds.guard_rule()):
        parts = [{c: v[i:i + size] for c, v in columns.items()} for i in range(0, len(rows), size)]
        maps = [rule.summarise(p) for p in parts]
        start = np.array(rule.start)
        left, right = reduce(rule.compose, maps), reduce(lambda a, b: rule.compose(b, a), reversed(maps))
        _, want = rule.replay(start[None, :], np.array([0, len(rows)]), columns)
        state = start
        for m in maps:
            state = rule.enter(state, m)
        for got in (state, rule.enter(start, left), rule.enter(start, right)):
            assert got.tolist() == want.tolist()


def test_stream_of_numbers_beside_nulls_equals_the_table(spark):
    schema, rows, _, _ = awkward("long")
    asked = spark.createDataFrame(rows, schema).withColumnRenamed("k", "identity").withColumn("at", F.timestamp_seconds("s"))
    asked = asked.select("identity", "id", "at", "other").where("at is not null")
    path = scratch_dir(spark, "feed")
    asked.where("id < 100").coalesce(1).write.parquet(path)
    asked.where("id >= 100").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(asked.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = land(sequential.rate_limit_stream(stream, 2, 60.0, late="0 seconds"))
    columns = ["identity", "used", "allowed", "remaining", "retry_after"]
    assert collected(got, columns) == collected(folds.rate_limit(asked, 2, 60.0), columns)


class Handle:
    """A stand-in for Spark's state handle that shows what a processor keeps."""

    def __init__(self):
        self.values, self.timers = {}, set()

    def getValueState(self, name, schema):
        return Value(self.values, name)

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class Value:
    def __init__(self, values, name):
        self.values, self.name = values, name

    def exists(self):
        return self.name in self.values

    def get(self):
        return self.values[self.name]

    def update(self, value):
        self.values[self.name] = value

    def clear(self):
        self.values.pop(self.name, None)


def test_state_ends_with_what_it_stands_for():
    from pyspark.sql import Row

    def fed(rule, ends, *batches):
        handle, replay = Handle(), sequential.Replay(rule, ["t", "ok", "move"], ["t"], ends)
        replay.init(handle)
        for rows in batches:
            list(replay.handleInputRows(("k",), iter([Row(t=t * SECOND, ok=ok, move=move) for t, ok, move in rows]), None))
        return handle, replay

    handle, replay = fed(folds.rate_rule(2, 60.0), sequential.Ends(lambda s, now: s[0]), [(5, 1, 0), (9, 1, 0)], [(70, 1, 0)])
    assert handle.timers == {130_000}
    list(replay.handleExpiredTimer(("k",), None, None))
    assert handle.values == {}
    broken = sequential.Ends(lambda s, now: s[1] + 60 * SECOND if s[0] else sequential.Ends.NEVER if s[2] else None)
    assert fed(folds.breaker_rule(2, 60.0), broken, [(1, 1, 0)])[0].values == {}
    handle, _ = fed(folds.breaker_rule(2, 60.0), broken, [(1, 0, 0)])
    assert handle.values["state"] == (0, 0, 1) and not handle.timers
    handle, _ = fed(folds.breaker_rule(2, 60.0), broken, [(1, 0, 0)], [(2, 0, 0)])
    assert handle.timers == {62_000}


def test_streamed_queries_equal_the_table(spark, sf):
    from darkroom.plans import QUERIES

    for name in ("st4_until_terminal", "st6_rate_limit"):
        batch, streamed = QUERIES[name](spark, sf), QUERIES[f"{name}_stream"](spark, sf)
        assert sorted(map(str, streamed.select(*batch.columns).collect())) == sorted(map(str, batch.collect()))
    assert table(spark, sf, "events", stream=True).isStreaming
