"""Streams fed in several micro-batches give what the finished table gives."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from darkroom.functions import payloads
from darkroom.operators import folds
from darkroom.plans.tables import steps, table
from darkroom.session import scratch_dir
from darkroom.streaming import progress, sequential


def _feed(spark, df, order, parts=3):
    """Write ``df`` as ``parts`` files in ``order`` and read them one per micro-batch."""
    path = scratch_dir(spark, "feed")
    ids = [r[0] for r in df.select(order).orderBy(order).collect()]
    edges = [ids[len(ids) * i // parts] for i in range(parts)] + [ids[-1] + 1]
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        df.where((F.col(order) >= low) & (F.col(order) < high)).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.02)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _drain(spark, stream, mode="append"):
    landed = scratch_dir(spark, "landed")

    def keep(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(landed)

    query = (
        stream.writeStream.outputMode(mode).foreachBatch(keep)
        .option("checkpointLocation", scratch_dir(spark, "offsets")).trigger(availableNow=True).start()
    )
    assert query.awaitTermination(90)
    return spark.read.parquet(landed)


def _follow(spark, stream, schema, expected, columns):
    """Run a stream with timers, which has no end, until ``expected`` rows show or time is up."""
    landed = scratch_dir(spark, "landed")

    def keep(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(landed)

    query = (
        stream.writeStream.outputMode("update").foreachBatch(keep)
        .option("checkpointLocation", scratch_dir(spark, "offsets"))
        .trigger(processingTime="300 milliseconds").start()
    )
    got = []
    deadline = time.monotonic() + 40
    while time.monotonic() < deadline and query.isActive:
        time.sleep(1)
        try:
            rows = spark.read.schema(f"{schema}, batch int").parquet(landed)
            got = _rows(columns(rows), "*")
        except Exception:  # noqa: BLE001 - nothing has been written yet
            continue
        if got == expected:
            break
    query.stop()
    return got


def _rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def events(spark, sf):
    rows = steps(spark, sf).select("job_id", F.col("id").alias("seq"), "state", "at")
    return rows.cache()


def test_until_terminal(spark, events):
    got = _drain(spark, progress.until_terminal_stream(_feed(spark, events, "seq")))
    assert _rows(got, "job_id", "seq") == _rows(progress.until_terminal(events), "job_id", "seq")


def test_latest_event_last_word(spark, events):
    expected = _rows(progress.latest_event(events), "job_id", "seq")
    stream = progress.latest_event_stream(_feed(spark, events, "seq"))
    got = _follow(
        spark, stream, "job_id string, seq bigint, state string, at timestamp", expected,
        lambda rows: rows.groupBy("job_id").agg(F.max_by("seq", "batch").alias("seq")),
    )
    assert got == expected


def test_rate_limit(spark, sf):
    asked = table(spark, sf, "events").select(
        F.col("user_id").alias("identity"), F.col("event_id").alias("id"), F.col("ts").alias("at")
    )
    got = _drain(spark, sequential.rate_limit_stream(_feed(spark, asked, "id"), 3, 86400.0))
    columns = ("identity", "id", "used", "allowed", "remaining", "retry_after")
    assert _rows(got, *columns) == _rows(folds.rate_limit(asked, 3, 86400.0), *columns)


def test_breaker(spark, sf):
    calls = table(spark, sf, "events").select(
        F.col("user_id").alias("provider"), F.col("event_id").alias("id"), F.col("ts").alias("at"),
        F.col("event_type").isin("purchase", "signup").alias("ok"),
    )
    got = _drain(spark, sequential.breaker_stream(_feed(spark, calls, "id"), 3, 86400.0))
    columns = ("provider", "id", "ok", "skipped", "opened", "failures_in_a_row")
    assert _rows(got, *columns) == _rows(folds.breaker_state(calls, 3, 86400.0), *columns)


def test_guard(spark, sf):
    moves = steps(spark, sf).select("job_id", "id", "at", "state")
    got = _drain(spark, sequential.guard_transitions_stream(_feed(spark, moves, "id")))
    key = [F.col("job_id"), F.col("id"), F.coalesce("held", F.lit("")), F.col("verdict")]
    assert _rows(got, *key) == _rows(folds.guard_transitions(moves), *key)


def test_stalled_jobs_are_reported_once_idle(spark, events):
    last = progress.latest_event(events).where(~F.col("state").isin("done", "failed", "cancelled"))
    expected = _rows(last, "job_id")
    stream = progress.stalled_jobs_stream(_feed(spark, events, "seq", parts=1), 0.5)
    got = _follow(
        spark, stream, "job_id string, idle_seconds double", expected, lambda rows: rows.select("job_id")
    )
    assert got == expected


def test_replay_then_follow_delivers_once(spark, events):
    recorded = events.where(F.hour("at") < 16)
    live = events.where(F.hour("at") >= 8)
    stream = _feed(spark, live.unionByName(live), "seq").withWatermark("at", "40 days")
    followed = _drain(spark, progress.replay_then_follow(recorded, stream))
    want = progress.replay_then_follow(recorded, live.unionByName(live)).where("origin = 'live'")
    assert _rows(followed, "job_id", "seq") == _rows(want, "job_id", "seq")


def test_broken_payloads_are_set_aside(spark):
    rows = [
        (1, '{"job_id": "a", "state": "running"}'), (2, '{"job_id": "a", "state": "run'), (3, "[]"),
        (4, '{"state": "done"}'), (5, '{"job_id": "b", "state": "done", "terminal": true, "progress": 1.0, "detail": "x"}'),
        (6, None),
    ]
    good, bad = progress.decode_events(spark.createDataFrame(rows, "n int, payload string"))
    assert _rows(good, "n", "job_id", "state", "progress", "detail", "terminal") == [
        (1, "a", "running", 0.0, "", False), (5, "b", "done", 1.0, "x", True)
    ]
    assert [r[0] for r in _rows(bad, "n")] == [2, 3, 4, 6]


def test_event_json_round_trip(spark):
    sent = spark.createDataFrame([("a", "done", None, None, None)], "j string, s string, p double, d string, t boolean")
    text = payloads.event_to_json(*[F.col(c) for c in "jspdt"])
    assert sent.select(payloads.event_from_json(text).alias("e")).first()["e"].asDict() == {
        "job_id": "a", "state": "done", "progress": 0.0, "detail": "", "terminal": False
    }


def test_ended_jobs_of_a_bucket_share_their_state_calls():
    """A thousand jobs cost a few calls to the state store; a job ends for as long as it is remembered."""
    from datetime import datetime, timezone
    from types import SimpleNamespace

    from pyspark.sql import Row

    class Store:
        def __init__(self):
            self.rows, self.timers, self.calls = [], [], 0

        def __getattr__(self, name):
            def call(*args):
                self.calls += 1
                if name == "getListState":
                    return self
                if name in ("get", "exists"):
                    return list(self.rows) if name == "get" else bool(self.rows)
                if name == "registerTimer":
                    self.timers.append(args[0])
                else:
                    self.rows = {"put": list, "appendList": lambda x: self.rows + list(x), "clear": lambda: []}[name](*args)
            return call

    clock = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    event = lambda job, seq, state: Row(job_id=job, seq=seq, state=state, at=datetime.fromtimestamp(10, timezone.utc))
    store, judge = Store(), progress.UntilTerminal(60.0, None)
    judge.init(store)
    first = [event(f"j{i}", s, state) for i in range(1000) for s, state in ((3, "running"), (1, "queued"), (2, "done"))]
    assert [r.seq for r in judge.handleInputRows((0,), iter(first), clock(0))] == [1, 2] * 1000
    assert store.calls <= 5 and store.timers == [70_001]
    late = [event("j5", 9, "running"), event("new", 1, "running")]
    assert [r.job_id for r in judge.handleInputRows((0,), iter(late), clock(70_001))] == ["new"]
    list(judge.handleInputRows((0,), iter([Row(job_id="z", seq=1, state="done", at=None)]), clock(70_001)))
    list(judge.handleExpiredTimer((0,), clock(70_001), None))
    assert store.rows == [("z", 130_001)] and store.timers[-1] == 130_001
    assert [r.job_id for r in judge.handleInputRows((0,), iter(late), clock(70_001))] == ["j5", "new"]
