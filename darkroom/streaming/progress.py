"""Job progress as a stream, and the same questions asked of a finished table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from darkroom.functions import fixed, payloads

EVENT = "job_id string, seq bigint, state string, progress double, detail string, terminal boolean, at timestamp"


def progress_source(spark: SparkSession, path: str | None = None, **kafka: str) -> DataFrame:
    """Live payloads, one JSON text per row: files under ``path``, or a Kafka topic."""
    if path is not None:
        return spark.readStream.format("text").load(path).withColumnRenamed("value", "payload")
    stream = spark.readStream.format("kafka").options(**kafka).load()
    return stream.select(F.col("value").cast("string").alias("payload"))


def decode_events(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, rejected payloads). Broken payloads are set aside, they do not stop the rest."""
    read = raw.withColumn("__e", payloads.event_from_json(F.col("payload")))
    kept = [c for c in raw.columns if c != "payload"]
    events = read.where(F.col("__e").isNotNull()).select(*kept, "__e.*")
    return events, read.where(F.col("__e").isNull()).drop("__e")


def terminal(state: Column) -> Column:
    return state.isin(*fixed.TERMINAL)


# Finished tables. Events need job_id, seq, state, at.


def latest_event(events: DataFrame, now: Column | None = None,
                 ttl_seconds: float = fixed.EVENT_TTL_SECONDS) -> DataFrame:
    """Last event per job; with ``now``, jobs quiet for longer than the TTL are forgotten."""
    rest = [c for c in events.columns if c not in ("job_id", "seq")]
    last = events.groupBy("job_id").agg(F.max_by(F.struct("seq", *rest), F.col("seq")).alias("__e"))
    last = last.select("job_id", "__e.*")
    if now is None:
        return last
    age = F.unix_micros(now) - F.unix_micros("at")
    return last.where(age <= int(ttl_seconds * 1_000_000))


def until_terminal(events: DataFrame) -> DataFrame:
    """Events of each job up to and including its first final one."""
    ends = events.where(terminal(F.col("state"))).groupBy("job_id").agg(F.min("seq").alias("__end"))
    return events.join(ends, "job_id", "left").where(
        F.col("__end").isNull() | (F.col("seq") <= F.col("__end"))
    ).drop("__end")


def stalled_jobs(events: DataFrame, now: Column, idle_seconds: float) -> DataFrame:
    """Unfinished jobs with nothing published for ``idle_seconds``."""
    last = latest_event(events.select("job_id", "seq", "state", "at"))
    idle = (F.unix_micros(now) - F.unix_micros("at")) / F.lit(1_000_000.0)
    return last.where(~terminal(F.col("state"))).withColumn("idle_seconds", idle).where(
        F.col("idle_seconds") >= idle_seconds
    )


def replay_then_follow(steps: DataFrame, live: DataFrame) -> DataFrame:
    """Recorded steps, then live events not recorded yet; finished jobs are not followed.

    Each (job_id, seq) appears once. ``live`` may be a stream: it is only filtered against the
    recorded table, and its own repeats are dropped within its watermark.
    """
    recorded = steps.select("job_id", "seq").distinct()
    finished = steps.where(terminal(F.col("state"))).select("job_id").distinct()
    fresh = live.join(recorded, ["job_id", "seq"], "left_anti").join(finished, "job_id", "left_anti")
    if live.isStreaming:
        return fresh.dropDuplicatesWithinWatermark(["job_id", "seq"])
    replayed = steps.withColumn("origin", F.lit("replay"))
    return replayed.unionByName(
        fresh.dropDuplicates(["job_id", "seq"]).withColumn("origin", F.lit("live"))
    )


# Streams. One processor per question; rows of a micro-batch are put in order first.


def _ordered(batches: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(batches)).sort_values(by, kind="stable")


class Latest(StatefulProcessor):
    """Keeps each job's last event until the TTL; emits it whenever it moves on."""

    def __init__(self, ttl_seconds: float):
        self.ttl = int(ttl_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq bigint", self.ttl)

    def handleInputRows(self, key, rows, timerValues):
        batch = _ordered(rows, ["seq"])
        newest = batch.iloc[-1:]
        if not self.last.exists() or self.last.get()[0] < int(newest["seq"].iloc[0]):
            self.last.update((int(newest["seq"].iloc[0]),))
            yield newest

    def close(self) -> None:
        pass


#: Keys that ``until_terminal_stream`` deals its jobs to.
BUCKETS = 4096


class UntilTerminal(StatefulProcessor):
    """Passes a job's events through until its first final one. A key is a bucket of many jobs.

    That a job has ended is remembered until the watermark is ``forget_seconds`` past its end. Most jobs
    have an event or two, and a call to the state store takes far longer than an event: ended jobs
    of a bucket are read, added and dropped together.
    """

    def __init__(self, forget_seconds: float, ended: T.StructType):
        self.forget, self.fields = int(forget_seconds * 1000), ended

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ended = handle.getListState("ended", self.fields)

    def _stored(self) -> list[tuple]:
        return [tuple(e) for e in self.ended.get()] if self.ended.exists() else []

    def handleInputRows(self, key, rows, timerValues):
        now = timerValues.getCurrentWatermarkInMs()
        known, jobs, fresh = {job for job, _ in self._stored()}, {}, []
        for r in rows:
            if r["job_id"] not in known:
                jobs.setdefault(r["job_id"], []).append(r)
        for job, held in jobs.items():
            ends = [r for r in held if r["state"] in TERMINAL_STATES]
            if ends:
                last = min(ends, key=lambda r: r["seq"])
                held = [r for r in held if r["seq"] <= last["seq"]]
                at = now if last["at"] is None else int(last["at"].timestamp() * 1000) + 1
                fresh.append((job, at + self.forget))
            yield from sorted(held, key=lambda r: r["seq"])
        if fresh:
            self.ended.appendList(fresh)
            self.handle.registerTimer(min(due for _, due in fresh))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        stored = self._stored()
        standing = [e for e in stored if e[1] > now]
        if not standing:
            self.ended.clear()
        elif len(standing) < len(stored):
            self.ended.put(standing)
            self.handle.registerTimer(min(due for _, due in standing))
        yield from ()

    def close(self) -> None:
        pass


TERMINAL_STATES = list(fixed.TERMINAL)


class Stalled(StatefulProcessor):
    """Reports a job once nothing has come for ``idle_seconds``; starts over when something does."""

    def __init__(self, idle_seconds: float):
        self.idle = int(idle_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "at bigint")

    def handleInputRows(self, key, rows, timerValues):
        batch = _ordered(rows, ["seq"])
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
            self.due.clear()
        if batch["state"].iloc[-1] not in TERMINAL_STATES:
            due = timerValues.getCurrentProcessingTimeInMs() + self.idle
            self.handle.registerTimer(due)
            self.due.update((due,))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.due.clear()
        yield pd.DataFrame({"job_id": [key[0]], "idle_seconds": [self.idle / 1000.0]})

    def close(self) -> None:
        pass


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def latest_event_stream(events: DataFrame, ttl_seconds: float = fixed.EVENT_TTL_SECONDS) -> DataFrame:
    return events.groupBy("job_id").transformWithStateInPandas(
        Latest(ttl_seconds), _schema(events), "Update", "ProcessingTime"
    )


def until_terminal_stream(
    events: DataFrame, forget_seconds: float = fixed.EVENT_TTL_SECONDS, late: str = "10 minutes"
) -> DataFrame:
    """``until_terminal`` on a stream. Events of a job that come after it has been forgotten pass again."""
    ended = T.StructType([T.StructField("job_id", events.schema["job_id"].dataType), T.StructField("due", T.LongType())])
    dealt = events.withWatermark("at", late).withColumn("__bucket", F.pmod(F.xxhash64("job_id"), F.lit(BUCKETS)))
    return dealt.groupBy("__bucket").transformWithState(
        UntilTerminal(forget_seconds, ended), dealt.schema, "Append", "EventTime"
    ).drop("__bucket")


def stalled_jobs_stream(events: DataFrame, idle_seconds: float) -> DataFrame:
    return events.groupBy("job_id").transformWithStateInPandas(
        Stalled(idle_seconds), "job_id string, idle_seconds double", "Update", "ProcessingTime"
    )
