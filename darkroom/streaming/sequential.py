"""The sequential rules of ``operators.folds`` on live streams: same replay, state kept per key.

State ends with what it stands for: a window, a cool-down, a finished job. Timers run on event
time, so a state goes once the watermark has passed its end, and a replayed backlog gives what the
finished table gives. Rows travel as Spark rows, so ids and keys keep their types beside nulls.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from darkroom.functions import fixed
from darkroom.operators.folds import (
    Rule,
    breaker_rule,
    guard_rule,
    named_verdicts,
    rate_rule,
    with_moves,
)

#: How far behind the newest event a stream's rows may come.
LATE = "10 minutes"


@dataclass(frozen=True)
class Ends:
    """When a state stops mattering: microseconds of event time, ``None`` for now, or never."""

    at: Callable[[list[int], int], int | None]
    NEVER = 1 << 62


class Replay(StatefulProcessor):
    """Carries a rule's state from one micro-batch of a key to the next.

    A micro-batch of one key is put in order before it is replayed; how long it can get is bounded
    by the trigger's options (``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``).
    """

    def __init__(self, rule: Rule, columns: list[str], order: list[str], ends: Ends):
        self.rule, self.order, self.ends = rule, order, ends
        self.names = [*columns, *rule.outputs]

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = ", ".join(f"s{i} bigint" for i in range(len(self.rule.start)))
        self.handle = handle
        self.state = handle.getValueState("state", fields)
        self.due = handle.getValueState("due", "at bigint")

    def handleInputRows(self, key, rows, timerValues):
        every, named = list(rows), Row(*self.names)
        judged = [r for r in every if all(r[c] is not None for c in self.rule.inputs)]
        for r in every:
            if any(r[c] is None for c in self.rule.inputs):
                yield named(*r, *[None] * len(self.rule.outputs))
        if not judged:
            return
        judged.sort(key=lambda r: [(r[c] is not None, r[c]) for c in self.order])
        state = [int(v) for v in self.state.get()] if self.state.exists() else list(self.rule.start)
        arrays = {c: np.array([r[c] for r in judged], dtype=np.int64) for c in self.rule.inputs}
        outputs, left = self.rule.replay(np.array([state], dtype=np.int64), np.array([0, len(judged)]), arrays)
        self._keep([int(v) for v in left], int(arrays["t"][-1]))
        for i, r in enumerate(judged):
            yield named(*r, *[outputs[c][i].item() for c in self.rule.outputs])

    def _keep(self, state: list[int], now: int) -> None:
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
            self.due.clear()
        end = self.ends.at(state, now)
        if end is None:
            self.state.clear()
            return
        self.state.update(tuple(state))
        if end < Ends.NEVER:
            due = -(-end // 1000)  # timers count milliseconds
            self.handle.registerTimer(due)
            self.due.update((due,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.state.clear()
        self.due.clear()
        yield from ()

    def close(self) -> None:
        pass


def _run(stream: DataFrame, key: str, order: list[str], rule: Rule, ends: Ends, late: str) -> DataFrame:
    added = T.StructType.fromDDL(", ".join(f"{n} {t}" for n, t in rule.outputs.items()))
    schema = T.StructType([*stream.schema.fields, *added.fields])
    replay = Replay(rule, stream.columns, order, ends)
    return stream.withWatermark("at", late).groupBy(key).transformWithState(replay, schema, "Append", "EventTime")


def rate_limit_stream(
    requests: DataFrame, limit: int, window_seconds: float = fixed.RATE_WINDOW_SECONDS, late: str = LATE
) -> DataFrame:
    """``folds.rate_limit`` on a stream; a client's counter goes when its window has ended."""
    timed = requests.withColumn("t", F.unix_micros("at"))
    ends = Ends(lambda state, now: state[0])
    return _run(timed, "identity", ["t", "id"], rate_rule(limit, window_seconds), ends, late).drop("t")


def breaker_stream(
    calls: DataFrame, threshold: int = fixed.BREAKER_THRESHOLD,
    cooldown_seconds: float = fixed.BREAKER_COOLDOWN_SECONDS, late: str = LATE,
) -> DataFrame:
    """``folds.breaker_state`` on a stream. A healthy provider has no state, an open one until its
    cool-down ends; only failures in a row below the threshold are kept as long as they stand.
    """
    cooldown = int(cooldown_seconds * 1_000_000)
    ends = Ends(lambda state, now: state[1] + cooldown if state[0] else Ends.NEVER if state[2] else None)
    timed = calls.withColumns({"t": F.unix_micros("at"), "ok": F.col("ok").cast("bigint")})
    ruled = _run(timed, "provider", ["t", "id"], breaker_rule(threshold, cooldown_seconds), ends, late)
    return ruled.withColumn("ok", F.col("ok") == 1).drop("t")


def guard_transitions_stream(
    steps: DataFrame, forget_seconds: float = fixed.EVENT_TTL_SECONDS, late: str = LATE
) -> DataFrame:
    """``folds.guard_transitions`` on a stream. A finished job is forgotten ``forget_seconds`` after its
    last step; a step that comes later still starts it anew.
    """
    ended = {i for i, s in enumerate(fixed.STATES) if s in fixed.TERMINAL}
    span = int(forget_seconds * 1_000_000)
    ends = Ends(lambda state, now: now + span if state[0] in ended else Ends.NEVER)
    return named_verdicts(_run(with_moves(steps), "job_id", ["t", "id"], guard_rule(), ends, late))
