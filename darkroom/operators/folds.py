"""Sequential rules per key, run in parallel over long histories.

A quota window that starts at a client's first request, a breaker that opens after failures in
a row, and a state machine that refuses moves all need their rows in order, and each row's
outcome depends on the state left by the one before. Short histories are replayed whole. A
history longer than ``rows`` is cut by position into blocks of that many rows. Each block reports
a map from the states it can be entered with to the states it is left in: an open window or
cool-down that began before the block ends within one window of its first row, so only rows
that near can be restarted at. Maps compose, and a composed map is no wider than its first part.
They are composed ``FAN`` at a time in rounds of grouped tasks, entry states are handed down the
same rounds, and every block is then replayed from its own entry state, apart from all others.

Rows move as Arrow columns, so keys and other columns keep their types and nulls.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from darkroom.functions import fixed
from darkroom.operators.ordered import join_null_safe
from darkroom.operators.ranks import ordinal_rank
from darkroom.session import cut_lineage

Arrays = dict[str, np.ndarray]
DEFAULT_ROWS = 1 << 20
FAN_BITS = 5
#: Maps that meet in one task.
FAN = 1 << FAN_BITS


@dataclass(frozen=True)
class Rule:
    """A sequential rule over integer columns. States and block maps are arrays of 64-bit integers.

    ``replay`` takes the entry state of each stretch of rows, the edges of the stretches, and the
    input columns; it returns the output columns and the state the last stretch is left in.
    """

    start: tuple[int, ...]
    inputs: tuple[str, ...]
    outputs: dict[str, str]
    summarise: Callable[[Arrays], np.ndarray]
    compose: Callable[[np.ndarray, np.ndarray], np.ndarray]
    enter: Callable[[np.ndarray, np.ndarray], np.ndarray]
    replay: Callable[[np.ndarray, np.ndarray, Arrays], tuple[Arrays, np.ndarray]]


def _changes(columns: Sequence[pa.Array], before: Sequence[pa.Array] | None) -> np.ndarray:
    """Whether each row's keys differ from the row before; nulls are equal to each other, and so are NaNs."""
    differs = np.zeros(len(columns[0]) - (before is None), dtype=bool)
    for i, column in enumerate(columns):
        whole = column if before is None else pa.concat_arrays([before[i], column])
        one, two = whole.slice(0, len(whole) - 1), whole.slice(1)
        if pa.types.is_nested(column.type):
            differs |= np.array([a != b for a, b in zip(one.to_pylist(), two.to_pylist(), strict=True)], dtype=bool)
            continue
        same = pc.or_(pc.fill_null(pc.equal(one, two), False), pc.and_(one.is_null(), two.is_null()))
        if pa.types.is_floating(column.type):
            same = pc.or_(same, pc.fill_null(pc.and_(pc.is_nan(one), pc.is_nan(two)), False))
        differs |= ~same.to_numpy(zero_copy_only=False)
    return np.append(True, differs) if before is None else differs


def _stretches(batches: Iterator[pa.RecordBatch], by: Sequence[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches that hold rows, with a mark on each row that starts a new (key, block)."""
    before = None
    for batch in batches:
        if batch.num_rows:
            columns = [batch.column(c) for c in by]
            yield batch, _changes(columns, before)
            before = [c.slice(len(c) - 1) for c in columns]


def _numbers(batch: pa.RecordBatch, columns: Sequence[str]) -> Arrays:
    return {c: pc.fill_null(batch.column(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns}


def _maps(heavy: DataFrame, keys: list[str], rule: Rule, schema: T.StructType) -> DataFrame:
    """(keys, block, map) per block of the heavy keys' rows, which come in order."""
    by = [*keys, "__block"]

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Arrays] = []
        name: list[pa.Array] = []

        def done() -> pa.RecordBatch:
            arrays = {c: np.concatenate([h[c] for h in held]) for c in rule.inputs}
            return pa.RecordBatch.from_arrays([*name, pa.array([rule.summarise(arrays)], pa.list_(pa.int64()))], [*by, "__map"])

        for batch, starts in _stretches(batches, by):
            numbers = _numbers(batch, rule.inputs)
            edges = np.unique(np.append(np.flatnonzero(starts), [0, batch.num_rows]))
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                if starts[low]:
                    if held:
                        yield done()
                    held, name = [], [batch.column(c).slice(low, 1) for c in by]
                held.append({c: v[low:high] for c, v in numbers.items()})
        if held:
            yield done()

    return heavy.select(*by, "__at", *[c for c in rule.inputs if c not in by]).repartition(*by).sortWithinPartitions(
        *by, "__at"
    ).mapInArrow(summaries, schema)


def _entries(maps: DataFrame, keys: list[str], rule: Rule) -> DataFrame:
    """(keys, block, entry): the state each block is entered with, found in rounds of ``FAN`` maps."""
    kept = [f for f in maps.schema.fields if f.name in keys]
    longs = T.ArrayType(T.LongType())
    shape = lambda last: T.StructType([*kept, T.StructField("__block", T.LongType()), T.StructField(last, longs)])
    group = F.shiftright("__block", FAN_BITS).alias("__group")

    def listed(table: pa.Table) -> tuple[pa.Table, list[np.ndarray]]:
        table = table.sort_by("__block")
        return table, [np.array(m, dtype=np.int64) for m in table.column("__map").to_pylist()]

    def composed(table: pa.Table) -> pa.Table:
        table, found = listed(table)
        whole = reduce(rule.compose, found)
        first = table.slice(0, 1).select(keys)
        number = table.column("__block")[0].as_py() >> FAN_BITS
        return first.append_column("__block", pa.array([number], pa.int64())).append_column(
            "__map", pa.array([whole], pa.list_(pa.int64()))
        )

    def handed(table: pa.Table, state: np.ndarray) -> pa.Table:
        table, found = listed(table)
        states = []
        for block_map in found:
            states.append(state)
            state = rule.enter(state, block_map)
        return table.select([*keys, "__block"]).append_column("__entry", pa.array(states, pa.list_(pa.int64())))

    def from_start(table: pa.Table) -> pa.Table:
        return handed(table, np.array(rule.start, dtype=np.int64))

    def from_group(table: pa.Table, over: pa.Table) -> pa.Table:
        return handed(table, np.array(over.column("__entry")[0].as_py(), dtype=np.int64))

    levels, most = [maps], maps.agg(F.max("__block")).first()[0]
    while most >= FAN:
        levels.append(cut_lineage(levels[-1].groupBy(*keys, group).applyInArrow(composed, shape("__map"))))
        most >>= FAN_BITS
    known = levels[-1].groupBy(*keys).applyInArrow(from_start, shape("__entry"))
    for level in reversed(levels[:-1]):
        known = level.groupBy(*keys, group).cogroup(known.groupBy(*keys, F.col("__block").alias("__group"))).applyInArrow(
            from_group, shape("__entry")
        )
    return known


def fold(df: DataFrame, key: str | Sequence[str], order: Sequence[str], rule: Rule, *, rows: int = DEFAULT_ROWS) -> DataFrame:
    """Run ``rule`` over each key's rows in order; adds the rule's output columns.

    ``key`` names one column or several, of any type; null keys are keys like others. ``df`` holds
    the rule's inputs, integers, the time ``t`` in microseconds among them; ``order`` begins with it.
    A row with a null input is no part of any history: it comes back with null outputs.
    """
    keys = [key] if isinstance(key, str) else list(key)
    by, columns = [*keys, "__block"], df.columns
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in rule.inputs])
    hashed = F.xxhash64(*keys)
    heavy = (
        df.where(complete).groupBy(hashed.alias("__h")).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > rows)
        .select("__h", F.lit(True).alias("__heavy"))
    )
    added = T.StructType.fromDDL(", ".join(f"{n} {t}" for n, t in rule.outputs.items()))
    kinds = {"bigint": pa.int64(), "boolean": pa.bool_()}
    start = np.array(rule.start, dtype=np.int64)

    def replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One output batch per input batch; a stretch cut by a batch edge keeps its state."""
        state = start
        for batch, starts in _stretches(batches, by):
            judged = batch.column("__block").to_numpy(zero_copy_only=False) >= 0
            place = np.flatnonzero(judged)
            firsts = np.flatnonzero(starts[judged])
            edges = np.unique(np.append(firsts, [0, len(place)]))
            outputs: Arrays = {}
            if len(place):
                given = batch.column("__entry").take(pa.array(place[edges[:-1]])).to_pylist() if "__entry" in batch.schema.names else None
                states = np.array([
                    state if not starts[place[at]] else start if given is None or given[i] is None else given[i]
                    for i, at in enumerate(edges[:-1])
                ], dtype=np.int64)
                outputs, state = rule.replay(states, edges, {c: v[judged] for c, v in _numbers(batch, rule.inputs).items()})
            new = []
            for name, kind in rule.outputs.items():
                values = np.zeros(batch.num_rows, dtype=bool if kind == "boolean" else np.int64)
                if len(place):
                    values[place] = outputs[name]
                new.append(pa.array(values, kinds[kind], mask=~judged))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], *new], [*columns, *rule.outputs])

    schema = T.StructType([*df.schema.fields, *added.fields])
    number = F.when(complete, F.lit(0)).otherwise(F.lit(-1)).cast("bigint").alias("__block")
    if heavy.isEmpty():
        plain = df.select("*", number).repartition(*keys).sortWithinPartitions(*by, *order)
        return plain.mapInArrow(replayed, schema)

    marked = df.withColumn("__h", hashed).join(heavy, "__h", "left").drop("__h")
    long = complete & F.col("__heavy").isNotNull()
    placed = ordinal_rank(marked.where(long).drop("__heavy"), [*keys, *order], "__at")
    placed = placed.withColumn("__block", F.floor(F.col("__at") / F.lit(rows)).cast("bigint"))
    pairs = T.StructType([
        *[f for f in df.schema.fields if f.name in keys], T.StructField("__block", T.LongType()),
        T.StructField("__map", T.ArrayType(T.LongType())),
    ])
    pairs = T.StructType([pairs[c] for c in [*by, "__map"]])
    maps = cut_lineage(_maps(placed, keys, rule, pairs))
    dense = join_null_safe(placed, _entries(maps, keys, rule), by).select(*columns, "__at", "__block", "__entry")
    light = marked.where(~long).select(
        *columns, F.lit(None).cast("bigint").alias("__at"), number, F.lit(None).cast("array<bigint>").alias("__entry")
    )
    both = light.unionByName(dense).repartition(*by).sortWithinPartitions(*by, "__at", *order)
    return both.mapInArrow(replayed, schema)


# Maps of rules that are restarted at a moment: [rows, pieces, last moment that can matter,
# last time of each piece..., exit columns...]. A state that holds until a moment restarts the rule at
# the first row at or after it, in the first piece whose last time is not before it.


def _pieces(rows: int, reach: int, times: np.ndarray, exits: np.ndarray) -> np.ndarray:
    """Equal neighbouring exits become one piece; pieces wholly beyond ``reach`` go."""
    needed = int(np.searchsorted(times, reach, "left")) + 1
    times, exits = times[:needed], exits[:needed]
    last = np.flatnonzero(np.append((exits[1:] != exits[:-1]).any(axis=1), True))
    return np.concatenate([[rows, len(last), reach], times[last], exits[last].T.ravel()]).astype(np.int64)


def _read(block_map: np.ndarray, width: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    rows, pieces, reach = (int(v) for v in block_map[:3])
    times = block_map[3:3 + pieces]
    return rows, reach, times, block_map[3 + pieces:3 + pieces * (1 + width)].reshape(width, pieces).T


def _joined(one: np.ndarray, two: np.ndarray, width: int, through: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The pieces of two neighbouring blocks together; ``through`` leads exits of the first through the second."""
    rows, reach, times, exits = _read(one, width)
    more, _, later, ends = _read(two, width)
    beyond = later > times[-1] if times[-1] < reach else np.zeros(len(later), dtype=bool)
    return _pieces(
        rows + more, reach, np.concatenate([times, later[beyond]]), np.concatenate([through(exits), ends[beyond]])
    )


def _each(replay_one: Callable[[np.ndarray, Arrays], tuple[Arrays, np.ndarray]]):
    """A replay of several stretches from one that takes a single stretch."""
    def replay(states: np.ndarray, edges: np.ndarray, a: Arrays) -> tuple[Arrays, np.ndarray]:
        parts = []
        for state, low, high in zip(states, edges[:-1], edges[1:], strict=True):
            outputs, left = replay_one(state, {c: v[low:high] for c, v in a.items()})
            parts.append(outputs)
        return {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}, left

    return replay


# A request quota. State: [end of the window, requests counted in it].


def rate_rule(limit: int, window_seconds: float = fixed.RATE_WINDOW_SECONDS) -> Rule:
    """A window opens at a client's first request and lasts ``window_seconds``.

    Refused requests still count. A limit of zero or less allows everything.
    """
    window = int(window_seconds * 1_000_000)

    def summarise(a: Arrays) -> np.ndarray:
        t = a["t"]
        n = len(t)
        following = np.searchsorted(t, t + window, "left")
        exits = np.empty((n, 2), dtype=np.int64)
        high = n
        while high > 0:  # one step per window, from the last one back
            low = int(np.searchsorted(following, high, "left"))
            here = np.arange(low, high)
            ends = following[here] >= n
            exits[here[ends]] = np.stack([t[here[ends]] + window, n - here[ends]], axis=1)
            exits[here[~ends]] = exits[following[here[~ends]]]
            high = low
        return _pieces(n, int(t[0]) + window, t, exits)

    def through(states: np.ndarray, block_map: np.ndarray) -> np.ndarray:
        rows, _, times, exits = _read(block_map, 2)
        at = np.searchsorted(times, states[:, 0], "left")
        stays = at == len(times)
        passed = np.stack([states[:, 0], states[:, 1] + rows], axis=1)
        return np.where(stays[:, None], passed, exits[np.minimum(at, len(times) - 1)])

    def compose(one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return _joined(one, two, 2, lambda exits: through(exits, two))

    def enter(state: np.ndarray, block_map: np.ndarray) -> np.ndarray:
        return through(state[None, :], block_map)[0]

    def replay(state: np.ndarray, a: Arrays) -> tuple[Arrays, np.ndarray]:
        t = a["t"]
        used = np.empty(len(t), dtype=np.int64)
        ends = np.empty(len(t), dtype=np.int64)
        end, count, at = int(state[0]), int(state[1]), 0
        while at < len(t):
            stop = int(np.searchsorted(t, end, "left"))
            if stop <= at:
                end, count = int(t[at]) + window, 0
                stop = int(np.searchsorted(t, end, "left"))
            used[at:stop] = count + np.arange(1, stop - at + 1)
            ends[at:stop] = end
            count, at = count + stop - at, stop
        left = ((ends - t) // 1000 + 500) // 1000
        allowed = (used <= limit) if limit > 0 else np.ones(len(t), dtype=bool)
        remaining = np.where(allowed, limit - used, 0) if limit > 0 else np.full(len(t), limit)
        retry = np.where(allowed, 0, np.maximum(left, 1))
        return {"used": used, "allowed": allowed, "remaining": remaining, "retry_after": retry}, np.array([end, count])

    outputs = {"used": "bigint", "allowed": "boolean", "remaining": "bigint", "retry_after": "bigint"}
    return Rule((-(1 << 62), 0), ("t",), outputs, summarise, compose, enter, _each(replay))


# A circuit breaker. State: [1 when open, when it opened, failures in a row].


def breaker_rule(
    threshold: int = fixed.BREAKER_THRESHOLD, cooldown_seconds: float = fixed.BREAKER_COOLDOWN_SECONDS
) -> Rule:
    """Opens after ``threshold`` failures in a row; calls while open are skipped, not counted.

    The first call ``cooldown_seconds`` or more after opening is let through with a clean count.
    """
    cooldown = int(cooldown_seconds * 1_000_000)

    def streaks(ok: np.ndarray) -> np.ndarray:
        at = np.arange(1, len(ok) + 1)
        return at - np.maximum.accumulate(np.where(ok, at, 0))

    def walk(a: Arrays, first: int, carried: int) -> Iterator[tuple[int, int, int, int]]:
        """(start, opening or -1, stop, carried) for each closed stretch from ``first``."""
        t, run = a["t"], streaks(a["ok"] == 1)
        tripped = np.flatnonzero(run >= threshold)
        while first < len(t):
            lead = _lead(a["ok"], first)
            opening = -1
            if carried and carried + lead >= threshold:
                opening = first + threshold - carried - 1
            else:
                where = int(np.searchsorted(tripped, first + threshold - 1, "left"))
                opening = int(tripped[where]) if where < len(tripped) else -1
            stop = len(t) if opening < 0 else int(np.searchsorted(t, t[opening] + cooldown, "left"))
            stop = max(stop, opening + 1)
            yield first, opening, stop, carried
            first, carried = stop, 0

    def _lead(ok: np.ndarray, first: int) -> int:
        """Failures from ``first`` on, as far as the threshold matters."""
        ahead = ok[first : first + threshold]
        return int(np.argmax(ahead == 1)) if (ahead == 1).any() else len(ahead)

    def final(a: Arrays, first: int, opening: int, carried: int) -> list[int]:
        if opening >= 0:
            return [1, int(a["t"][opening]), threshold]
        run = streaks(a["ok"][first:] == 1)
        whole = int(run[-1]) == len(run)
        return [0, 0, int(run[-1]) + (carried if whole else 0)]

    def summarise(a: Arrays) -> np.ndarray:
        t, n = a["t"], len(a["t"])
        run = streaks(a["ok"] == 1)
        tripped = np.flatnonzero(run >= threshold)
        at = np.arange(n)
        where = np.searchsorted(tripped, at + threshold - 1, "left")
        opens = where < len(tripped)
        opening = np.where(opens, tripped[np.minimum(where, max(len(tripped) - 1, 0))] if len(tripped) else 0, -1)
        resume = np.where(
            opens, np.maximum(np.searchsorted(t, t[np.maximum(opening, 0)] + cooldown, "left"), opening + 1), n
        )
        exits = np.empty((n, 3), dtype=np.int64)
        high = n
        while high > 0:  # one step per opening, from the last one back
            low = int(np.searchsorted(resume, high, "left"))
            here = np.arange(low, high)
            ends = resume[here] >= n
            done = here[ends]
            exits[done, 0] = opens[done]
            exits[done, 1] = np.where(opens[done], t[np.maximum(opening[done], 0)], 0)
            exits[done, 2] = np.where(opens[done], threshold, np.minimum(run[n - 1], n - done))
            exits[here[~ends]] = exits[resume[here[~ends]]]
            high = low
        # failures carried in matter only until the first success
        lead = _lead(a["ok"], 0)
        carried = np.empty((threshold, 3), dtype=np.int64)
        for c in range(threshold):
            first = threshold - c - 1
            if c and c + lead >= threshold:
                after = max(int(np.searchsorted(t, t[first] + cooldown, "left")), first + 1)
                carried[c] = exits[after] if after < n else (1, t[first], threshold)
            else:
                carried[c] = (0, 0, c + n) if lead == n and n < threshold else exits[0]
        return np.concatenate([_pieces(n, int(t[0]) + cooldown, t, exits), carried.ravel()])

    def through(states: np.ndarray, block_map: np.ndarray) -> np.ndarray:
        _, _, times, exits = _read(block_map, 3)
        carried = block_map[-3 * threshold:].reshape(threshold, 3)
        at = np.searchsorted(times, states[:, 1] + cooldown, "left")
        woken = np.where((at == len(times))[:, None], states, exits[np.minimum(at, len(times) - 1)])
        return np.where(states[:, :1] == 1, woken, carried[np.minimum(states[:, 2], threshold - 1)])

    def compose(one: np.ndarray, two: np.ndarray) -> np.ndarray:
        carried = one[-3 * threshold:].reshape(threshold, 3)
        return np.concatenate([_joined(one, two, 3, lambda exits: through(exits, two)), through(carried, two).ravel()])

    def enter(state: np.ndarray, block_map: np.ndarray) -> np.ndarray:
        return through(state[None, :], block_map)[0]

    def replay(state: np.ndarray, a: Arrays) -> tuple[Arrays, np.ndarray]:
        t, n = a["t"], len(a["t"])
        skipped, opened = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        streak = np.zeros(n, dtype=np.int64)
        first, carried = 0, int(state[2])
        if state[0]:
            first, carried = int(np.searchsorted(t, state[1] + cooldown, "left")), 0
            skipped[:first], streak[:first] = True, threshold
        last = state
        for start, opening, stop, held in walk(a, first, carried):
            end = stop if opening < 0 else opening + 1
            run = streaks(a["ok"][start:end] == 1)
            lead = run == np.arange(1, end - start + 1)
            streak[start:end] = run + np.where(lead, held, 0)
            if opening >= 0:
                opened[opening] = True
                skipped[end:stop], streak[end:stop] = True, threshold
            last = np.array(final(a, start, opening, held))
        return {"skipped": skipped, "opened": opened, "failures_in_a_row": streak}, last

    outputs = {"skipped": "boolean", "opened": "boolean", "failures_in_a_row": "bigint"}
    return Rule((0, 0, 0), ("t", "ok"), outputs, summarise, compose, enter, _each(replay))


# Job moves. State: [number of the state held, or ``_UNSET`` before the first step].

_NUMBER = {state: i for i, state in enumerate(fixed.STATES)}
#: Before the first step, and also the number of a move to a state that does not exist.
_UNSET = len(fixed.STATES)
#: What is held after a move, by what was held before it and by the move; an unknown move changes nothing.
_NEXT = np.array(
    [
        [*[_NUMBER[to] if to in fixed.TRANSITIONS[held] else _NUMBER[held] for to in fixed.STATES], _NUMBER[held]]
        for held in fixed.STATES
    ]
    + [list(range(_UNSET + 1))],
    dtype=np.int8,
)
VERDICTS = ("accepted", "illegal", "after cancel", "redelivered", "unknown state")


def guard_rule() -> Rule:
    """Only legal moves change the held state; a job's first step is taken as it comes.

    A step with an unknown state is refused, wherever it stands. ``verdict`` numbers ``VERDICTS``.
    Moves are functions on the eight states a job can be in, and functions compose: all rows of
    a batch are answered by doubling the stretch that each row's function covers.
    """
    cancelled = _NUMBER["cancelled"]
    ended = np.array([s in fixed.TERMINAL for s in fixed.STATES] + [False])

    def summarise(a: Arrays) -> np.ndarray:
        steps = _NEXT.T[a["move"]]
        while len(steps) > 1:
            odd = steps[-1:] if len(steps) % 2 else steps[:0]
            even = steps[: len(steps) // 2 * 2]
            steps = np.concatenate([np.take_along_axis(even[1::2], even[::2], axis=1), odd])
        return steps[0].astype(np.int64)

    def compose(one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return two[one]

    def enter(state: np.ndarray, block_map: np.ndarray) -> np.ndarray:
        return block_map[state]

    def replay(states: np.ndarray, edges: np.ndarray, a: Arrays) -> tuple[Arrays, np.ndarray]:
        firsts = edges[:-1]
        upto = _NEXT.T[a["move"]]
        # the first row of a stretch forgets what came before: its function is constant
        upto[firsts] = _NEXT[states[:, 0], a["move"][firsts]][:, None]
        covers, longest = 1, int(np.diff(edges).max())
        while covers < longest:
            upto[covers:] = np.take_along_axis(upto[covers:], upto[:-covers], axis=1)
            covers *= 2
        after = upto[:, 0].astype(np.int64)
        before = np.append(0, after[:-1])
        before[firsts] = states[:, 0]
        verdict = np.where(after != before, 0, np.where(before == cancelled, 2, np.where(ended[before], 3, 1)))
        verdict[a["move"] == _UNSET] = 4
        return {"held": before, "verdict": verdict}, after[-1:]

    return Rule((_UNSET,), ("t", "move"), {"held": "bigint", "verdict": "bigint"}, summarise, compose, enter, replay)


def with_moves(steps: DataFrame) -> DataFrame:
    """Steps with the two numbers the guard reads."""
    numbers = F.create_map(*[F.lit(v) for pair in _NUMBER.items() for v in pair])
    known = F.when(F.col("state").isNotNull(), F.try_element_at(numbers, F.col("state")))
    return steps.withColumns({"t": F.unix_micros("at"), "move": F.coalesce(known, F.lit(_UNSET)).cast("bigint")})


def named_verdicts(guarded: DataFrame) -> DataFrame:
    """Readable ``held`` and ``verdict`` in place of the numbers."""
    states = F.array(*[F.lit(s) for s in fixed.STATES])
    said = F.array(*[F.lit(s) for s in VERDICTS])
    return guarded.withColumns(
        {
            "held": F.get(states, F.col("held").cast("int")),
            "verdict": F.get(said, F.col("verdict").cast("int")),
        }
    ).drop("t", "move")


def rate_limit(
    requests: DataFrame, limit: int, window_seconds: float = fixed.RATE_WINDOW_SECONDS,
    rows: int = DEFAULT_ROWS,
) -> DataFrame:
    """Requests (identity, id, at) with used, allowed, remaining and retry_after.

    A request without a time is not counted and gets nulls.
    """
    timed = requests.withColumn("t", F.unix_micros("at"))
    return fold(timed, "identity", ["t", "id"], rate_rule(limit, window_seconds), rows=rows).drop("t")


def breaker_state(
    calls: DataFrame, threshold: int = fixed.BREAKER_THRESHOLD,
    cooldown_seconds: float = fixed.BREAKER_COOLDOWN_SECONDS, rows: int = DEFAULT_ROWS,
) -> DataFrame:
    """Calls (provider, id, at, ok) with skipped, opened and failures_in_a_row.

    A call without a time or an outcome is not counted and gets nulls.
    """
    timed = calls.withColumns({"t": F.unix_micros("at"), "__ok": F.col("ok")}).withColumn(
        "ok", F.col("ok").cast("bigint")
    )
    ruled = fold(timed, "provider", ["t", "id"], breaker_rule(threshold, cooldown_seconds), rows=rows)
    return ruled.withColumn("ok", F.col("__ok")).drop("t", "__ok")


def guard_transitions(steps: DataFrame, rows: int = DEFAULT_ROWS) -> DataFrame:
    """Steps (job_id, id, at, state) with the state held before each and the verdict on it.

    A step with an unknown or missing state is refused as ``unknown state``; one without a time is
    not judged and gets nulls.
    """
    return named_verdicts(fold(with_moves(steps), "job_id", ["t", "id"], guard_rule(), rows=rows))
