"""Packing prompts into context windows, bin by bin with the least slack."""

from __future__ import annotations

import struct
from bisect import bisect_right
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from darkroom.llm.vocab import blocks, encoder
from darkroom.session import cut_lineage

PIECE = "piece int, start long, length long, ids binary, sequence_id long, offset long, part int, rank long"
PLACED = ["id", "piece", "start", "length", "ids", "sequence_id", "offset"]


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> list[int]:
    """Lengths, among those available, whose sum comes closest to ``room`` from below.

    The longest available one is always in it. Reachable sums are the bits of an integer; every
    available length shifts them, as often as there are pieces of it. ``lengths`` is ascending.
    """
    lead = lengths[bisect_right(lengths, room) - 1]
    left = room - lead
    mask, reach, steps = (1 << (left + 1)) - 1, 1, []
    for length in reversed(lengths[:bisect_right(lengths, left)]):
        for _ in range(min(counts[length] - (length == lead), left // length)):
            grown = (reach | reach << length) & mask
            if grown == reach:
                break
            steps.append((length, reach))
            reach = grown
        if reach >> left & 1:
            break
    total, picked = reach.bit_length() - 1, [lead]
    for length, before in reversed(steps):
        if not before >> total & 1:
            picked.append(length)
            total -= length
    return picked


def fill(counts: dict[int, int], room: int, accept: Callable[[int], bool]) -> list[tuple[list[int], int]]:
    """Bins as (lengths, how many bins like this), removing what they take from ``counts``.

    A combination is used as often as its pieces last. Stops at a bin whose slack is not accepted.
    """
    bins = []
    lengths = sorted(counts)
    while lengths:
        picked = fullest(counts, lengths, room)
        if not accept(room - sum(picked)):
            break
        need = {x: picked.count(x) for x in set(picked)}
        times = min(counts[x] // n for x, n in need.items())
        for x, n in need.items():
            counts[x] -= times * n
            if not counts[x]:
                del counts[x]
                lengths.remove(x)
        bins.append((picked, times))
    return bins


def pack_prompts(
    prompts: DataFrame, vocabulary_file: str, room: int = 2048, end: int = 0, id: str = "id", prompt: str = "prompt",
    window: int = 4_000,
) -> DataFrame:
    """Place every prompt's ids, end id included, in as few sequences of ``room`` ids as it can.

    Returns one row per piece: ``id, piece, start, length, ids, sequence_id, offset``; ``ids`` are
    little-endian unsigned 32-bit integers. Only longer prompts are cut, the shorter piece first.

    Minimum bin slack: a bin is the fullest combination of available lengths, found by subset-sum
    over bit sets, and is then removed. Every partition fills bins without slack from about
    ``window`` pieces at a time and carries the rest on; what no partition could place
    exactly goes into one last filling over all of them. That one needs only how many pieces
    each length has, so its plan is as small as ``room`` whatever the table.

    A null prompt is empty and has its end id only. Ids keep their type. Null and repeated ids are packed like others.
    An empty table gives no rows.
    """
    kind_of = prompts.schema[id].dataType.simpleString()
    piece = f"id {kind_of}, {PIECE}"

    def place(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        enc, part, made = encoder(vocabulary_file), TaskContext.get().partitionId(), 0
        tail = struct.pack("<I", end)
        waiting: dict[int, list] = {}
        left: dict[int, int] = {}
        held, ids_of = 0, None

        def table(out):
            return pa.RecordBatch.from_arrays([
                pa.array([x[k] for x in out], kind)
                for k, kind in enumerate((ids_of, pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))
            ], [*PLACED, "part", "rank"])

        def settle():
            nonlocal made, held
            out = []
            counts = {k: len(v) for k, v in waiting.items()}
            for picked, times in fill(counts, room, lambda slack: slack == 0):
                for _ in range(times):
                    at = 0
                    for length in picked:
                        out.append((*waiting[length].pop(), (part << 40) + made, at, part, None))
                        at += length
                    made += 1
            for k in [k for k, v in waiting.items() if not v]:
                del waiting[k]
            held -= len(out)
            for i in range(0, len(out), 1000):
                yield table(out[i:i + 1000])
            if held > window:  # lengths that hardly ever add up: leave them to the last filling
                yield from rest()

        def rest():
            nonlocal held
            out = []
            for length, pieces in waiting.items():
                first = left.get(length, 0)
                out += [(*piece, None, None, part, first + k) for k, piece in enumerate(pieces)]
                left[length] = first + len(pieces)
            waiting.clear()
            held = 0
            for i in range(0, len(out), 1000):
                yield table(out[i:i + 1000])

        for batch in batches:
            ids_of = batch.schema.field("id").type
            for docs, texts in blocks([batch], "id", "text", most=2_000_000):
                for doc, ids in zip(docs, enc.encode(texts), strict=True):
                    ids += tail
                    n = len(ids) // 4
                    cuts = [0, *range(n % room or room, n, room), n]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        waiting.setdefault(b - a, []).append((doc, k, a, b - a, ids[4 * a:4 * b]))
                        held += 1
                        if held >= window:
                            yield from settle()
        yield from settle()
        yield from rest()

    rows = prompts.select(F.col(id).alias("id"), F.col(prompt).cast("string").alias("text"))
    pieces = cut_lineage(rows.mapInArrow(place, piece))
    placed = pieces.where(F.col("sequence_id").isNotNull())
    left = pieces.where(F.col("sequence_id").isNull())
    # at most one row per length reaches the driver
    counts = {r["length"]: r["n"] for r in left.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan: dict[int, list[tuple[int, int, int]]] = {}
    used, made = dict.fromkeys(counts, 0), 0
    for picked, times in fill(counts, room, lambda slack: True):
        at = 0
        for length in picked:
            plan.setdefault(length, []).append((used[length], made, at))
            used[length] += times
            at += length
        made += times
    if not plan:
        return placed.select(*PLACED)

    def assign(batches):
        import numpy as np
        import pyarrow as pa

        tables = {k: np.array(v, dtype=np.int64) for k, v in plan.items()}
        for batch in batches:
            ranks, lengths = batch.column("rank").to_numpy(), batch.column("length").to_numpy()
            seq, off = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for length in np.unique(lengths):
                mine, t = lengths == length, tables[int(length)]
                k = np.searchsorted(t[:, 0], ranks[mine], "right") - 1
                seq[mine], off[mine] = t[k, 1] + ranks[mine] - t[k, 0], t[k, 2]
            cols = [batch.column(c) for c in ("id", "piece", "start", "length", "ids")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(-1 - seq), pa.array(off)], PLACED)

    # a piece's rank among those of its length: its rank in its task, and how many earlier tasks have
    sizes = left.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    earlier = F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")
    ranked = left.join(sizes.select("part", "length", earlier.alias("earlier")), ["part", "length"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("earlier")).drop("earlier")
    return placed.select(*PLACED).unionByName(ranked.select(*PLACED[:5], "rank").mapInArrow(assign, ", ".join(piece.split(", ")[:7])))
