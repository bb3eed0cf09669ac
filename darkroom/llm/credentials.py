"""Secrets in step details: fixed rules, and formats learned from what the rules have found."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darkroom.llm.vocab import blocks
from darkroom.session import cut_lineage

#: The base rules, in the order in which kinds are listed.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs; shorter ones would be dropped
KINDS = ("assign", "access", "hex", "learned")
#: What may be a credential of a learned format.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def base_spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of the fixed rules: leftmost and not overlapping within a kind."""
    found = [("assign", m.start(), m.end(), 0.0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [("access", m.start(), m.end(), 0.0) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [("hex", m.start(), m.end(), 0.0) for m in HEX.finditer(text)]


def shape(text: str) -> str:
    """Each character's class: x for a-f, l other small letters, d digits, U capitals, else itself."""
    return text.translate(_SHAPES)


_SHAPES = {ord(c): "x" for c in "abcdef"} | {ord(c): "l" for c in "ghijklmnopqrstuvwxyz"} | {ord(c): "d" for c in "0123456789"}
_SHAPES |= {ord(c): "U" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


@dataclass
class Automaton:
    """A probabilistic automaton over shapes: per state, log-probabilities of symbols and of the end."""

    moves: list[dict[str, tuple[int, float]]]
    ends: list[float]
    least: float = -math.inf

    def score(self, shaped: str) -> float:
        """Mean log-likelihood per symbol, the end included; minus infinity outside the language."""
        at, total = 0, 0.0
        for c in shaped:
            step = self.moves[at].get(c)
            if step is None:
                return -math.inf
            at, p = step
            total += p
        return (total + self.ends[at]) / (len(shaped) + 1)


def infer(examples: list[str], alpha: float = 0.05) -> Automaton:
    """Merge compatible states of the prefix tree of ``examples`` (shapes), red-blue order.

    Two states are compatible when, at themselves and at all pairs of states reached by the same
    symbols, the shares of ends and of each symbol differ by less than the Hoeffding bound at
    ``alpha``.
    """
    count, end, child = [0], [0], [{}]
    for text in examples:
        at = 0
        count[0] += 1
        for c in text:
            if c not in child[at]:
                child[at][c] = len(count)
                count.append(0)
                end.append(0)
                child.append({})
            at = child[at][c]
            count[at] += 1
        end[at] += 1
    used = [Counter({c: count[t] for c, t in kids.items()}) for kids in child]
    factor = math.sqrt(0.5 * math.log(2 / alpha))

    def close(f1, n1, f2, n2):
        return not n1 or not n2 or abs(f1 / n1 - f2 / n2) < factor * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def compatible(a, b):
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if not close(end[a], count[a], end[b], count[b]):
                return False
            for c in child[a].keys() | child[b].keys():
                if not close(used[a][c], count[a], used[b][c], count[b]):
                    return False
                if c in child[a] and c in child[b]:
                    todo.append((child[a][c], child[b][c]))
        return True

    def fold(a, b):
        """Add the tree below ``b`` to ``a``."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            count[a] += count[b]
            end[a] += end[b]
            for c, t in child[b].items():
                used[a][c] += used[b][c]
                if c in child[a]:
                    todo.append((child[a][c], t))
                else:
                    child[a][c] = t

    red = [0]
    blue = [(0, c) for c in sorted(child[0])]
    while blue:
        blue.sort(key=lambda e: (-count[child[e[0]][e[1]]], e))
        source, symbol = blue.pop(0)
        state = child[source][symbol]
        home = next((r for r in red if compatible(r, state)), None)
        if home is None:
            red.append(state)
        else:
            child[source][symbol] = home
            fold(home, state)
        known = set(red)
        blue = [(r, c) for r in red for c, t in sorted(child[r].items()) if t not in known]
    number = {r: k for k, r in enumerate(red)}
    moves, ends = [], []
    for r in red:
        n = end[r] + sum(used[r].values())
        moves.append({c: (number[t], math.log(used[r][c] / n)) for c, t in child[r].items() if used[r][c]})
        ends.append(math.log(end[r] / n) if end[r] else -math.inf)
    return Automaton(moves, ends)


def fit_formats(steps: DataFrame, id: str = "id", detail: str = "detail", examples: int = 600) -> list[Automaton]:
    """One automaton per fixed rule, learned from what it finds.

    At most ``examples`` different credentials per rule are used, those with the smallest hashes,
    so the fit is bounded and repeatable. A tenth of them is held out; the lowest score among
    those, less a margin, is what a candidate has to reach. A rule with fewer than 20 finds has
    no automaton.
    """
    def find(batches):
        import hashlib

        import pyarrow as pa

        for _, texts in blocks(batches, "id", "text"):
            out = set()
            for text in texts:
                for kind, a, b, _s in base_spans(text or ""):
                    value = text[a:b]
                    if kind == "assign":
                        value = ASSIGN.match(value)[2]
                    if 16 <= len(value) <= 200:
                        out.add((kind, value))
            rows = sorted(out)
            keys = [int.from_bytes(hashlib.blake2b(v.encode(), digest_size=7).digest(), "big") for _, v in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in rows], pa.string()), pa.array([v for _, v in rows], pa.string()), pa.array(keys, pa.int64())],
                ["kind", "value", "key"],
            )

    rows = steps.select(F.col(id).cast("long").alias("id"), F.col(detail).cast("string").alias("text"))
    # written once: the three samples below are then taken without reading the texts again
    found = cut_lineage(rows.mapInArrow(find, "kind string, value string, key long").distinct())
    by_kind = {k: [] for k in KINDS[:3]}
    for kind in by_kind:  # a bounded number of rows of each rule reaches the driver
        by_kind[kind] = [r["value"] for r in found.where(F.col("kind") == kind).orderBy("key", "value").limit(examples).collect()]
    out = []
    for values in by_kind.values():
        if len(values) >= 20:
            shapes = [shape(v) for v in values]
            automaton = infer([s for k, s in enumerate(shapes) if k % 10])
            held = [x for k, s in enumerate(shapes) if k % 10 == 0 and (x := automaton.score(s)) > -math.inf]
            automaton.least = (min(held) if held else 0.0) - 0.05
            out.append(automaton)
    return out


def secret_spans(
    steps: DataFrame, id: str = "id", detail: str = "detail", formats: list[Automaton] | None = None
) -> DataFrame:
    """``id, spans`` per row: every secret as (kind, start, end, score), in order of start and kind.

    Kinds are ``assign``, ``access``, ``hex`` by fixed rules, and ``learned``: stretches of
    credential characters that touch none of those, mix letters and digits, and are as likely
    under an automaton of ``formats`` (fitted here when not given) as the credentials it was
    learned from. Positions are code points, the end exclusive. Whole details are read. A null or
    empty detail has no spans; repeated rows are searched each; an empty table gives no rows.
    """
    learned = fit_formats(steps, id, detail) if formats is None else formats

    def search(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for ids, texts in blocks(batches, "id", "text"):
            out = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in all_spans(t or "", learned)] for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, kind)], ["id", "spans"])

    rows = steps.select(F.col(id).cast("long").alias("id"), F.col(detail).cast("string").alias("text"))
    return rows.mapInArrow(search, f"id long, spans {SPAN}")


def hide_secrets(
    steps: DataFrame, id: str = "id", detail: str = "detail", formats: list[Automaton] | None = None, mark: str = "[secret]"
) -> DataFrame:
    """``steps`` with every secret of ``detail`` replaced by ``mark``; all columns and rows stay.

    Overlapping spans are hidden as one. A null detail stays null, an empty one empty; repeated
    rows are treated each, details of any length whole, and an empty table gives no rows.
    """
    learned = fit_formats(steps, id, detail) if formats is None else formats

    def hide(batches):
        import pyarrow as pa

        for batch in batches:
            at = batch.schema.get_field_index(detail)
            texts = []
            for value in batch.column(at):
                text = value.as_py()
                parts, at_char = [], 0
                for a, b in _merged(all_spans(text, learned) if text else []):
                    parts += [text[at_char:a], mark]
                    at_char = b
                texts.append("".join([*parts, text[at_char:]]) if parts else text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return steps.mapInArrow(hide, steps.schema)


def _merged(spans):
    out: list[list[int]] = []
    for _, a, b, _s in spans:
        if out and a < out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def all_spans(text: str, learned: list[Automaton]) -> list[tuple[str, int, int, float]]:
    """The base spans and those of learned formats, in order of start and kind."""
    spans = base_spans(text)
    # candidates and base spans are both walked once, in order
    taken, at = _merged(sorted(spans, key=lambda s: s[1])), 0
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if at < len(taken) and taken[at][0] < b:
            continue
        shaped = shape(m[0])
        if "d" not in shaped or not set(shaped) & set("xlU"):
            continue
        best = max((s for f in learned if (s := f.score(shaped)) >= f.least), default=None)
        if best is not None:
            spans.append(("learned", a, b, best))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))
