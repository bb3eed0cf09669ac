"""Quality of evaluation prompts by gradient-boosted trees over statistics of their texts."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darkroom.llm.vocab import blocks

BLANK = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes after which the next blank ends a stretch; words and lines are compared inside stretches.
STRETCH = 1 << 20
#: Kinds of bytes that are counted.
KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789",
    "blank": b" \t\n\x0b\x0c\r", "line": b"\n", "symbol": b"#*$%&|<>", "stop": b".!?", "comma": b",;:",
    "mark": b"\"'()[]{}/\\@^_`~+=-", "inner": bytes(range(0x80, 0xC0)), "beyond": bytes(range(0xC0, 0x100)),
}
_KIND = np.array([[b in kind for kind in KINDS.values()] for b in range(256)], dtype=float)
NAMES = (
    "chars", "words", "word_size", "longest", "upper", "digit", "symbol", "stop", "comma", "mark", "beyond", "line",
    "spread", "top_byte", "distinct", "top_word", "short", "repeats", "dup_lines", "line_words",
)


def stretches(raw: bytes) -> Iterator[bytes]:
    """The text cut at a blank about every megabyte."""
    at = 0
    while len(raw) - at > STRETCH:
        cut = BLANK.search(raw, at + STRETCH)
        if cut is None:
            break
        yield raw[at:cut.end()]
        at = cut.end()
    yield raw[at:] if at else raw


def _counts(raw: bytes) -> tuple[np.ndarray, list[float]]:
    """Bytes by value, and (words, distinct, most of one word, short, three-word windows, different ones, longest, lines, different lines)."""
    bytes_seen, told = np.zeros(256, np.int64), np.zeros(9)
    for part in stretches(raw):
        bytes_seen += np.bincount(np.frombuffer(part, np.uint8), minlength=256)
        words = part.split()
        if not words:
            continue
        seen = Counter(words)
        lines = [x for x in part.split(b"\n") if x.strip()]
        longest = max(told[6], max(map(len, seen)))
        told += (
            len(words), len(seen), max(seen.values()), sum(n for w, n in seen.items() if len(w) < 4), max(len(words) - 2, 0),
            len(set(zip(words, words[1:], words[2:]))), 0, len(lines), len(set(lines)),
        )
        told[6] = longest
    return bytes_seen, told.tolist()


def text_statistics(texts: list[bytes | None]) -> np.ndarray:
    """One row of ``NAMES`` per text, read whole; a null is empty, an empty text is all zeros.

    Repeated words, windows and lines are looked for inside stretches of about a megabyte.
    """
    pairs = [_counts(t or b"") for t in texts]
    seen = np.array([b for b, _ in pairs], dtype=float).reshape(-1, 256)
    words, distinct, top, short, windows, different, longest, lines, unlike = np.array([t for _, t in pairs]).reshape(-1, 9).T
    kind = dict(zip(KINDS, (seen @ _KIND).T, strict=True))
    size = seen.sum(1)
    chars = size - kind["inner"]
    share = lambda a, b: a / np.maximum(b, 1)
    p = share(seen, size[:, None])
    spread = -(p * np.log2(np.where(p > 0, p, 1))).sum(1)
    return np.stack([
        np.log1p(chars), np.log1p(words), share(chars - kind["blank"], words), np.log1p(longest),
        share(kind["upper"], kind["upper"] + kind["lower"]), share(kind["digit"], chars), share(kind["symbol"], chars),
        share(kind["stop"], words), share(kind["comma"], words), share(kind["mark"], chars), share(kind["beyond"], chars),
        share(kind["line"], words), spread, p.max(1), share(distinct, words), share(top, words), share(short, words),
        share(windows - different, windows), share(lines - unlike, lines), share(words, lines),
    ], axis=1)


@dataclass(frozen=True)
class Trees:
    """Complete binary trees of one depth, flattened: node ``i`` goes on to ``2i+1`` or ``2i+2``."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    border: np.ndarray  # trees x inner nodes; a value above it goes right
    leaf: np.ndarray  # trees x leaves

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Chance of label 1 per row; all trees are walked together, a level at a time."""
        tree, row = np.arange(len(self.feature)), np.arange(len(x))[:, None]
        at = np.zeros((len(x), len(tree)), dtype=np.int64)
        while at.size and at[0, 0] < self.feature.shape[1]:
            at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.border[tree, at])
        raw = self.base + self.leaf[tree, at - self.feature.shape[1]].sum(1)
        return 1 / (1 + np.exp(-np.clip(raw, -50, 50)))


def fit_trees(
    x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15,
    least: float = 8.0, penalty: float = 1.0,
) -> Trees:
    """Logistic boosting on histograms: values are put into ``bins`` by quantile once, every level of
    a tree sums gradients per (node, feature, bin) and takes the split of the largest gain. A split
    leaves at least ``least`` rows on both sides; a node without one sends all rows left.
    """
    n, width = x.shape
    borders = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    bin_of = np.stack([np.searchsorted(b, x[:, f], "left") for f, b in enumerate(borders)], axis=1)
    cell = bin_of + np.arange(width) * bins
    share = np.clip((weight * y).sum() / weight.sum(), 1e-6, 1 - 1e-6)
    base = float(np.log(share / (1 - share)))
    raw, inner = np.full(n, base), (1 << depth) - 1
    feature, border = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, 1 << depth))
    for k in range(trees):
        p = 1 / (1 + np.exp(-np.clip(raw, -50, 50)))
        slope, bend = weight * (p - y), np.maximum(weight * p * (1 - p), 1e-12)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            nodes, first = 1 << level, (1 << level) - 1
            where = (((at - first) * width * bins)[:, None] + cell).ravel()
            sums = [
                np.bincount(where, np.repeat(v, width), nodes * width * bins).reshape(nodes, width, bins).cumsum(2)
                for v in (slope, bend, np.ones(n))
            ]
            (g, h, c), (gt, ht, ct) = sums, (s[:, :, -1:] for s in sums)
            gain = g * g / (h + penalty) + (gt - g) ** 2 / (ht - h + penalty) - gt * gt / (ht + penalty)
            gain = np.where((c >= least) & (ct - c >= least), gain, 0).reshape(nodes, -1)
            best = gain.argmax(1)
            for node in range(nodes):
                f, b = divmod(int(best[node]), bins)
                if gain[node, best[node]] > 0 and b < len(borders[f]):
                    feature[k, first + node], border[k, first + node] = f, borders[f][b]
            mine = at
            at = 2 * mine + 1 + (x[np.arange(n), feature[k, mine]] > border[k, mine])
        end = at - inner
        g, h = np.bincount(end, slope, 1 << depth), np.bincount(end, bend, 1 << depth)
        leaf[k] = -rate * g / (h + penalty)
        raw = raw + leaf[k][end]
    return Trees(base, feature, border, leaf)


def fit_prompt_quality(
    prompts: DataFrame, verdicts: DataFrame, id: str = "id", prompt: str = "prompt", good: str = "good", rows: int = 20_000
) -> Trees | None:
    """Fit on at most ``rows`` prompts of either verdict, those whose ids hash smallest.

    ``verdicts`` has ids and whether the prompt is good (``status = 'ok'`` of an evaluation result).
    Null verdicts are left out; an id judged both ways counts as good. Sampled rows weigh so that
    both verdicts keep their share of all ``verdicts``. None unless both verdicts occur.
    """
    named = verdicts.where(F.col(id).isNotNull() & F.col(good).isNotNull()).groupBy(F.col(id).alias("gid")).agg(
        F.max(F.col(good).cast("int")).alias("good")
    ).where("good in (0, 1)")
    totals = {r["good"]: r["n"] for r in named.groupBy("good").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(totals) < 2:
        return None
    picks = [named.where(F.col("good") == g).orderBy(F.xxhash64("gid"), "gid").limit(rows) for g in (0, 1)]
    # at most twice ``rows`` ids, so they may be broadcast
    met = prompts.select(F.col(id).alias("gid"), F.col(prompt).cast("string").cast("binary").alias("text")).join(
        F.broadcast(picks[0].unionByName(picks[1])), "gid"
    )

    def measured(batches):
        import pyarrow as pa

        for flags, texts in blocks(batches, "good", "text"):
            yield pa.RecordBatch.from_arrays(
                [pa.array(flags, pa.int32()), pa.array(text_statistics(texts).tolist(), pa.list_(pa.float64()))], ["good", "x"]
            )

    # in a fixed order, so that the same rows give the same trees
    got = sorted((r["good"], tuple(r["x"])) for r in met.select("good", "text").mapInArrow(measured, "good int, x array<double>").toLocalIterator())
    y = np.array([g for g, _ in got], dtype=float)
    if not len(y) or y.min() == y.max():
        return None
    taken = np.array([(y == 0).sum(), (y == 1).sum()])
    share = np.array([totals[0], totals[1]]) / taken
    weight = share[y.astype(int)]
    return fit_trees(np.array([x for _, x in got]), y, weight * len(y) / weight.sum())


def score_prompts(prompts: DataFrame, model: Trees | None, id: str = "id", prompt: str = "prompt") -> DataFrame:
    """``id, score`` per row: the chance that the prompt is good, from 0 to 1.

    Whole texts are read and nothing but the text is looked at. A null prompt is empty, and empty
    ones are scored like others, by statistics that are all zero. Without a model every score is
    one half. Ids keep their type and may be null or repeated; every row is scored. An empty table
    gives no rows.
    """
    kind = prompts.schema[id].dataType.simpleString()

    def scored(batches):
        import pyarrow as pa

        for batch in batches:
            ids_of = batch.schema.field("id").type
            for ids, texts in blocks([batch], "id", "text"):
                scores = np.full(len(texts), 0.5) if model is None else model.scores(text_statistics(texts))
                yield pa.RecordBatch.from_arrays([pa.array(ids, ids_of), pa.array(scores)], ["id", "score"])

    rows = prompts.select(F.col(id).alias("id"), F.col(prompt).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(scored, f"id {kind}, score double")
