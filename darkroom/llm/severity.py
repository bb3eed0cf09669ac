"""Severity of what an instruction says, by an ordinal regression on sparse text features."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from darkroom.llm.vocab import blocks
from darkroom.session import cut_lineage

WORD = re.compile(r"[^\W\d_]+")
STEMS = (4, 6)
REMEMBERED = 300_000


def features(word: str) -> list[str]:
    """A word and its openings; a word with endings shares the opening of the plain one."""
    return [word, *(f"{word[:n]}~" for n in STEMS if len(word) > n)]


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


@dataclass
class OrdinalModel:
    """One weight per feature, shared by all grades, and ascending cut points between grades."""

    weights: dict[str, float]
    cuts: list[float]

    def strength(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features(word))

    def grades(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for every score and cut, k from 1."""
        return 1 / (1 + np.exp(np.clip(np.array(self.cuts)[None, :] - scores[:, None], -50, 50)))


def _telling(p1: float, p0: float, n1: int, n0: int) -> bool:
    """Whether a feature is at least four times as frequent above grade 0, and not by chance."""
    p = (p1 * n1 + p0 * n0) / (n1 + n0)
    return p1 >= 4 * p0 and p1 - p0 >= 4 * (p * (1 - p) * (1 / n1 + 1 / n0)) ** 0.5


def fit_ordinal(
    texts: list[dict[str, int]], grades: np.ndarray, names: list[str], penalty: float = 1e-4, steps: int = 400, rate: float = 0.2,
    lean: float = 0.5,
) -> OrdinalModel:
    """Cumulative logits with a penalty on absolute weights, by proximal Adagrad.

    A text is given by how many of its different words have each of the features ``names``. Grades are
    0, 1, 2, ...; those above 0 weigh ``lean`` in all.
    """
    number = {f: i for i, f in enumerate(names)}
    rows = [{number[f]: n for f, n in t.items() if f in number} for t in texts]
    col = np.fromiter((i for r in rows for i in r), np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    val = np.fromiter((np.sqrt(v) for r in rows for v in r.values()), float)
    top = int(grades.max())
    above0 = max(int((grades > 0).sum()), 1)
    weight = np.where(grades > 0, lean / above0, (1 - lean) / max(len(grades) - above0, 1))
    w, cuts = np.zeros(len(names)), np.linspace(-0.5, 0.5, top) if top > 1 else np.zeros(top)
    gw, gc = np.full(len(names), 1e-8), np.full(top, 1e-8)
    for _ in range(steps):
        score = np.bincount(row, w[col] * val, len(rows))
        above = 1 / (1 + np.exp(np.clip(cuts[None, :] - score[:, None], -50, 50)))
        prob = np.clip(-np.diff(np.concatenate([np.ones((len(rows), 1)), above, np.zeros((len(rows), 1))], 1), axis=1), 1e-9, 1)
        slope = above * (1 - above)
        mine = np.arange(len(rows))
        padded = np.concatenate([np.zeros((len(rows), 1)), slope, np.zeros((len(rows), 1))], 1)
        up, down = padded[mine, grades], padded[mine, grades + 1]
        p = prob[mine, grades]
        dscore = -weight * (up - down) / p
        dw = np.bincount(col, dscore[row] * val, len(names))
        dcut = np.zeros(top)
        np.add.at(dcut, np.clip(grades - 1, 0, None), np.where(grades > 0, weight * up / p, 0))
        np.add.at(dcut, np.clip(grades, None, top - 1), np.where(grades < top, -weight * down / p, 0))
        gw += dw * dw
        gc += dcut * dcut
        pace = rate / np.sqrt(gw)
        w -= pace * dw
        w = np.sign(w) * np.maximum(np.abs(w) - pace * penalty, 0)
        cuts = np.sort(cuts - rate / np.sqrt(gc) * dcut)
    return OrdinalModel({n: float(x) for n, x in zip(names, w, strict=True) if x}, [float(c) for c in cuts])


def fit_severity(
    instructions: DataFrame, grades: DataFrame, id: str = "id", instruction: str = "instruction", grade: str = "grade",
    rows: int = 4000, least: int = 4,
) -> OrdinalModel | None:
    """Fit on at most ``rows`` labelled rows of every grade, those whose ids hash smallest.

    ``grades`` has ids and grades, integers from 0. With only two of them, the upper one is parted
    at the median number of words that occur in the upper grade alone, so that there are a mild
    and a severe grade. Features of fewer than ``least`` texts above grade 0, and those not clearly more
    frequent there, are left out. None without both a grade 0 and a higher one.

    The texts are read once. Features are counted by Spark; only telling ones, and how often each
    sampled text has them, reach the driver, however long the texts are.
    """
    named = grades.where(F.col(grade) >= 0).select(F.col(id).alias("gid"), F.col(grade).cast("int").alias("grade")).distinct()
    levels = [r["grade"] for r in named.select("grade").distinct().collect()]
    if not levels or min(levels) > 0 or max(levels) == 0:
        return None
    order = Window.partitionBy("grade").orderBy(F.xxhash64("gid"), "gid")
    picked = named.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= rows).select("gid", "grade")
    # at most ``rows`` ids for each grade, so they may be broadcast
    texts = instructions.select(F.col(id).alias("gid"), F.col(instruction).cast("string").alias("text")).join(F.broadcast(picked), "gid")

    def told(batches):
        import pyarrow as pa

        for graded, found in blocks(batches, "grade", "text"):
            yield pa.RecordBatch.from_arrays(
                [pa.array(graded, pa.int32()), pa.array([sorted(words_of(t)) for t in found], pa.list_(pa.string()))], ["grade", "words"]
            )

    sample = cut_lineage(texts.select("grade", "text").mapInArrow(told, "grade int, words array<string>").withColumn(
        "line", F.monotonically_increasing_id()
    ))
    sizes = {r["bad"]: r["n"] for r in sample.groupBy((F.col("grade") > 0).alias("bad")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sizes.get(True, 0), sizes.get(False, 0)
    if not n1 or not n0:
        return None
    openings = [F.when(F.length("word") > n, F.concat(F.substring("word", 1, n), F.lit("~"))) for n in STEMS]
    each = sample.select("line", "grade", F.explode("words").alias("word")).select(
        "line", "grade", "word", F.explode(F.array_compact(F.array(F.col("word"), *openings))).alias("f")
    )
    per_text = each.groupBy("line", "grade", "f").agg(F.count(F.lit(1)).alias("n"))
    counts = per_text.groupBy("f").agg(F.count_if(F.col("grade") > 0).alias("bad"), F.count_if(F.col("grade") == 0).alias("good")).where(
        F.col("bad") >= least
    )
    seen = {r["f"]: (r["bad"], r["good"]) for r in counts.where(F.col("bad") * n0 >= F.col("good") * n1 * 4).collect()}
    names = sorted(f for f, (bad, good) in seen.items() if _telling(bad / n1, good / n0, n1, n0))
    marks = {f for f, (bad, good) in seen.items() if not good}

    def counted(batches):
        import pyarrow as pa

        wanted = set(names)
        for batch in batches:
            rows_ = batch.to_pylist()
            hits = [Counter(f for w in r["words"] for f in features(w) if f in wanted) for r in rows_]
            marked = [sum(any(f in marks for f in features(w)) for w in r["words"]) for r in rows_]
            yield pa.RecordBatch.from_arrays([
                batch.column("line"), batch.column("grade"), pa.array([list(h) for h in hits], pa.list_(pa.string())),
                pa.array([list(h.values()) for h in hits], pa.list_(pa.int64())), pa.array(marked, pa.int64()),
            ], ["line", "grade", "f", "n", "marked"])

    found = sorted(
        (r["grade"], sorted(zip(r["f"], r["n"], strict=True)), r["marked"])
        for r in sample.select("line", "grade", "words").mapInArrow(counted, "line long, grade int, f array<string>, n array<long>, marked long").toLocalIterator()
    )
    given = np.array([g for g, _, _ in found], dtype=np.int64)
    if given.max() == 1:  # flags: those of more than the median number of telling words are severe
        marked = np.array([m for _, _, m in found])
        given = np.where((given == 1) & (marked > np.median(marked[given == 1])), 2, given)
    return fit_ordinal([dict(t) for _, t, _ in found], given, names)


def severity(
    instructions: DataFrame, model: OrdinalModel | None, id: str = "id", instruction: str = "instruction"
) -> DataFrame:
    """``id, row_hash, severity, likely, harmful`` per row.

    ``severity`` is the expected grade, ``likely`` the chance of a grade above 0, and ``harmful``
    whether that is at least one half. Whole texts are read. A null or empty text, and any text
    without a model, has severity 0 or what its grade-0 share says and is not harmful. Repeated
    rows are scored each; ``row_hash`` is the hash of the text, to join rows whose ids repeat.
    """
    def score(batches):
        import pyarrow as pa

        known: dict[str, float] = {}
        for ids, hashes, texts in blocks(batches, "id", "row_hash", "text"):
            if len(known) > REMEMBERED:
                known = {}
            scores = np.zeros(len(texts))
            empty = np.zeros(len(texts), dtype=bool)
            if model is not None:
                for i, text in enumerate(texts):
                    words = words_of(text)
                    empty[i] = not words
                    # root counts per feature, as in the fit; only features with a weight matter
                    hits: Counter = Counter()
                    for w in words:
                        mine = known.get(w)
                        if mine is None:
                            mine = known[w] = tuple(f for f in features(w) if f in model.weights)
                        for f in mine:
                            hits[f] += 1
                    scores[i] = sum(model.weights[f] * n ** 0.5 for f, n in hits.items())
                above = model.grades(scores)
                likely = np.where(empty, 0.0, above[:, 0])
                expected = np.where(empty, 0.0, above.sum(1))
            else:
                likely = expected = scores
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(expected), pa.array(likely), pa.array(likely >= 0.5)],
                ["id", "row_hash", "severity", "likely", "harmful"],
            )

    rows = instructions.select(
        F.col(id).cast("long").alias("id"), F.xxhash64(F.col(instruction)).alias("row_hash"), F.col(instruction).cast("string").alias("text")
    )
    return rows.mapInArrow(score, "id long, row_hash long, severity double, likely double, harmful boolean")
