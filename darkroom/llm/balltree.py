"""Ranked search of job steps: the best steps for every phrase, found in ball trees over sparse vectors.

A step is a vector of term impacts, a phrase one of term weights, its score their inner product.
Steps are dealt into bounded shards with a tree each. A node keeps the centroid of its vectors and
a radius in each of several disjoint groups of terms, so no vector below it can score more than
the centroid's product plus the phrase's length times the radius, added over the groups. Nodes
are visited best bound first until none can reach the phrase's worst kept score.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from darkroom.llm.boosting import stretches
from darkroom.llm.vocab import blocks
from darkroom.operators.ranks import ordinal_rank
from darkroom.session import cut_lineage

#: Letters of either case, digits and everything beyond ASCII make terms; all else parts them.
_PLAIN = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
LEAF = 64
SHARD = 8192
#: Numbers in a shard's centroids: a wider vocabulary gets smaller shards.
CENTROIDS = 1 << 22
#: Term groups with a radius of their own.
GROUPS = 4096


def terms_of(raw: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text with repeats, in lists of about a megabyte of text."""
    for part in stretches((raw or b"").translate(_PLAIN)):
        yield part.split()


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, total: int, length: int) -> np.ndarray:
    """What each term of a text adds to a score per unit of weight; all in 64-bit integers."""
    m = 50 + (50 * n * total) // length
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


@dataclass
class Asked:
    """A phrase as sparse integer weights, with its length in each term group."""

    number: int
    terms: np.ndarray
    weights: np.ndarray
    width: int
    groups: np.ndarray = field(init=False)
    lengths: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        squares = np.bincount(self.terms % min(self.width, GROUPS), self.weights.astype(float) ** 2)
        self.groups = np.flatnonzero(squares)
        self.lengths = np.sqrt(squares[self.groups]) * (1 + 1e-12)


class BallTree:
    """One shard's tree over sparse rows: ``starts`` (rows + 1), ``cols`` and integer ``vals``.

    All leaves lie on one level. Nodes are numbered from the root, children of ``i`` at ``2i+1`` and
    ``2i+2``; a node's rows are neighbours. No row may be empty.
    """

    def __init__(self, starts: np.ndarray, cols: np.ndarray, vals: np.ndarray, width: int) -> None:
        n = len(starts) - 1
        self.width, self.groups = width, min(width, GROUPS)
        self.group = np.arange(width) % self.groups
        self.order, self.starts = np.arange(n), starts
        sorted_rows = np.lexsort((self.group[cols], self._per_entry(self.order)))
        self.cols, self.vals = cols[sorted_rows], vals[sorted_rows]
        edges = np.array([0, n])
        centres, radii, ranges = [], [], []
        while True:
            centre = self._centres(edges)
            centres.append(centre)
            radii.append(self._radii(edges, centre))
            ranges.append(np.stack([edges[:-1], edges[1:]], axis=1))
            if np.diff(edges).max() <= LEAF or np.diff(edges).min() < 2:
                break
            edges = self._split(edges, centre)
        self.inner = sum(len(r) for r in ranges[:-1])
        self.ranges = np.concatenate(ranges)
        self.centres = np.concatenate(centres).T.copy()  # terms x nodes
        self.radii = np.concatenate(radii).T.copy()  # groups x nodes

    def _node_of(self, edges: np.ndarray) -> np.ndarray:
        return np.repeat(np.arange(len(edges) - 1), np.diff(edges))

    def _per_entry(self, rows: np.ndarray) -> np.ndarray:
        return np.repeat(rows, np.diff(self.starts))

    def _centres(self, edges: np.ndarray) -> np.ndarray:
        nodes = len(edges) - 1
        at = self._per_entry(self._node_of(edges)) * self.width + self.cols
        sums = np.bincount(at, self.vals, nodes * self.width).reshape(nodes, self.width)
        return sums / np.diff(edges)[:, None]

    def _radii(self, edges: np.ndarray, centre: np.ndarray) -> np.ndarray:
        """Per node and term group no less than the largest distance of a row from the centroid."""
        nodes = len(edges) - 1
        own = np.stack([np.bincount(self.group, c * c, self.groups) for c in centre])
        here, group = self._per_entry(self._node_of(edges)), self.group[self.cols]
        row = self._per_entry(np.arange(len(self.starts) - 1))
        x, c = self.vals.astype(float), centre[here, self.cols]
        runs = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (group[1:] != group[:-1])))
        apart, size = np.add.reduceat(x * x - 2 * x * c, runs), np.add.reduceat(x * x, runs)
        # a row without a term of the group lies as far off as the centroid is long
        most, largest = np.zeros(nodes * self.groups), np.zeros(nodes * self.groups)
        cell = here[runs] * self.groups + group[runs]
        np.maximum.at(most, cell, apart)
        np.maximum.at(largest, cell, size)
        most, largest = most.reshape(nodes, -1), largest.reshape(nodes, -1)
        # squares cancel here: what rounding may have lost is added before the root
        return np.sqrt(np.maximum(most + own, 0) + 1e-11 * (largest + own)) * (1 + 1e-12)

    def _split(self, edges: np.ndarray, centre: np.ndarray) -> np.ndarray:
        """Halve every node between the row farthest from its centroid and the row farthest from that."""
        node = self._node_of(edges)
        here, x = self._per_entry(node), self.vals.astype(float)
        norms = np.add.reduceat(x * x, self.starts[:-1])

        def distance(points: np.ndarray) -> np.ndarray:
            dots = np.add.reduceat(x * points[here, self.cols], self.starts[:-1])
            return norms - 2 * dots + (points * points).sum(1)[node]

        def farthest(d: np.ndarray) -> np.ndarray:
            rows = np.array([a + int(d[a:b].argmax()) for a, b in zip(edges[:-1], edges[1:], strict=True)])
            points = np.zeros((len(rows), self.width))
            for i, r in enumerate(rows):
                points[i, self.cols[self.starts[r]:self.starts[r + 1]]] = self.vals[self.starts[r]:self.starts[r + 1]]
            return points

        one = farthest(distance(centre))
        from_one = distance(one)
        lean = from_one - distance(farthest(from_one))
        self._reorder(np.lexsort((lean, node)))
        middle = (edges[:-1] + edges[1:]) // 2
        return np.insert(edges, np.arange(1, len(edges)), middle)

    def _reorder(self, rows: np.ndarray) -> None:
        sizes = np.diff(self.starts)[rows]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        take = np.repeat(self.starts[rows] - starts[:-1], sizes) + np.arange(starts[-1])
        self.order, self.starts, self.cols, self.vals = self.order[rows], starts, self.cols[take], self.vals[take]

    def bounds(self, asked: Asked) -> np.ndarray:
        """For every node a whole number that no row below it scores above."""
        middle = asked.weights.astype(float) @ self.centres[asked.terms]
        reach = asked.lengths @ self.radii[asked.groups]
        raw = np.floor((middle + reach) * (1 + 1e-9) + 1)
        for i in range(1, len(raw)):
            raw[i] = min(raw[i], raw[(i - 1) // 2])
        return raw

    def search(self, asked: Asked, dense: np.ndarray, kept: Best) -> int:
        """Offer every row that may still be among the best; returns how many rows were scored."""
        bounds, scored = self.bounds(asked), 0
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < max(kept.floor, 1):  # equal scores may still win by their id
                break
            if node < self.inner:
                for child in (2 * node + 1, 2 * node + 2):
                    heapq.heappush(heap, (-bounds[child], child))
                continue
            low, high = self.ranges[node]
            a, b = self.starts[low], self.starts[high]
            scores = np.add.reduceat(dense[self.cols[a:b]] * self.vals[a:b], self.starts[low:high] - a)
            scored += high - low
            hits = np.flatnonzero(scores >= max(kept.floor, 1))
            if len(hits):
                kept.offer([(int(scores[i]), self.order[low + i]) for i in hits])
        return scored


class Best:
    """The ``k`` best rows of a phrase: highest score, then smallest id, nulls first."""

    def __init__(self, k: int) -> None:
        self.k, self.rows, self.floor = k, [], 0
        self.ids: Sequence = ()

    def offer(self, rows: list[tuple[int, int]]) -> None:
        self.rows += [(score, self.ids[i]) for score, i in rows]
        if len(self.rows) > self.k:
            self.rows.sort(key=lambda r: (-r[0], r[1] is not None, 0 if r[1] is None else r[1]))
            del self.rows[self.k:]
        if len(self.rows) == self.k:
            self.floor = min(score for score, _ in self.rows)


def _counted(steps: DataFrame, number: dict[bytes, int], kind: str) -> DataFrame:
    """(id, n, terms, counts) of steps with a term: all its terms counted, those in ``number`` named."""
    def count(batches):
        import pyarrow as pa

        for batch in batches:
            ids_of = batch.schema.field("id").type
            for ids, texts in blocks([batch], "id", "text"):
                kept, sizes, names, counts = [], [], [], []
                for i, raw in zip(ids, texts, strict=True):
                    n, seen = 0, Counter()
                    for words in terms_of(raw):
                        n += len(words)
                        seen.update(filter(number.__contains__, words))
                    if n:
                        kept.append(i)
                        sizes.append(n)
                        names.append([number[w] for w in seen])
                        counts.append(list(seen.values()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kept, ids_of), pa.array(sizes, pa.int64()), pa.array(names, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))],
                    ["id", "n", "terms", "counts"],
                )

    return steps.mapInArrow(count, f"id {kind}, n long, terms array<int>, counts array<long>")


def _found(
    counted: DataFrame, asked: list[Asked], place: np.ndarray, total: int, length: int, best: int, kind: str
) -> DataFrame:
    """(asked, id, score): the best of every task for each phrase; term ``t`` has the column ``place[t]``."""
    width = len(place)
    most = max(LEAF, min(SHARD, LEAF * (CENTROIDS // (2 * width))))

    def shards(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, most):
                yield batch.slice(low, most)

    def search(batches):
        import pyarrow as pa

        kept = {a.number: Best(best) for a in asked}
        dense = np.zeros(width, np.int64)
        held, rows, ids_of = [], 0, None

        def look() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            listed = table.column("terms").combine_chunks()
            sizes = np.diff(listed.offsets.to_numpy())
            cols = place[listed.flatten().to_numpy()]
            tf = table.column("counts").combine_chunks().flatten().to_numpy()
            vals = impacts(tf, np.repeat(table.column("n").to_numpy(), sizes), total, length)
            tree = BallTree(np.concatenate([[0], np.cumsum(sizes)]), cols, vals, width)
            ids = table.column("id").to_pylist()
            for a in asked:
                dense[a.terms] = a.weights
                kept[a.number].ids = ids
                tree.search(a, dense, kept[a.number])
                dense[a.terms] = 0

        for part in shards(batches):
            ids_of = part.schema.field("id").type
            if rows and rows + part.num_rows > most:
                look()
                held, rows = [], 0
            held.append(part)
            rows += part.num_rows
        if rows:
            look()
            out = [(a, i, s) for a, b in kept.items() for s, i in b.rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array([a for a, _, _ in out], pa.int64()), pa.array([i for _, i, _ in out], ids_of), pa.array([s for _, _, s in out], pa.int64())],
                ["asked", "id", "score"],
            )

    return counted.where(F.size("terms") > 0).mapInArrow(search, f"asked long, id {kind}, score long")


def search_steps(
    steps: DataFrame, phrases: DataFrame, id: str = "id", detail: str = "detail", phrase_id: str = "id", phrase: str = "phrase",
    best: int = 50, together: int = 256,
) -> DataFrame:
    """The ``best`` job steps for every grounding phrase: ``phrase_id, rank, step_id, score``.

    Terms are runs of ASCII letters, digits and characters beyond ASCII, A-Z in lower case. A term
    weighs by its rarity among steps with a term; what it adds grows with its count in the step
    and falls with the step's length. Scores are whole numbers, the same in any order of rows.
    Steps scoring above 0 are ranked from 1, equal scores by ascending id, nulls first.

    Null and empty details hold no term and are never found; a null or empty phrase finds nothing.
    Repeated rows are found, and asked, each on its own. Details of any length are read whole.
    Ids keep their type. Empty tables give no rows. Phrases are answered ``together`` at a time,
    one scan of the steps for each such block; only a block's terms reach the driver.
    """
    kind, asked_kind = steps.schema[id].dataType.simpleString(), phrases.schema[phrase_id].dataType.simpleString()
    rows = steps.select(F.col(id).alias("id"), F.col(detail).cast("string").cast("binary").alias("text"))
    named = phrases.select(F.col(phrase_id).alias("phrase_id"), F.col(phrase).cast("string").cast("binary").alias("text"))
    numbered = cut_lineage(ordinal_rank(named.withColumn("row", F.monotonically_increasing_id()), ["phrase_id", "row"], "asked"))

    def distinct(batches):
        import pyarrow as pa

        for numbers, texts in blocks(batches, "asked", "text"):
            terms = [sorted({w for words in terms_of(t) for w in words}) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers, pa.int64()), pa.array(terms, pa.list_(pa.binary()))], ["asked", "terms"]
            )

    out = None
    for low in range(0, numbered.count(), together):
        block = numbered.where((F.col("asked") >= low) & (F.col("asked") < low + together))
        wanted = [(r["asked"], [bytes(t) for t in r["terms"]]) for r in
                  block.select("asked", "text").mapInArrow(distinct, "asked long, terms array<binary>").collect()]
        names = sorted({t for _, terms in wanted for t in terms})
        if not names:
            continue
        number = {t: i for i, t in enumerate(names)}
        counted = cut_lineage(_counted(rows, number, kind))
        n, length = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        held = counted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
        df = {r["t"]: r["df"] for r in held.collect()}  # at most one row per term of the block
        # frequent terms get the low numbers, each in a group of its own as far as groups go
        place = np.empty(len(names), np.int64)
        place[sorted(range(len(names)), key=lambda i: (-df.get(i, 0), i))] = np.arange(len(names))
        asked = []
        for a, terms in wanted:
            mine = [number[t] for t in terms if number[t] in df]
            if mine:
                asked.append(Asked(a, place[mine], np.array([weight(n, df[i]) for i in mine], np.int64), len(names)))
        found = _found(counted, asked, place, n, length, best, kind)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return steps.sparkSession.createDataFrame([], f"phrase_id {asked_kind}, rank int, step_id {kind}, score long")
    order = Window.partitionBy("asked").orderBy(F.col("score").desc(), F.col("id").asc_nulls_first())
    top = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return top.join(numbered.select("asked", "phrase_id"), "asked").select("phrase_id", "rank", F.col("id").alias("step_id"), "score")
