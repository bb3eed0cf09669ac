"""Passages of step details that stood earlier already, found with FM-indexes over shards."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from darkroom.llm.vocab import blocks
from darkroom.llm.words import Words, mix, windows
from darkroom.session import cut_lineage

#: Words in an anchor: of a window's anchors the one with the smallest hash decides its shard.
ANCHOR = 4
#: Different segments around one anchor beyond which each window goes to a shard of its own.
CROWDED = 5_000
#: Symbols in one FM-index at most, but for a single anchor's segments.
SHARD = 400_000
NO_ID = -(1 << 63)


class WaveletMatrix:
    """Bit planes of a symbol sequence with rank directories: log2(alphabet) bits per symbol."""

    def __init__(self, symbols: np.ndarray, alphabet: int) -> None:
        self.levels = max(1, int(alphabet - 1).bit_length())
        self.planes, self.counts, self.zeros = [], [], []
        seq = symbols.astype(np.int64)
        for level in range(self.levels - 1, -1, -1):
            bit = (seq >> level & 1).astype(np.uint8)
            padded = np.zeros((len(bit) // 64 + 1) * 64, np.uint8)
            padded[:len(bit)] = bit
            plane = np.packbits(padded, bitorder="little").view(np.uint64)
            self.planes.append(plane)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(plane))[:-1]]).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each symbol occurs before ``lo`` and before ``hi``, less a common number."""
        base = np.zeros(len(symbol), np.int64)
        for k, (plane, count, zeros) in enumerate(zip(self.planes, self.counts, self.zeros, strict=True)):
            one = (symbol >> (self.levels - 1 - k) & 1).astype(bool)

            def ones(i, plane=plane, count=count):
                word = i >> 6
                return count[word] + np.bitwise_count(plane[word] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))

            a, b, c = ones(lo), ones(hi), ones(base)
            lo, hi, base = (np.where(one, zeros + x, i - x) for i, x in ((lo, a), (hi, b), (base, c)))
        return lo - base, hi - base


class FMIndex:
    """Backward search over segments that end in a mark (symbol 0), suffixes sorted to ``depth`` symbols.

    Sorting to the depth of the longest pattern is enough for backward search of such patterns.
    """

    def __init__(self, text: np.ndarray, alphabet: int, depth: int) -> None:
        n = len(text)
        rank, done = text.astype(np.int64), 1
        while done < depth:
            step = min(done, depth - done)
            ahead = np.zeros(n, np.int64)
            ahead[:n - step] = rank[step:] + 1
            both = rank * (rank.max() + 2) + ahead
            self.order = np.argsort(both, kind="stable")
            sorted_ = both[self.order]
            new = np.concatenate([[0], np.cumsum(sorted_[1:] != sorted_[:-1])])
            rank = np.empty(n, np.int64)
            rank[self.order] = new
            done += step
        if depth == 1:
            self.order = np.argsort(rank, kind="stable")
        self.bwt = WaveletMatrix(text[self.order - 1], alphabet)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet))]).astype(np.int64)

    def classes(self, text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Where in suffix order the runs of suffixes with the same first ``depth`` symbols begin, and each row's run."""
        same = np.ones(len(text) - 1, bool)
        a, b = self.order[:-1], self.order[1:]
        padded = np.concatenate([text, np.zeros(depth, text.dtype)])
        for k in range(depth):
            same &= padded[a + k] == padded[b + k]
        start = np.concatenate([[True], ~same])
        return np.append(np.flatnonzero(start), len(text)), np.cumsum(start) - 1

    def extend(self, symbol, lo, hi):
        lo, hi = self.bwt.rank(symbol, lo, hi)
        return self.before[symbol] + lo, self.before[symbol] + hi


def earlier_windows(hashes: list[np.ndarray], firsts: np.ndarray, width: int) -> list[np.ndarray]:
    """For every segment, which of its windows stand earlier in another one of the shard.

    ``hashes`` are the segments' words, ``firsts`` pairs (id, word number) of where each begins.
    All segments are streamed through the shard's index at once, from their ends to their starts:
    a step extends the match by a word to the left, and a match of ``width`` words drops its last
    word by going to the run of suffixes that share the others. So every step's interval holds
    where the window at hand occurs, and the earliest of those decides.
    """
    lengths = np.array([len(h) for h in hashes])
    names, symbol = np.unique(np.concatenate(hashes), return_inverse=True)
    ends = np.cumsum(lengths + 1)
    starts = ends - lengths - 1
    text = np.zeros(ends[-1], np.int64)
    inside = np.ones(ends[-1], bool)
    inside[ends - 1] = False
    text[inside] = symbol + 1
    index = FMIndex(text, len(names) + 1, width)
    runs, run_of = index.classes(text, width - 1)
    # where every suffix stands among all windows, by (id, word number)
    owner = np.repeat(np.arange(len(lengths)), lengths + 1)
    word = firsts[owner, 1] + np.arange(len(text)) - starts[owner]
    order = np.lexsort((word, firsts[owner, 0]))
    new = np.ones(len(order), np.int64)
    new[1:] = (firsts[owner[order[1:]], 0] != firsts[owner[order[:-1]], 0]) | (word[order[1:]] != word[order[:-1]])
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new)
    in_order = place[index.order]
    by_length = np.argsort(-lengths, kind="stable")
    lo, hi = np.zeros(len(lengths), np.int64), np.full(len(lengths), len(text), np.int64)
    found_lo, found_hi, found_at = [], [], []
    longest = lengths[by_length]
    for step in range(int(longest[0])):
        live = by_length[:np.searchsorted(-longest, -step, "left")]
        at = ends[live] - 2 - step
        if step >= width:
            run = run_of[lo[live]]
            lo[live], hi[live] = runs[run], runs[run + 1]
        lo[live], hi[live] = index.extend(text[at], lo[live], hi[live])
        if step >= width - 1:
            many = hi[live] - lo[live] > 1
            found_lo.append(lo[live][many])
            found_hi.append(hi[live][many])
            found_at.append(at[many])
    out = np.zeros(len(text), bool)
    if found_lo and sum(map(len, found_lo)):
        a, b, at = np.concatenate(found_lo), np.concatenate(found_hi), np.concatenate(found_at)
        keys, back = np.unique(a, return_inverse=True)
        stop = np.zeros(len(keys), np.int64)
        stop[back] = b
        bounds = np.stack([keys, stop], 1).ravel()
        first = np.minimum.reduceat(np.append(in_order, np.iinfo(np.int64).max), bounds)[::2]
        out[at] = first[back] < place[at]
    return [out[s:s + max(n - width + 1, 0)] for s, n in zip(starts, lengths, strict=True)]


def _segments(w: Words, width: int):
    """Runs of windows with the same anchor: arrays (first word, windows, anchor hash)."""
    total = len(w.hash)
    if total < width:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    gram = windows(w.hash, min(ANCHOR, width))
    reach = width - min(ANCHOR, width) + 1
    count = total - width + 1
    # position of the smallest anchor in every window, the leftmost on a tie, by doubling
    best, size = np.arange(len(gram)), 1
    while size < reach:
        hop = min(size, reach - size)
        a, b = best[:len(best) - hop], best[hop:]
        best, size = np.where(gram[b] < gram[a], b, a), size + hop
    best = best[:count]
    at = np.flatnonzero(w.owner[:count] == w.owner[width - 1:])
    if not len(at):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    new = np.ones(len(at), bool)
    new[1:] = (best[at[1:]] != best[at[:-1]]) | (at[1:] != at[:-1] + 1)
    first = at[new]
    return first, np.diff(np.append(np.flatnonzero(new), len(at))), gram[best[first]]


def _content(h: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A hash of the words ``first .. first + length`` for every pair."""
    out = length.astype(np.uint64)
    for k in range(int(length.max()) if len(length) else 0):
        live = k < length
        out[live] = mix(out[live] * np.uint64(0x9E3779B97F4A7C15) + h[first[live] + k])
    return out


def repeated_passages(steps: DataFrame, id: str = "id", detail: str = "detail", width: int = 20) -> DataFrame:
    """Remove from every detail the words of passages that stood earlier.

    A window is ``width`` words in a row, parted by ASCII white space. A word is removed when it
    lies in a window whose words also start earlier: in a detail of a smaller id, or earlier in
    the same one. All windows are judged on the input. Returns per row ``id, row_hash, n_words,
    n_removed, kept_text``, the kept words joined by one space.

    Windows with the same smallest anchor form a segment, and equal windows have equal anchors, so
    a shard of anchors sees all places of its windows. Segments equal word for word are settled by
    their first place. Only the different segments around one anchor go on, as words, into the
    shard's FM-index, and are streamed through it. An anchor with very many different segments is
    dealt out anew, every window by its own hash. Within a batch repeats are settled at
    once, so a passage that a third of all rows share sends one row per batch.

    Null details have no words. A null id is smaller than any other. Rows equal in id and detail
    are one text and don't make each other repeats; rows of one id but different details are
    ordered by word number. An empty table gives no rows.
    """
    rows = steps.select(
        F.coalesce(F.col(id).cast("long"), F.lit(NO_ID)).alias("tid"), F.xxhash64(F.col(detail).cast("string")).alias("row_hash"),
        F.col(id).cast("long").alias("id"), F.col(detail).cast("string").alias("text"),
    )
    row = "key long, lead boolean, content long, tid long, row_hash long, start int, n int"

    def cut(batches):
        import pyarrow as pa

        for ids, hashes, texts in blocks(batches, "tid", "row_hash", "text", most=2_000_000):
            w = Words(texts)
            first, n, anchor = _segments(w, width)
            owner = w.owner[first]
            ids, hashes = np.array(ids, np.int64), np.array(hashes, np.int64)
            begin = np.concatenate([[0], np.cumsum(w.count)[:-1]]).astype(np.int64)
            start = (first - begin[owner]).astype(np.int32) if len(first) else np.zeros(0, np.int32)
            content = _content(w.hash, first, n + width - 1).view(np.int64)
            # the first of equal segments in this batch leads; the others are repeats of it
            order = np.lexsort((start, ids[owner], content, anchor))
            lead = np.ones(len(order), bool)
            same = (content[order[1:]] == content[order[:-1]]) & (anchor[order[1:]] == anchor[order[:-1]])
            head = order[np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(len(order)), 0))] if len(order) else order
            tie = (ids[owner[order]] == ids[owner[head]]) & (start[order] == start[head])
            lead[order] = np.concatenate([[True], ~same]) | tie if len(order) else True
            key = np.where(lead, anchor.view(np.int64), mix(content.view(np.uint64) + first.astype(np.uint64)).view(np.int64))
            yield pa.RecordBatch.from_arrays([
                pa.array(key), pa.array(lead), pa.array(content), pa.array(ids[owner]), pa.array(hashes[owner]), pa.array(start), pa.array(n.astype(np.int32)),
            ], ["key", "lead", "content", "tid", "row_hash", "start", "n"])

    segments = rows.select("tid", "row_hash", "text").mapInArrow(cut, row)
    anchor, same = W.partitionBy("key", "lead"), W.partitionBy("key", "lead", "content")
    placed = segments.repartition("key").select(
        "*", F.rank().over(same.orderBy("tid", "start")).alias("nth"),
        (F.min("content").over(anchor) != F.max("content").over(anchor)).alias("varied"),
    )
    again = ~F.col("lead") | (F.col("nth") > 1)
    judged = cut_lineage(
        placed.where(again | F.col("varied")).select("key", "tid", "row_hash", "start", "n", again.alias("again"))
    )
    crowd = judged.where(~F.col("again")).groupBy("key").agg(F.count(F.lit(1)).alias("crowd")).where(F.col("crowd") > CROWDED)
    asked = judged.where(~F.col("again")).join(crowd, "key", "left").groupBy("tid", "row_hash").agg(
        F.collect_list(F.struct("key", "start", "n", F.col("crowd").isNotNull().alias("crowded"))).alias("asked")
    )
    texts = rows.select("tid", "row_hash", "text").repartition("tid")

    def words(batches):
        import pyarrow as pa

        for ids, hashes, asked_, found in blocks(batches, "tid", "row_hash", "asked", "text", most=2_000_000):
            w = Words(found)
            begin = np.concatenate([[0], np.cumsum(w.count)[:-1]]).astype(np.int64)
            out, seen = [], {}
            for i, wants in enumerate(asked_):
                for a in sorted(wants, key=lambda x: x["start"]):
                    at = begin[i] + a["start"]
                    if not a["crowded"]:
                        body = w.hash[at:at + a["n"] + width - 1]
                        out.append((a["key"], ids[i], hashes[i], a["start"], False, body.tobytes()))
                        continue
                    for k in range(a["n"]):
                        body = w.hash[at + k:at + k + width].tobytes()
                        key = int(windows(np.frombuffer(body, np.uint64), width).view(np.int64)[0])
                        seen.setdefault((key, body), []).append((ids[i], a["start"] + k, hashes[i]))
            for (key, body), places in seen.items():
                places.sort()
                for p in places:
                    again = p[:2] != places[0][:2]
                    out.append((hash(p) if again else key, p[0], p[2], p[1], again, b"" if again else body))
            yield pa.RecordBatch.from_arrays([
                pa.array([x[k] for x in out], kind)
                for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()))
            ], ["key", "tid", "row_hash", "start", "again", "body"])

    shards = texts.join(asked.hint("shuffle_hash"), ["tid", "row_hash"]).select("tid", "row_hash", "asked", "text").mapInArrow(
        words, "key long, tid long, row_hash long, start int, again boolean, body binary"
    ).repartition("key").sortWithinPartitions("key", "tid", "start")

    def match(batches):
        import pyarrow as pa

        def table(out):
            return pa.RecordBatch.from_arrays([
                pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))
            ], ["tid", "row_hash", "start", "n"])

        def search(held):
            out = []
            marks = earlier_windows([np.frombuffer(h[4], np.uint64) for h in held], np.array([(h[1], h[3]) for h in held], np.int64), width)
            for (_, tid, row_hash, start, _b), hit in zip(held, marks, strict=True):
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
                out += [(tid, row_hash, start + int(a), int(b - a)) for a, b in zip(edge[::2], edge[1::2], strict=True)]
            return out

        held, symbols, out, last = [], 0, [], None
        for batch in batches:
            for chunk in range(0, batch.num_rows, 5000):
                for r in batch.slice(chunk, 5000).to_pylist():
                    if r["again"]:
                        out.append((r["tid"], r["row_hash"], r["start"], 1))
                        continue
                    if symbols >= SHARD and r["key"] != last:
                        out += search(held)
                        held, symbols = [], 0
                    elif symbols >= 4 * SHARD and len(r["body"]) == 8 * width:
                        # one window in very many places: its earliest place stands for all before
                        out += search(held)
                        held = [next(h for h in held if h[0] == last)]
                        symbols = width
                    last = r["key"]
                    held.append((r["key"], r["tid"], r["row_hash"], r["start"], r["body"]))
                    symbols += len(r["body"]) // 8 + 1
            if len(out) >= 10_000:
                yield table(out)
                out = []
        if held:
            out += search(held)
        if out:
            yield table(out)

    found = shards.mapInArrow(match, "tid long, row_hash long, start int, n int")
    removed = judged.where("again").select("tid", "row_hash", "start", "n").unionByName(found).groupBy("tid", "row_hash").agg(
        F.collect_list(F.struct("start", "n")).alias("gone")
    )

    def keep(batches):
        import pyarrow as pa

        for ids, hashes, gone, found in blocks(batches, "id", "row_hash", "gone", "text", most=2_000_000):
            n_words, n_removed, kept = [], [], []
            for text, spans in zip(found, gone, strict=True):
                parts = (text or "").encode().split()
                n_words.append(len(parts))
                if spans:
                    out = np.zeros(len(parts) + 1, np.int64)
                    for s in spans:
                        out[s["start"]] += 1
                        out[s["start"] + s["n"] + width - 1] -= 1
                    stays = np.flatnonzero(np.cumsum(out)[:-1] == 0)
                    n_removed.append(len(parts) - len(stays))
                    parts = [parts[i] for i in stays.tolist()]
                else:
                    n_removed.append(0)
                kept.append(b" ".join(parts).decode())
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()),
            ], ["id", "row_hash", "n_words", "n_removed", "kept_text"])

    joined = texts.join(removed.hint("shuffle_hash"), ["tid", "row_hash"], "left").select(
        F.when(F.col("tid") != NO_ID, F.col("tid")).alias("id"), "row_hash", "gone", "text"
    )
    return joined.mapInArrow(keep, "id long, row_hash long, n_words long, n_removed long, kept_text string")
