"""Token ids of prompts in grammar-compressed files that can be read at any place."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from darkroom.llm.vocab import blocks, encoder

MAGIC = b"DRG2"
FILE = "part int, before long, docs long, ids long, body binary"


def compress(ids: np.ndarray, ends: np.ndarray, vocabulary: int, rounds: int = 4, batch: int = 1024, least: int = 16):
    """Re-Pair in batches: (symbols, symbols per document, rules, expansion lengths).

    ``ends`` holds where each document ends in ``ids``. A round counts all neighbouring pairs
    inside documents and replaces the ``batch`` most frequent ones, left to right and never
    overlapping, each by a new symbol. Rounds end early when no pair occurs ``least`` times.
    """
    seq, ends = ids.astype(np.uint32), np.asarray(ends, dtype=np.int64)
    rules, sizes = np.zeros((0, 2), dtype=np.int64), np.ones(vocabulary, dtype=np.int64)
    for _ in range(rounds):
        if len(seq) < 2:
            break
        top = vocabulary + len(rules)
        wide = np.uint32 if top < 1 << 16 else np.uint64
        pair = seq[:-1].astype(wide) * wide(top) + seq[1:]
        inside = np.ones(len(pair), bool)
        inside[ends[(ends > 0) & (ends < len(seq))] - 1] = False
        ordered = np.sort(pair[inside])
        new = np.ones(len(ordered), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        starts = np.flatnonzero(new)
        count = np.diff(starts, append=len(ordered))
        starts, count = starts[count >= least], count[count >= least]
        if not len(starts):
            break
        names = ordered[starts].astype(np.int64)
        chosen = np.sort(names[np.lexsort((names, -count))][:batch])
        new = np.stack([chosen // top, chosen % top], axis=1)
        # few symbols begin or end a chosen pair; they number the rows and columns of a small table of pairs
        (firsts, row), (seconds, column) = (np.unique(x, return_inverse=True) for x in new.T)
        rows, columns = np.zeros(top, np.int32), np.zeros(top, np.int32)
        rows[firsts], columns[seconds] = np.arange(1, len(firsts) + 1), np.arange(1, len(seconds) + 1)
        named = np.full((len(firsts) + 1, len(seconds) + 1), -1, np.int32)
        named[row + 1, column + 1] = np.arange(len(new))
        begin = rows[seq[:-1]]
        hit = np.flatnonzero((begin > 0) & inside)
        place = named[begin[hit], columns[seq[hit + 1]]]
        fits = place >= 0
        hit, place = hit[fits], place[fits]
        run = np.maximum.accumulate(np.where(np.diff(hit, prepend=-2) != 1, np.arange(len(hit)), 0))
        free = (np.arange(len(hit)) - run) % 2 == 0
        hit, place = hit[free], place[free]
        seq[hit] = top + place
        keep = np.ones(len(seq), dtype=bool)
        keep[hit + 1] = False
        seq, ends = seq[keep], ends - np.searchsorted(hit + 1, ends)
        rules, sizes = np.concatenate([rules, new]), np.concatenate([sizes, sizes[new[:, 0]] + sizes[new[:, 1]]])
    return seq, np.diff(ends, prepend=0), rules, sizes[vocabulary:]


def expand(symbols: np.ndarray, rules: np.ndarray, vocabulary: int) -> np.ndarray:
    """The ids behind ``symbols``."""
    seq = symbols.astype(np.int64)
    while len(seq) and seq.max() >= vocabulary:
        big = seq >= vocabulary
        twice = np.repeat(seq, np.where(big, 2, 1))
        at = np.cumsum(np.where(big, 2, 1)) - np.where(big, 2, 1)
        twice[at[big]] = rules[seq[big] - vocabulary, 0]
        twice[at[big] + 1] = rules[seq[big] - vocabulary, 1]
        seq = twice
    return seq


class TokenFile:
    """One shard: a header, rules, expansion lengths, document table and symbols."""

    def __init__(self, body: bytes) -> None:
        if body[:4] != MAGIC:
            raise ValueError("not a token file")
        self.vocabulary, n_docs, n_rules, n_symbols, width = struct.unpack_from("<5q", body, 4)
        at = 44

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(body, kind, n, at)
            at += out.nbytes
            return out

        self.rules = take("<u4", 2 * n_rules).reshape(-1, 2).astype(np.int64)
        self.sizes = np.concatenate([np.ones(self.vocabulary, np.int64), take("<u8", n_rules).astype(np.int64)])
        named = struct.unpack_from("<q", body, at)[0]
        at += 8
        self.ids: list[int | str | None] = json.loads(body[at:at + named])
        at += named
        self.ends = np.cumsum(take("<u4", n_docs).astype(np.int64))
        self.lengths = take("<u4", n_docs).astype(np.int64)
        self.symbols = take(f"<u{width}", n_symbols)

    @staticmethod
    def pack(doc_ids: list[int | str | None], ids: np.ndarray, lengths: np.ndarray, vocabulary: int, **how) -> bytes:
        symbols, per, rules, sizes = compress(ids, np.cumsum(lengths), vocabulary, **how)
        width = 2 if vocabulary + len(rules) <= 1 << 16 else 4
        names = json.dumps(doc_ids).encode()
        return MAGIC + struct.pack("<5q", vocabulary, len(doc_ids), len(rules), len(symbols), width) + b"".join([
            rules.astype("<u4").tobytes(), sizes.astype("<u8").tobytes(),
            struct.pack("<q", len(names)), names,
            per.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), symbols.astype(f"<u{width}").tobytes(),
        ])

    def read(self, doc: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids ``start`` to ``stop`` of a document; only the symbols that hold them are expanded."""
        symbols = self.symbols[(self.ends[doc - 1] if doc else 0):self.ends[doc]].astype(np.int64)
        upto = np.cumsum(self.sizes[symbols])
        stop = int(self.lengths[doc]) if stop is None else min(stop, int(self.lengths[doc]))
        if start >= stop:
            return np.zeros(0, np.int64)
        a, b = np.searchsorted(upto, start, "right"), np.searchsorted(upto, stop)
        before = int(upto[a - 1]) if a else 0
        return expand(symbols[a:b + 1], self.rules, self.vocabulary)[start - before:stop - before]

    def documents(self) -> Iterator[tuple[int | str | None, np.ndarray]]:
        # every symbol's ids are spelled once and then copied to where it stands
        spelled = np.concatenate([np.arange(self.vocabulary), expand(np.arange(self.vocabulary, len(self.sizes)), self.rules, self.vocabulary)])
        sizes = self.sizes[self.symbols]
        begin = (np.cumsum(self.sizes) - self.sizes)[self.symbols] - (np.cumsum(sizes) - sizes)
        every = spelled[np.repeat(begin, sizes) + np.arange(sizes.sum())]
        at = 0
        for doc, n in zip(self.ids, self.lengths.tolist(), strict=True):
            yield doc, every[at:at + n]
            at += n


def write_token_files(
    prompts: DataFrame, path: str, vocabulary_file: str, end: int = 2, id: str = "id", prompt: str = "prompt",
    shard_ids: int = 500_000, rounds: int = 4,
) -> None:
    """Encode every prompt, append ``end``, and write shards in ascending order of id to ``path``.

    Rows are dealt by ranges of id, so shard order is id order: (part, before) ascending, where
    ``before`` counts the ids that the same task wrote earlier. A shard
    holds about ``shard_ids`` ids; a longer document has a shard of its own. Equal ids are ordered
    by text, nulls come first, a null prompt has only the end id. Whole prompts are encoded. Ids are
    integers or texts. Repeated rows are written each. An empty table leaves a folder without shards.
    """
    def shards(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        enc, part, before = encoder(vocabulary_file), TaskContext.get().partitionId(), 0
        size = max(enc.model.get_vocab_size(), end + 1)
        tail = struct.pack("<I", end)
        docs, held, n = [], [], 0

        def out():
            ids = np.frombuffer(b"".join(held), "<u4")
            body = TokenFile.pack(docs, ids, np.array([len(x) // 4 for x in held]), size, rounds=rounds)
            return pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "before": [before], "docs": [len(docs)], "ids": [len(ids)], "body": pa.array([body], pa.binary())}
            )

        for ids, texts in blocks(batches, "id", "text"):
            for doc, body in zip(ids, enc.encode(texts), strict=True):
                docs.append(doc)
                held.append(body + tail)
                n += len(body) // 4 + 1
                if n >= shard_ids:
                    yield out()
                    before += n
                    docs, held, n = [], [], 0
        if docs:
            yield out()

    rows = prompts.select(F.col(id).alias("id"), F.col(prompt).cast("string").alias("text"))
    rows.repartitionByRange("id").sortWithinPartitions("id", "text").mapInArrow(shards, FILE).write.parquet(path)


def read_token_files(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """``id, start, ids``: every document of the files; ``start`` counts the ids of all before it.

    ``id_type`` is ``long`` or ``string``, as the ids were written. ``ids`` is the document's ids as little-endian unsigned 32-bit integers.
    """
    files = spark.read.schema(FILE).parquet(path)
    parts = files.groupBy("part").agg(F.sum("ids").alias("n"))
    # one row of two numbers per write task, so one ordered pass and a broadcast are small
    bases = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("base"))

    def documents(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                at, out = row["base"] + row["before"], []
                for doc, ids in TokenFile(row["body"]).documents():
                    out.append((doc, at, ids.astype("<u4").tobytes()))
                    at += len(ids)
                    if len(out) == 500:
                        yield _rows(pa, out, id_type)
                        out = []
                if out:
                    yield _rows(pa, out, id_type)

    return files.select("part", "before", "body").join(F.broadcast(bases), "part").mapInArrow(
        documents, f"id {id_type}, start long, ids binary"
    )


def _rows(pa, out, id_type):
    return pa.RecordBatch.from_arrays(
        [pa.array([x[0] for x in out], pa.string() if id_type == "string" else pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary())],
        ["id", "start", "ids"],
    )
