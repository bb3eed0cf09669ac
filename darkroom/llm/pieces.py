"""Phrases as pieces of a merge-type SentencePiece vocabulary, and back."""

from __future__ import annotations

import heapq
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darkroom.llm.vocab import blocks

SPACE = "▁"
#: Stretches in one worker's young cache; when it is full it becomes the old one.
REMEMBERED = 300_000


class Pieces:
    """A merge-type vocabulary and its agenda.

    All neighbouring symbols that together are a piece wait in a heap, best score first and the
    left one on a tie. The first is merged if both its symbols still stand, and the pairs it makes
    with its neighbours join the heap. What is left and is no piece becomes bytes.

    No piece has a space mark after another character, which is checked when the vocabulary is
    read. So merges never cross the start of a space run, and a text's words are independent of
    each other. Every distinct stretch is encoded once and held against the library.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(sp.get_piece_size())
        self.text = [sp.id_to_piece(i) for i in every]
        plain = [i for i in every if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {self.text[i]: i for i in plain}
        #: Of every piece its score with the sign changed, so that the best one is the smallest.
        self.cost = {self.text[i]: -sp.get_score(i) for i in plain}
        self.bytes = {int(self.text[i][3:5], 16): i for i in every if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece crosses the start of a word; words can't be encoded on their own")
        if any(sp.is_unused(i) for i in every):
            raise ValueError("vocabularies with unused pieces are not handled")
        #: Ids of stretches, named without the space mark in front.
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        #: Stretches the library encodes in another way than the agenda; its ids are the ones that count.
        self.differing = 0

    def agenda(self, stretch: str) -> list[int]:
        """The ids of a stretch whose spaces are space marks already."""
        part: list[str] = list(stretch)
        n = len(part)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        cost, push, heap = self.cost.get, heapq.heappush, []
        for i in range(n - 1):
            both = part[i] + part[i + 1]
            if (worth := cost(both)) is not None:
                heap.append((worth, i, both))
        heapq.heapify(heap)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i] if part[i] else n
            if j >= n or part[i] + part[j] != both:
                continue
            part[i], part[j] = both, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                joined = both + part[k]
                if (worth := cost(joined)) is not None:
                    push(heap, (worth, i, joined))
            h = before[i]
            if h >= 0:
                joined = part[h] + both
                if (worth := cost(joined)) is not None:
                    push(heap, (worth, h, joined))
        out: list[int] = []
        for p in part:
            if p:
                if p in self.ids:
                    out.append(self.ids[p])
                elif self.bytes:
                    out += [self.bytes[b] for b in p.encode()]
                else:
                    out.append(self.unknown)
        return out

    def learn(self, words: list[str]) -> None:
        """Encode new stretches, each with a space mark in front, and hold them against the library."""
        theirs = self.library.encode(words, num_threads=1)
        for word, checked in zip(words, theirs, strict=True):
            self.differing += self.agenda(SPACE + word) != checked
            self.young[word] = tuple(checked)

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of every text: a space mark in front, as the library has it; a null is empty."""
        if len(self.young) > REMEMBERED:
            self.young, self.old = {}, self.young
        words, odd = [], {}
        for i, text in enumerate(texts):
            # the library takes NUL and a few others its own way, and space runs stick together
            plain = text and "  " not in text and SPACE not in text and text[0] != " " and text[-1] != " " and "\0" not in text
            if plain or not text:
                words.append(text.split(" ") if text else [])
            else:
                words.append([])
                odd[i] = self._whole(text)
        young, old = self.young, self.old
        missing = set().union(*words).difference(young)
        again = {w for w in missing if w in old}
        young.update((w, old[w]) for w in again)
        self.learn(list(missing - again))
        of = young.__getitem__
        return [odd[i] if i in odd else list(chain.from_iterable(map(of, ws))) for i, ws in enumerate(words)]

    def _whole(self, text: str) -> list[int]:
        """A text with space runs: split where a mark follows another character."""
        marked, ids, at = SPACE + text.replace(" ", SPACE), [], 0
        for i in range(1, len(marked)):
            if marked[i] == SPACE and marked[i - 1] != SPACE:
                ids += self.agenda(marked[at:i])
                at = i
        ids += self.agenda(marked[at:])
        checked = self.library.encode(text)
        self.differing += ids != checked
        return checked


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def encode_phrases(phrases: DataFrame, model_file: str, id: str = "id", phrase: str = "phrase") -> DataFrame:
    """``id, ids, decoded`` per row: the phrase's pieces without begin or end ids, and the text they give back.

    Whole phrases are encoded, at about 4
    million characters of a batch at a time. Null and empty phrases have no ids and decode to the
    empty text. Should the library encode a stretch differently, its ids are taken. Ids keep their type. Repeated rows are encoded each. An empty table gives no rows.
    """
    def run(batches):
        import numpy as np
        import pyarrow as pa

        model = pieces(model_file)
        for batch in batches:
            ids_of = batch.schema.field("id").type
            for ids, texts in blocks([batch], "id", "text", most=4_000_000):
                coded = model.encode(texts)
                decoded = model.library.decode(coded, num_threads=1) if coded else []
                ends = np.cumsum([0, *map(len, coded)], dtype=np.int32)
                flat = np.fromiter(chain.from_iterable(coded), np.int32, int(ends[-1]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, ids_of), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(decoded, pa.string())],
                    ["id", "ids", "decoded"],
                )

    rows = phrases.select(F.col(id).alias("id"), F.col(phrase).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {phrases.schema[id].dataType.simpleString()}, ids array<int>, decoded string")
