"""Token ids of texts, with one bounded cache per Python worker.

Encoding is split where the tokenizer splits anyway: before a single space or line end between two visible
characters. The distinct parts of a block of texts are numbered by Arrow, those not remembered go through the
``tokenizers`` library; texts with other white space next to a space, or with an added token, are encoded whole.
"""

from __future__ import annotations

import os
import re

#: Where the tokenizer parts a text whatever stands around it.
GAP = re.compile(r"(?<=\S) (?=\S)")
#: What the tokenizer parts from the marks behind it whatever they are: letters or digits alone, or nothing.
PLAIN = "^([A-Za-zÀ-ÖØ-öø-ɏ]+|[0-9]+)?$"
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: The characters that spell bytes in a byte-level vocabulary: visible ones of Latin-1 themselves, others from 256 on.
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
SPELLED = {b: chr(b if b in _SHOWN else 256 + sum(x not in _SHOWN for x in range(b))) for b in range(256)}
#: Bytes that no UTF-8 text holds.
UNUSED = (0xC0, 0xC1, *range(0xF5, 0x100))
#: Characters of a text that are encoded at a time.
PASSAGE = 1_000_000
#: Bytes of parts and their ids that one worker remembers; beyond that the half used last stays.
REMEMBERED = 8_000_000
#: Longer parts are not remembered.
LONGEST = 40
#: Parts that the library sees in one text.
TOGETHER = 500


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        import pyarrow as pa
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        #: The library's merges alone, for parts whose bytes are spelled.
        self.merges = Tokenizer(self.model.model)
        #: Texts holding one of these are encoded whole.
        self.added = [t.content for t in self.model.get_added_tokens_decoder().values()]
        #: Remembered parts, their ids, and the block that last used each. A part that no space precedes is kept
        #: with a space in front, as no other has one.
        self.names, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self.used, self.block = np.zeros(0, np.int64), 0
        self.space, self.line_end = self._library([" ", "\n"])
        # a byte-level vocabulary spells every byte as one character, so an id's length is its bytes
        vocabulary = self.model.get_vocab()
        self.sizes = np.zeros(self.model.get_vocab_size(), np.int64)
        for token, i in vocabulary.items():
            self.sizes[i] = len(token)
        # a character that no merge has keeps parts apart
        whole = "".join(t for t in vocabulary if len(t) > 1)
        self.between = next((c for b in UNUSED if (c := SPELLED[b]) in vocabulary and c not in whole), "")
        if not self.between:
            raise ValueError("a vocabulary of another kind")
        self.apart = vocabulary[self.between]

    def _library(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        done = self.model.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in done]

    def _known(self, names):
        """Of distinct stretches, each with the space before it: their ids, and where white space at an end forbids that.

        ``names`` is an Arrow array. A stretch is a line end or none, letters or digits or none, and marks or none,
        all of which the tokenizer parts; other stretches are parts themselves.
        """
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        n, length = len(names), lambda x: pc.binary_length(x).to_numpy()
        core = pc.ascii_ltrim(names, "\n")
        led = length(names) > length(core)
        base = pc.ascii_rtrim(core, MARKS)
        odd = ~pc.match_substring_regex(base, PLAIN).to_numpy(zero_copy_only=False)
        front = length(base)
        front = np.where(front > 0, front, length(core))
        # cores cut in two: 2 k is what stands in front in the k-th, 2 k + 1 the marks behind it
        _, offsets, body = core.buffers()
        starts = np.frombuffer(offsets, np.int64, n + 1, 8 * core.offset)
        cuts = np.empty(2 * n + 1, np.int64)
        cuts[::2], cuts[1::2] = starts, starts[:-1] + front
        halves = pa.Array.from_buffers(pa.large_string(), 2 * n, [None, pa.py_buffer(cuts), body])
        bad, some = np.zeros(n, bool), []
        for k, w in zip(np.flatnonzero(odd).tolist(), names.filter(pa.array(odd)).to_pylist(), strict=True):
            bad[k] = w[int(led[k])].isspace() or w[-1].isspace()
            if not bad[k]:
                some.append((k, w))
        filled = np.diff(cuts) > 0
        filled[::2] &= ~odd
        filled[1::2] &= ~odd
        close = filled.copy()  # no space precedes these
        close[::2] &= led
        spaced, close = np.flatnonzero(filled & ~close & (np.arange(2 * n) % 2 == 0)), np.flatnonzero(close)
        behind = halves.take(pa.array(close)).dictionary_encode()
        tight = pa.array([" " + w for w in behind.dictionary.to_pylist()], pa.large_string())
        every = [halves.take(pa.array(spaced)), tight, pa.array([w for _, w in some], pa.large_string())]
        codes = self._codes(every, len(some))
        # every stretch as three places of the parts' ids, the first for a line end
        places = np.full(3 * n, len(self.ids), np.int64)
        places[::3] += led
        places[3 * (spaced // 2) + 1] = codes[:len(spaced)]
        places[3 * (close // 2) + 1 + close % 2] = codes[len(spaced):][behind.indices.to_numpy()]
        if some:
            own = np.array([k for k, _ in some])
            places[3 * own + 1], places[3 * own] = codes[len(codes) - len(some):], len(self.ids)
        lone = length(core) == 0
        places[3 * np.flatnonzero(lone & ~led) + 1] = len(self.ids) + 2
        strung = pa.concat_arrays([self.ids, pa.array([b"", self.line_end, self.space], pa.large_binary())]).take(pa.array(places))
        _, offsets, body = strung.buffers()
        offsets = np.frombuffer(offsets, np.int64, 3 * n + 1, 8 * strung.offset)[::3].copy()
        return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), body]), lone, bad

    def _codes(self, parts: list, odd: int):
        """The place of each part among those remembered; new ones are added. The last ``odd`` need the whole library."""
        import numpy as np
        import pyarrow as pa

        self.block += 1
        before = len(self.names)
        coded = pa.concat_arrays([self.names, *parts]).dictionary_encode()
        self.names, codes = coded.dictionary, coded.indices.slice(before).to_numpy()
        new = self.names.slice(before).to_pylist()
        strange = len(np.unique(own[own >= before])) if len(own := codes[len(codes) - odd:]) else 0
        plain, strange = new[:len(new) - strange], new[len(new) - strange:]
        found = [self.ids]
        for ask, some in ((self._parts, plain), (self._joined, strange)):
            if some:
                found.append(ask(some))
        self.ids = pa.concat_arrays(found)
        self.used = np.concatenate([self.used, np.zeros(len(new), np.int64)])
        self.used[codes] = self.block
        return codes

    def _forget(self) -> None:
        """Drops long parts and, where too much is remembered, the half that was used longest ago."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        keep = np.flatnonzero(pc.binary_length(self.names).to_numpy() <= LONGEST)
        if self.names.nbytes + self.ids.nbytes > REMEMBERED:
            keep = keep[np.argsort(-self.used[keep], kind="stable")[:len(keep) // 2]]
        if len(keep) < len(self.names):
            self.names, self.ids, self.used = self.names.take(pa.array(keep)), self.ids.take(pa.array(keep)), self.used[keep]

    def _parts(self, names: list[str]):
        """The ids of plain parts from the library's own merges, which need no rule here to part them."""
        import numpy as np

        found = []
        for i in range(0, len(names), TOGETHER):
            text = "".join([w[1:] + "\2" if w[0] == " " else "\1" + w + "\2" for w in names[i:i + TOGETHER]])
            if text.isascii():
                text = text.replace("\1", SPELLED[32]).replace("\2", self.between)
            else:
                text = text.encode().decode("latin-1").translate(SPELLED | {1: SPELLED[32], 2: self.between})
            found.append(np.array(self.merges.encode_batch_fast([text])[0].ids, dtype="<u4"))
        ids = np.concatenate(found)
        ends = np.flatnonzero(ids == self.apart)
        if len(ends) != len(names):  # never, if the vocabulary spells bytes
            raise ValueError("a vocabulary of another kind")
        return _runs(ids[ids != self.apart], ends - np.arange(len(ends)))

    def _joined(self, names: list[str]):
        """Other stretches in one text for the whole library, cut apart again by the bytes their ids spell."""
        import numpy as np
        import pyarrow as pa

        found = []
        for i in range(0, len(names), TOGETHER):
            some = [w if w[0] == "\n" else " " + w for w in names[i:i + TOGETHER]]
            ids = np.frombuffer(self._library(["".join(some)])[0], "<u4")
            upto, ends = np.cumsum(self.sizes[ids]), np.cumsum([len(w.encode()) for w in some])
            cuts = np.searchsorted(upto, ends)
            if upto[-1] == ends[-1] and (upto[cuts] == ends).all():
                found.append(_runs(ids, cuts + 1))
            else:  # apart if the vocabulary parts otherwise
                found.append(pa.array(self._library(some), pa.large_binary()))
        return pa.concat_arrays(found)

    def _long(self, text: str) -> bytes:
        """A very long text passage by passage, cut where it parts anyway."""
        out, at, lead = [], 0, ""
        skip = len(self._library(["a"])[0])
        while at < len(text):
            cut = GAP.search(text, at + PASSAGE)
            end = cut.start() if cut else len(text)
            # later passages begin with their space, so a letter is put before it and its id taken off
            out.append(self.encode([lead + text[at:end]], whole_texts=True)[0][skip if lead else 0:])
            at, lead = end, "a"
        return b"".join(out)

    def encode(self, texts: list[str | None], whole_texts: bool = False) -> list[bytes]:
        """The ids of every text as little-endian unsigned 32-bit integers; a null is empty."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if not texts:
            return []
        if not whole_texts:
            large = {i: self._long(t) for i, t in enumerate(texts) if t and len(t) > 2 * PASSAGE and not any(a in t for a in self.added)}
            if large:
                rest = iter(self.encode([t for i, t in enumerate(texts) if i not in large]))
                return [large[i] if i in large else next(rest) for i in range(len(texts))]
        self._forget()
        whole = {i for i, t in enumerate(texts) if t and any(a in t for a in self.added)}
        # Arrow parts the texts, numbers the different stretches and strings their ids together
        given = pa.array(["" if i in whole else t or "" for i, t in enumerate(texts)], pa.large_string())
        lists = pc.split_pattern(pc.replace_substring(given, "\n", " \n"), " ")
        stretches, bounds = lists.flatten(), lists.offsets.to_numpy()
        del given, lists
        heads = stretches.take(pa.array(bounds[:-1])).to_pylist()
        coded, starts = stretches.dictionary_encode(), bounds[:-1]
        del stretches
        known, lone, bad = self._known(coded.dictionary)
        first = dict(zip(some := list({h for h in heads if h}), self._library(some), strict=True))
        order = coded.indices.to_numpy().copy()
        unknown, lone = bad[order], lone[order]
        lone[starts] = False
        unknown[1:] |= lone[1:] & lone[:-1]  # two gaps in a row; at the start of a text its head stands between
        unknown[starts] = [h != "" and h[-1].isspace() or h == "" and n > 1 for h, n in zip(heads, np.diff(bounds).tolist(), strict=True)]
        whole.update((np.searchsorted(bounds, np.flatnonzero(unknown), "right") - 1).tolist())
        order[starts] = len(known) + np.arange(len(texts))
        strung = pa.concat_arrays([known, pa.array([first.get(h, b"") for h in heads], pa.large_binary())]).take(pa.array(order))
        _, offsets, body = strung.buffers()
        at = np.frombuffer(offsets, np.int64, len(order) + 1, 8 * strung.offset)[bounds].tolist()
        body = memoryview(body or b"")
        out = [bytes(body[a:b]) for a, b in zip(at, at[1:], strict=False)]
        whole = sorted(whole)
        for i, ids in zip(whole, self._library([texts[i] for i in whole]), strict=True):
            out[i] = ids
        return out


def _runs(ids, ends):
    """Little-endian unsigned 32-bit ids as one binary value for each run, which end at ``ends``."""
    import numpy as np
    import pyarrow as pa

    offsets = np.concatenate([[0], 4 * ends]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<u4"))])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def blocks(batches, *columns: str, most: int = 8_000_000):
    """Arrow batches as lists of column values, at most about ``most`` characters at a time."""
    import pyarrow.compute as pc

    for batch in batches:
        values = [batch.column(batch.schema.get_field_index(c)) for c in columns]
        sizes = pc.fill_null(pc.binary_length(values[-1]), 0).to_numpy(zero_copy_only=False)
        at, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > most:
                yield [v.slice(at, i - at).to_pylist() for v in values]
                at, held = i, 0
            held += int(size) + 1
        if held:
            yield [v.slice(at).to_pylist() for v in values]
