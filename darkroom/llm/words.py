"""Words of many texts at once, as arrays of 64-bit hashes."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

#: Bytes that part words.
BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Longer words are hashed one by one.
LONG = 512


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each byte range of ``data``, which has eight spare bytes at its end.

    Eight bytes at a time go through ``mix`` together with what came before, so no rule of
    arithmetic makes different ranges alike, as it does for sums of powers.
    """
    lanes = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    size = end - start
    h = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    live, at = np.arange(len(start)), 0
    while True:
        live = live[(size[live] > at) & (size[live] <= LONG)]
        if not len(live):
            break
        spare = (64 - 8 * np.minimum(size[live] - at, 8)).astype(np.uint64)
        block = lanes[start[live] + at] << spare  # bytes beyond the end are shifted out
        h[live] = mix(h[live] * np.uint64(0xD6E8FEB86659FD93) ^ block)
        at += 8
    for i in np.flatnonzero(size > LONG):
        h[i] = int.from_bytes(blake2b(data[start[i]:end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


class Words:
    """``hash``, ``owner`` (index of the text), ``start`` and ``end`` (bytes in ``raw``) of every word."""

    def __init__(self, texts: list[str | None], lower: bool = False) -> None:
        self.raw = b"\n".join([(t or "").encode() for t in texts]) + b"\n"
        data = np.frombuffer(self.raw + bytes(8), np.uint8)
        blank = BLANK[data[:-8]]
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        if len(blank) and not blank[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[::2], edge[1::2]
        self.hash = hash_ranges(_LOWER[data] if lower else data, self.start, self.end)
        sizes = np.array([len((t or "").encode()) + 1 for t in texts], dtype=np.int64)
        self.text_start = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
        self.owner = np.searchsorted(self.text_start, self.start, "right") - 1
        self.count = np.bincount(self.owner, minlength=len(texts)) if len(texts) else np.zeros(0, np.int64)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """A hash for every ``k`` neighbouring entries of ``h``."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, factor = np.zeros(n, np.uint64), 1
    for j in range(k):
        factor = factor * 0xD6E8FEB86659FD93 % (1 << 64)
        out += h[j:j + n] * np.uint64(factor)
    return mix(out)
