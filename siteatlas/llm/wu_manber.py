"""Wu-Manber multi-pattern search over a byte buffer, many cursors at a time.

Patterns are put in classes by length, so that one short pattern does not
shorten the shifts of the rest.  In a class, ``m`` is the least length; the
table ``shift`` gives, for the hash of the ``block`` bytes that end a window of
``m`` bytes, how far the window may move without passing an occurrence.  Where
it may not move at all, the bucket of that hash lists the patterns whose first
``m`` bytes end so; a prefix word thins them out and a direct comparison of
all bytes decides.

The cursors of one search stand at equal distances in the buffer and move
together, each by its own shift, which makes every step an array operation.
"""

from __future__ import annotations

import numpy as np

LANES = 8192
CLASS_BOUNDS = (3, 8, 16, 32, 64)
MIX = np.uint64(0x9E3779B97F4A7C15)


def words_at(buffer: np.ndarray) -> np.ndarray:
    """A view of 8-byte words, one at every byte of a buffer that is padded by 8 bytes."""
    return np.ndarray((len(buffer) - 7,), dtype="<u8", buffer=buffer, strides=(1,))


class LengthClass:
    """The tables for patterns of about equal length."""

    def __init__(self, ids: np.ndarray, patterns: list[bytes]):
        self.ids, self.patterns = ids, patterns
        self.m = m = min(min(map(len, patterns)), 255)
        self.block = block = min(8, m)
        self.mask = np.uint64((1 << (8 * block)) - 1)
        bits = int(np.clip(np.ceil(np.log2(len(patterns) * m + 1)) + 4, 10, 24))
        self.down = np.uint64(64 - bits)
        heads = np.frombuffer(b"".join(p[:m] for p in patterns) + bytes(8), dtype=np.uint8)
        words = words_at(heads)
        first = np.arange(len(patterns), dtype=np.int64) * m
        self.shift = np.full(1 << bits, m - block + 1, dtype=np.uint8)
        for end in range(block, m + 1):
            np.minimum.at(self.shift, self.hash(words[first + end - block]), np.uint8(m - end))
        last = self.hash(words[first + m - block])
        self.order = np.argsort(last, kind="stable")
        self.bucket = np.searchsorted(last[self.order], np.arange((1 << bits) + 1)).astype(np.int32)
        self.prefix = words[first] & self.mask

    def hash(self, words: np.ndarray) -> np.ndarray:
        return (((words & self.mask) * MIX) >> self.down).astype(np.int64)

    def candidates(self, words: np.ndarray, size: int) -> np.ndarray:
        """Ends of the windows that can't be passed over."""
        first, block = self.m - 1, self.block
        if size < self.m:
            return np.empty(0, dtype=np.int64)
        edges = np.linspace(first, size, min(LANES, size - first) + 1).astype(np.int64)
        at, until, found = edges[:-1].copy(), edges[1:], []
        while len(at):
            step = self.shift[self.hash(words[at - block + 1])]
            stop = step == 0
            if stop.any():
                found.append(at[stop])
            at = at + np.maximum(step, 1)
            going = at < until
            if not going.all():
                at, until = at[going], until[going]
        return np.concatenate(found) if found else np.empty(0, dtype=np.int64)

    def search(self, text: bytes, words: np.ndarray) -> list[tuple[int, int]]:
        """(start, pattern id) of every occurrence."""
        ends = self.candidates(words, len(text))
        if not len(ends):
            return []
        h = self.hash(words[ends - self.block + 1])
        low, n = self.bucket[h], self.bucket[h + 1] - self.bucket[h]
        starts = np.repeat(ends - self.m + 1, n)
        nth = np.arange(len(starts)) - np.repeat(np.cumsum(n) - n, n)
        which = self.order[np.repeat(low, n) + nth]
        same = (words[starts] & self.mask) == self.prefix[which]
        return [
            (s, int(self.ids[k]))
            for s, k in zip(starts[same].tolist(), which[same].tolist(), strict=True)
            if text.startswith(self.patterns[k], s)
        ]


class WuManber:
    """Search for a fixed list of byte patterns, none of them empty."""

    def __init__(self, patterns: list[bytes]):
        sizes = np.array([len(p) for p in patterns], dtype=np.int64)
        kinds = np.searchsorted(CLASS_BOUNDS, sizes, side="right")
        self.classes = [
            LengthClass(ids, [patterns[i] for i in ids]) for k in np.unique(kinds) for ids in [np.flatnonzero(kinds == k)]
        ]

    def search(self, text: bytes) -> list[tuple[int, int]]:
        """(start, index of the pattern) of every occurrence in the text, in no order."""
        if not self.classes or not text:
            return []
        words = words_at(np.frombuffer(text + bytes(8), dtype=np.uint8))
        return [hit for c in self.classes for hit in c.search(text, words)]
