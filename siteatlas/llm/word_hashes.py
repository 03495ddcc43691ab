"""64-bit hashes of the words of many texts at once, and of runs of words, by array operations."""

from __future__ import annotations

import numpy as np

#: Bytes hashed at a time; bounds the working memory, whatever the length of a text.
SLICE = 1 << 21
WHITE = np.zeros(256, dtype=bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
BYTE_VALUE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)
#: Bits of an exponent in the low one of two factors.
BLOCK = 11
STEP_BACK = np.uint64(pow(int(STEP), -1, 1 << 64))
#: Of each byte as it stands in a text; white space adds nothing to a word's sum.
FOLDED_VALUE = np.where(WHITE, np.uint64(0), BYTE_VALUE[FOLD])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every bit depends on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words (between ASCII white space, A-Z lower-cased) of a list of texts, in order.

    ``hash``: of each word; ``text``: which text it is from; ``line_start``:
    whether it is the first of its line.
    """

    def __init__(self, texts: list[bytes]):
        hashes, owners, fresh = [], [], []
        pending: list[tuple[int, bytes]] = []
        size = 0
        for i, t in enumerate(texts):
            for piece in pieces(t):
                pending.append((i, piece))
                size += len(piece)
                if size >= SLICE:
                    self._hash(pending, hashes, owners, fresh)
                    pending, size = [], 0
        self._hash(pending, hashes, owners, fresh)
        self.hash = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        self.text = np.concatenate(owners) if owners else np.empty(0, np.int64)
        self.line_start = np.concatenate(fresh) if fresh else np.empty(0, bool)
        self.counts = np.bincount(self.text, minlength=len(texts)).astype(np.int64)
        self.first = np.cumsum(self.counts) - self.counts

    @staticmethod
    def _hash(pending, hashes, owners, fresh) -> None:
        if not pending:
            return
        buffer = np.frombuffer(b"\n".join(p for _, p in pending) + b"\n", dtype=np.uint8)
        white = WHITE[buffer]
        starts = np.flatnonzero(~white & np.append(True, white[:-1]))
        if not len(starts):
            return
        ends = np.flatnonzero(white & np.append(False, ~white[:-1]))
        length = ends - starts
        # A word's sum is that of its bytes times the powers of ``STEP`` from the first on: those of the buffer's places, taken back by the word's.
        value = FOLDED_VALUE[buffer]
        high, low = powers(STEP, len(buffer))
        value *= np.multiply.outer(high, low).ravel()[: len(buffer)]
        first = value[starts]
        total = np.cumsum(value, out=value)
        high, low = powers(STEP_BACK, len(buffer))
        back = high[starts >> BLOCK] * low[starts & ((1 << BLOCK) - 1)] * STEP
        hashes.append(mix((total[ends - 1] - total[starts] + first) * back + length.astype(np.uint64)))
        at = np.cumsum([0, *(len(p) + 1 for _, p in pending)])
        owners.append(np.repeat(np.array([i for i, _ in pending], np.int64), np.diff(np.searchsorted(starts, at))))
        line_start = np.zeros(len(starts) + 1, bool)
        line_start[np.searchsorted(starts, np.flatnonzero(buffer == 10))] = True
        line_start[0] = True
        fresh.append(line_start[:-1])


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of a 64-bit word with exponents of 0 to ``n`` - 1 as two factors, by the exponent's high bits and its ``BLOCK`` low ones."""
    low = np.full((1 << BLOCK) + 1, base)
    low[0] = 1
    low = np.multiply.accumulate(low)
    high = np.full((n >> BLOCK) + 1, low[-1])
    high[0] = 1
    return np.multiply.accumulate(high), low[:-1]


def pieces(text: bytes):
    """A text whole, or if it is long, cut at white space after about a slice's length."""
    at = 0
    while len(text) - at > SLICE:
        cut = min((p for p in (text.find(c, at + SLICE) for c in (b" ", b"\n")) if p >= 0), default=len(text))
        yield text[at:cut]
        at = cut
    yield text[at:]


def runs(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of every run of ``size`` words, one for each start."""
    if len(words) < size:
        return np.empty(0, np.uint64)
    n = len(words) - size + 1
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = (total * STEP) + words[k : k + n]
        total = total ^ (total >> np.uint64(29))
    return mix(total)
