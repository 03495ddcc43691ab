"""Unigram piece vocabularies over a double-array trie, and passes over many segmentation lattices at once.

In the tables a space stands for the whitespace marker, so a chunk of text is
its own UTF-8.  A literal marker character in a text matches no piece and goes
to bytes, which keeps decoding exact.
"""

from __future__ import annotations

from collections import deque

import numpy as np

MARKER = "▁"
#: Chunks up to so many bytes are passed over together, position by position.
SHORT = 64
UNKNOWN_PENALTY = 10.0
#: Offset of the Zipf-Mandelbrot law that turns ranks into log scores.
ZIPF_OFFSET = 2.7


class Vocabulary:
    """Pieces with log scores, byte pieces, and what may be cut between chunks."""

    def __init__(self, pieces: list[tuple[int, str, float]], byte_ids: list[int], size: int):
        """pieces: (id, text, log score); byte_ids: the id of each of 256 bytes."""
        self.size = size
        self.byte_ids = np.array(byte_ids, dtype=np.int32)
        self.scores = np.full(size, -np.inf)
        self.surface: list[bytes] = [b""] * size
        keys: dict[bytes, int] = {}
        for i, text, score in pieces:
            key = text.replace(MARKER, " ").encode()
            if key and key not in keys:
                keys[key] = i
                self.scores[i], self.surface[i] = score, key
        for b, i in enumerate(byte_ids):
            self.surface[i] = bytes([b])
        self.unknown = min((s for _, _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.trie = DoubleArray(keys)
        self.cut_spaces = not any(b" " in k.lstrip(b" ") for k in keys)
        self.cut_lines = not any(b"\n" in k for k in keys)


def load_sentencepiece(path: str) -> Vocabulary:
    """The pieces of a SentencePiece file.

    A unigram file has log scores.  A BPE file has the negated rank of each
    merge instead; its log score is taken from the rank by Zipf-Mandelbrot.
    """
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    normal = [(i, p.piece, p.score) for i, p in enumerate(model.pieces) if p.type in (pb.ModelProto.SentencePiece.NORMAL, pb.ModelProto.SentencePiece.USER_DEFINED)]
    by_byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == pb.ModelProto.SentencePiece.BYTE}
    if model.trainer_spec.model_type != 1:
        logs = [-float(np.log(-s + ZIPF_OFFSET)) for _, _, s in normal]
        total = float(np.log(np.sum(np.exp(logs))))
        normal = [(i, p, s - total) for (i, p, _), s in zip(normal, logs, strict=True)]
    return Vocabulary(normal, [by_byte[b] for b in range(256)], len(model.pieces))


class DoubleArray:
    """A double-array trie: from state s, byte c leads to t = base[s] + c where check[t] == s."""

    def __init__(self, keys: dict[bytes, int]):
        ordered = sorted(keys)
        size = 1024
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0] = 0
        free = 1  # no slot before it is free
        todo = deque([(0, 0, len(ordered), 0)])  # state, range of keys, depth
        while todo:
            state, low, high, depth = todo.popleft()
            if low < high and len(ordered[low]) == depth:
                value[state] = keys[ordered[low]]
                low += 1
            if low == high:
                continue
            starts: list[tuple[int, int]] = []
            for k in range(low, high):
                c = ordered[k][depth]
                if not starts or starts[-1][0] != c:
                    starts.append((c, k))
            while free < len(check) and check[free] >= 0:
                free += 1
            least = starts[0][0]
            at, tries = max(free - least, 1), 0
            while True:
                if at + 257 > len(check):
                    more = len(check)
                    base += [0] * more
                    check += [-1] * more
                    value += [-1] * more
                if all(check[at + c] < 0 for c, _ in starts):
                    break
                at, tries = at + 1, tries + 1
            if tries > 64:  # the slots passed are nearly full: leave the gaps
                free = max(free, at + least)
            base[state] = at
            bounds = [k for _, k in starts[1:]] + [high]
            for (c, k), end in zip(starts, bounds, strict=True):
                check[at + c] = state
                todo.append((at + c, k, end, depth + 1))
        used = max(i for i, c in enumerate(check) if c >= 0) + 257
        pad = max(0, used - len(check))
        self.base = np.array((base + [0] * pad)[:used], dtype=np.int32)
        self.check = np.array((check + [-1] * pad)[:used], dtype=np.int32)
        self.value = np.array((value + [-1] * pad)[:used], dtype=np.int32)
        self.longest = max(map(len, ordered), default=0)


def in_groups(chunks: list[bytes], size: int = 1 << 18):
    """The chunks in groups of about so many bytes: a lattice takes a few hundred bytes of memory for each byte."""
    group, taken = [], 0
    for c in chunks:
        group.append(c)
        taken += len(c)
        if taken >= size:
            yield group
            group, taken = [], 0
    if group:
        yield group


class Lattices:
    """The edges of the segmentation lattices of many chunks, laid end to end in one buffer."""

    def __init__(self, vocabulary: Vocabulary, chunks: list[bytes]):
        self.vocabulary, self.chunks = vocabulary, chunks
        self.sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        self.first = np.cumsum(self.sizes) - self.sizes
        text = np.frombuffer(b"".join(chunks), dtype=np.uint8)
        self.ends = self.first + self.sizes
        n, trie = len(text), vocabulary.trie
        stop = np.repeat(self.ends, self.sizes)
        lead = (text & 0xC0) != 0x80  # where a character begins
        begin = np.flatnonzero(lead)
        char_end = np.append(begin[1:], n)
        char_end = np.minimum(char_end, stop[begin]) if n else char_end
        at, state = begin, np.zeros(len(begin), dtype=np.int64)
        from_, to, ids = [], [], []
        single = np.zeros(n, dtype=bool)
        for depth in range(trie.longest):
            inside = at + depth < stop[at]
            at, state = at[inside], state[inside]
            step = trie.base[state].astype(np.int64) + text[at + depth]
            known = trie.check[step] == state
            at, state = at[known], step[known]
            if not len(at):
                break
            piece = trie.value[state]
            full = piece >= 0
            from_.append(at[full])
            to.append(at[full] + depth + 1)
            ids.append(piece[full])
        if n:
            length = np.zeros(n, dtype=np.int64)
            length[begin] = char_end - begin
            for f, t in zip(from_, to, strict=True):
                one = t - f == length[f]
                single[f[one]] = True
            bare = ~single[begin]
            from_.append(begin[bare])
            to.append(char_end[bare])
            ids.append(np.full(int(bare.sum()), -1, dtype=np.int32))  # by bytes
        self.start = np.concatenate(from_) if from_ else np.empty(0, np.int64)
        self.to = np.concatenate(to) if to else np.empty(0, np.int64)
        self.ids = np.concatenate(ids) if ids else np.empty(0, np.int32)
        chunk = np.searchsorted(self.ends, self.start, side="right")
        # A node's number: chunks have one node more than bytes.
        self.node = self.start + chunk
        self.next = self.to + chunk
        self.source = self.first + np.arange(len(chunks))
        self.sink = self.ends + np.arange(len(chunks))
        self.n_nodes = n + len(chunks)
        offset = self.start - self.first[chunk] if len(chunks) else self.start
        self.short = self.sizes[chunk] <= SHORT if len(chunks) else np.empty(0, bool)
        span = self.to - self.start
        self.order = np.lexsort((span, offset))
        self.offset, self.span = offset, span

    def rounds(self):
        """Edges in groups: a group starts at one offset and has one length, so no two of its edges share a node.

        Edges of long chunks come last, one chunk after another, in order of their start.
        """
        order = self.order[self.short[self.order]]
        key = self.offset[order] * (1 << 20) + self.span[order]
        cuts = np.flatnonzero(np.diff(key)) + 1
        return np.split(order, cuts) if len(order) else []

    def long_edges(self) -> np.ndarray:
        rest = np.flatnonzero(~self.short)
        return rest[np.lexsort((self.to[rest], self.start[rest]))]

    def scores(self, piece_scores: np.ndarray | None = None, unknown: float | None = None) -> np.ndarray:
        """The log score of each edge."""
        v = self.vocabulary
        table = np.append(v.scores if piece_scores is None else piece_scores, v.unknown if unknown is None else unknown)
        return table[self.ids]

    def best(self) -> list[np.ndarray]:
        """Viterbi: the ids of the best segmentation of each chunk; of equal ones the first found."""
        score, best = self.scores(), np.full(self.n_nodes, -np.inf)
        best[self.source] = 0.0
        back = np.full(self.n_nodes, -1, dtype=np.int64)
        for edges in self.rounds():
            value, to = best[self.node[edges]] + score[edges], self.next[edges]
            up = value > best[to]
            best[to[up]], back[to[up]] = value[up], edges[up]
        far = self.long_edges()
        if len(far):
            b = best.tolist()
            for e, u, v, s in zip(far.tolist(), self.node[far].tolist(), self.next[far].tolist(), score[far].tolist(), strict=True):
                if b[u] + s > b[v]:
                    b[v] = b[u] + s
                    back[v] = e
        return self.walk(back)

    def walk(self, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all chunks, and how many each chunk has, from the best edge into each node."""
        owner, at = np.arange(len(self.chunks)), self.sink.copy()
        live = self.sizes > 0
        owner, at = owner[live], at[live]
        owners, edges = [], []
        while len(owner):
            e = back[at]
            owners.append(owner)
            edges.append(e)
            at = self.node[e]
            going = at > self.source[owner]
            owner, at = owner[going], at[going]
        if not edges:
            return np.empty(0, np.int32), np.zeros(len(self.chunks), np.int64)
        owner, edge = np.concatenate(owners), np.concatenate(edges)
        order = np.lexsort((self.start[edge], owner))
        owner, edge = owner[order], edge[order]
        ids = self.ids[edge]
        width = np.where(ids < 0, self.span[edge], 1)
        flat = np.repeat(ids, width)
        spelled = np.flatnonzero(flat < 0)
        if len(spelled):
            text = np.frombuffer(b"".join(self.chunks), dtype=np.uint8)
            nth = np.arange(len(flat)) - np.repeat(np.cumsum(width) - width, width)
            flat[spelled] = self.vocabulary.byte_ids[text[(np.repeat(self.start[edge], width) + nth)[spelled]]]
        return flat, np.bincount(owner, weights=width, minlength=len(self.chunks)).astype(np.int64)

    def forward(self, score: np.ndarray) -> np.ndarray:
        """Log sum over segmentations up to each node."""
        total = np.full(self.n_nodes, -np.inf)
        total[self.source] = 0.0
        for edges in self.rounds():
            to = self.next[edges]
            total[to] = np.logaddexp(total[to], total[self.node[edges]] + score[edges])
        far = self.long_edges()
        for e in far.tolist():
            u, v = self.node[e], self.next[e]
            total[v] = np.logaddexp(total[v], total[u] + score[e])
        return total

    def marginal(self, score: np.ndarray) -> np.ndarray:
        """The log of the summed weight of all segmentations of each chunk."""
        return self.forward(score)[self.sink]

    def posterior(self, score: np.ndarray) -> np.ndarray:
        """The probability of each edge given its chunk: forward times backward over the whole."""
        ahead = self.forward(score)
        after = np.full(self.n_nodes, -np.inf)
        after[self.sink] = 0.0
        for e in self.long_edges()[::-1].tolist():
            u, v = self.node[e], self.next[e]
            after[u] = np.logaddexp(after[u], after[v] + score[e])
        # Backwards: by end, not by start; edges of one start and length never share a start.
        for edges in self.rounds()[::-1]:
            at = self.node[edges]
            after[at] = np.logaddexp(after[at], after[self.next[edges]] + score[edges])
        chunk = np.searchsorted(self.ends, self.start, side="right")
        return np.exp(ahead[self.node] + score + after[self.next] - ahead[self.sink][chunk])
