"""Places of many terms in many texts: a trie walked from all bytes of the texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Widest alphabet for which a term is entered by its first three bytes in one step.
WIDEST = 128


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts (no nulls) one after the other, and where each begins, with the end of the last."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def cuts(ends: np.ndarray, rows: int, size: int) -> list[tuple[int, int]]:
    """Runs of at most so many rows and so many bytes (but one row at least) of rows that begin and end at ends."""
    out, lo, n = [], 0, len(ends) - 1
    while lo < n:
        hi = min(lo + rows, n, max(lo + 1, int(np.searchsorted(ends, ends[lo] + size, "right")) - 1))
        out.append((lo, hi))
        lo = hi
    return out


class Trie:
    def __init__(self, terms: list[str]) -> None:
        coded = [t.encode() for t in terms]
        self.length = np.array([len(t) for t in coded], np.int64)
        # terms that can overlap themselves
        self.bordered = np.array([any(t[:k] == t[-k:] for k in range(1, len(t))) for t in coded], bool)
        used = sorted({c for t in coded for c in t})
        width = len(used) + 1
        self.letter = np.zeros(256, np.int32)  # 0: in no term
        self.letter[used] = np.arange(1, width)
        place, nodes, of = self.letter.tolist(), [{}], {}
        for i, t in enumerate(coded):
            node = 0
            for c in t:
                after = nodes[node].get(place[c])
                if after is None:
                    after = nodes[node][place[c]] = len(nodes)
                    nodes.append({})
                node = after
            of[node] = i
        self.width = width
        self.term = np.full(len(nodes), -1, np.int64)
        self.term[list(of)] = list(of.values())
        after = np.zeros((len(nodes), width), np.int32)  # 0: no term goes on so
        for node, kids in enumerate(nodes):
            for c, k in kids.items():
                after[node, c] = k
        self.first = after[0]
        self.depth = min(int(self.length.min(initial=3)), 3 if width <= WIDEST else 2) if terms else 0
        for _ in range(self.depth - 1):
            # no letter after no node: its row would be that of the root
            self.first = np.where(self.first[:, None] > 0, after[self.first], 0).ravel()
        self.after = after.ravel()

    def found(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and term of each occurrence in the texts that begin and end there; of those that overlap, the first counts."""
        n = len(data) - self.depth + 1
        if not self.depth or n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        letters = self.letter[data]
        code = letters[:n]
        for d in range(1, self.depth):
            code = code * self.width + letters[d : n + d]
        state = self.first[code]
        at = np.flatnonzero(state)
        state, d = state[at], self.depth
        places, terms = [at[:0]], [at[:0]]
        while len(at):
            term = self.term[state]
            hit = term >= 0
            places.append(at[hit]), terms.append(term[hit])
            inside = at < len(data) - d
            if not inside.all():
                at, state = at[inside], state[inside]
            state = self.after[state * self.width + letters[at + d]]
            alive = np.flatnonzero(state)
            at, state, d = at[alive], state[alive], d + 1
        at, term = np.concatenate(places), np.concatenate(terms)
        row = np.searchsorted(ends, at, "right") - 1
        kept = at + self.length[term] <= ends[row + 1]  # not over the end of its text
        twice = np.flatnonzero(kept & self.bordered[term])
        kept[twice] = self._apart(at[twice], term[twice])
        return row[kept], term[kept]

    def _apart(self, at: np.ndarray, term: np.ndarray) -> np.ndarray:
        order = np.lexsort((at, term))
        at, term = at[order], term[order]
        kept = np.ones(len(at), bool)
        last = -1
        for i in np.flatnonzero((term[1:] == term[:-1]) & (np.diff(at) < self.length[term[1:]])):
            if kept[i]:
                last = i
            kept[i + 1] = at[i + 1] - at[last] >= self.length[term[last]]
        out = np.empty(len(at), bool)
        out[order] = kept
        return out
