"""Many words found in one pass: a trie with failure links, run over a whole batch.

The automaton is a handful of arrays: a hash table of edges (state, symbol) → state, the
failure link of each state, the word that ends there and the next shorter one. Texts are
laid out as one line of symbols with a mark between them and cut into lanes that overlap by
the longest word; all lanes step together, so a step is a few array operations.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LANE = 192
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
RUN_CHARACTERS = 1 << 20
"""Texts are worked on in runs of about so many characters."""
LAST_CODE = 0x10FFFF
DENSE_CELLS = 1 << 21
"""Cells (state, symbol) up to which every step of an automaton is laid out as a table, failure links followed."""


def characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, a mark after each, and where each text starts (one more
    than there are texts); NULL is empty."""
    parts = [(t or "") for t in texts.to_pylist()]
    line = "\x00".join(parts) + "\x00" if parts else ""
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in parts], out=starts[1:])
    return codes, starts


def runs(texts: pa.Array, limit: int = RUN_CHARACTERS) -> Iterator[pa.Array]:
    """The array in slices of about `limit` characters; one longer text is a slice alone."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    size = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(texts):
        before = size[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(size, before + limit, side="right")))
        yield texts.slice(first, last - first)
        first = last


class Automaton:
    """Finds words; a word is known by its place in `words`, which are distinct and not
    empty."""

    def __init__(self, words: Iterable[str]):
        self.words = [w for w in dict.fromkeys(words) if w]
        self.length = np.array([len(w) for w in self.words], np.int64)
        self.longest = int(self.length.max(initial=1))
        self.codes = np.array(sorted({ord(c) for w in self.words for c in w}), np.uint32)
        symbol = {int(c): i + 1 for i, c in enumerate(self.codes)}
        self.symbols = len(symbol) + 1  # 0: any other character
        edges: list[dict[int, int]] = [{}]
        ends, depth, order = [-1], [0], [(0, 0, 0)]
        for k, w in enumerate(self.words):
            state = 0
            for c in w:
                s = symbol[ord(c)]
                if s not in edges[state]:
                    edges[state][s] = len(edges)
                    order.append((depth[state] + 1, state, s))
                    edges.append({})
                    ends.append(-1)
                    depth.append(depth[state] + 1)
                state = edges[state][s]
            ends[state] = k
        fail, shorter = [0] * len(edges), [0] * len(edges)
        for _, parent, s in sorted(order[1:]):
            state = edges[parent][s]
            f = fail[parent]
            while f and s not in edges[f]:
                f = fail[f]
            f = edges[f].get(s, 0) if parent else 0
            fail[state] = f
            shorter[state] = f if ends[f] >= 0 else shorter[f]
        self.ends, self.fail, self.shorter = (np.array(x, np.int32) for x in (ends, fail, shorter))
        self.depth = np.array(depth, np.int32)
        self.hit = (self.ends >= 0) | (self.shorter > 0)
        self._table([(p * self.symbols + s, t) for p, e in enumerate(edges) for s, t in e.items()])

    def _table(self, edges: list[tuple[int, int]]) -> None:
        bits = max(4, (2 * len(edges)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.to = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        for key, state in edges:
            at = self._slot(np.array([key]))[0]
            while self.keys[at] >= 0:
                at = (at + 1) & self.mask
            self.keys[at], self.to[at] = key, state

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * MULTIPLIER) >> self.shift).astype(np.int64)

    def _follow(self, key: np.ndarray) -> np.ndarray:
        """The state that an edge leads to, -1 where there is none."""
        at = self._slot(key)
        held = self.keys[at]
        out = np.where(held == key, self.to[at], -1)
        left = np.flatnonzero((held != key) & (held >= 0))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            held = self.keys[at[left]]
            same = held == key[left]
            out[left[same]] = self.to[at[left[same]]]
            left = left[~same & (held >= 0)]
        return out

    def _symbols(self, codes: np.ndarray) -> np.ndarray:
        if "_of" not in self.__dict__:
            self._of = np.zeros(LAST_CODE + 1, np.int32)
            self._of[self.codes] = np.arange(1, len(self.codes) + 1)
        return self._of[codes]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_of", "_next")}

    def _steps(self) -> np.ndarray | None:
        """The next state of every state and symbol, for small automata: a step is one look-up."""
        if len(self.ends) * self.symbols > DENSE_CELLS:
            return None
        if "_next" not in self.__dict__:
            edge = np.flatnonzero(self.keys >= 0)
            parent, symbol = np.divmod(self.keys[edge], self.symbols)
            steps = np.zeros((len(self.ends), self.symbols), np.int32)
            for d in range(int(self.depth.max()) + 1):
                own = np.flatnonzero(self.depth == d)
                if d:
                    steps[own] = steps[self.fail[own]]
                below = self.depth[parent] == d
                steps[parent[below], symbol[below]] = self.to[edge[below]]
            self._next = steps.ravel()
        return self._next

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, word) of every occurrence, overlapping ones too, by start."""
        n = len(codes)
        if not n or not self.words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lanes, width = -(-n // LANE), LANE + self.longest - 1
        line = np.zeros(lanes * LANE + self.longest, np.int32)
        line[:n] = self._symbols(codes)
        columns = np.ascontiguousarray(np.lib.stride_tricks.as_strided(line, (width, lanes), (4, 4 * LANE)))
        state = np.zeros(lanes, np.int64)
        steps = self._steps()
        hits = []
        for j in range(width):
            symbol = columns[j]
            if steps is not None:
                state = steps[state * self.symbols + symbol].astype(np.int64)
                found = np.flatnonzero(self.hit[state])
                if len(found):
                    hits.append((found, np.full(len(found), j + 1), state[found]))
                continue
            new = np.where(symbol > 0, self._follow(state * self.symbols + symbol), 0)
            lost = np.flatnonzero(new < 0)
            while len(lost):
                at_root = state[lost] == 0
                new[lost[at_root]] = 0
                lost = lost[~at_root]
                state[lost] = self.fail[state[lost]]
                new[lost] = self._follow(state[lost] * self.symbols + symbol[lost])
                lost = lost[new[lost] < 0]
            state = new.astype(np.int64)
            found = np.flatnonzero(self.hit[state])
            if len(found):
                hits.append((found, np.full(len(found), j + 1), state[found]))
        if not hits:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lane, column, state = (np.concatenate(x) for x in zip(*hits))
        starts, words = [], []
        while len(state):
            word = self.ends[state]
            first = column - self.length[word]
            own = (word >= 0) & (first >= 0) & (first < LANE)  # else it starts in another lane
            starts.append((lane * LANE + first)[own])
            words.append(word[own])
            more = self.shorter[state] > 0
            lane, column, state = lane[more], column[more], self.shorter[state[more]]
        start, word = np.concatenate(starts), np.concatenate(words).astype(np.int64)
        order = np.lexsort((word, start))
        return start[order], word[order]


def apart(text: np.ndarray, start: np.ndarray, word: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which occurrences a search from left to right takes, for each word and text: those
    that do not overlap one taken before."""
    order = np.lexsort((start, word, text))
    t, s, w = text[order], start[order], word[order]
    near = np.zeros(len(s), bool)
    near[1:] = (t[1:] == t[:-1]) & (w[1:] == w[:-1]) & (s[1:] - s[:-1] < length[w[1:]])
    taken = np.ones(len(s), bool)
    for i in np.flatnonzero(near):  # few words overlap themselves
        k = i - 1
        while not taken[k]:
            k -= 1
        taken[i] = s[i] - s[k] >= length[w[i]]
    out = np.zeros(len(s), bool)
    out[order] = taken
    return out
