"""Byte-level BPE: texts to token ids and back, by the ranks of a public vocabulary.

The distinct pieces of a batch are encoded together: pieces of like length lie
as rows in one padded matrix, and in every round each row merges its leftmost
pair of lowest rank. Pair ranks come from a hash table held in arrays; rows
without a pair left leave the matrix, and merged columns are closed up.

Defined cases: a NULL or empty text has no ids and decodes to no bytes; texts of
any length are encoded whole; equal rows give equal rows; an empty table gives an
empty one. Only the columns named by the caller are read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from tessella.llm.columns import lists, runs

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
NONE = np.int32(2**31 - 1)
KEPT_PIECES = 150_000
"""Encoded pieces a task keeps for later batches; beyond it starts anew."""
LONG_PIECE = 256
"""Bytes from which every occurrence of a row's best pair merges in one round."""


class Pairs:
    """(left id, right id) → id of the merged token, by open addressing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(8, int(len(left) * 3).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ids = np.full(1 << self.bits, NONE, np.int32)
        keys = (left.astype(np.int64) << 32) | right
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[slot[todo]] < 0
            won = np.zeros(len(todo), bool)
            spot, first = np.unique(slot[todo[free]], return_index=True)
            winner = np.flatnonzero(free)[first]
            won[winner] = True
            self.keys[spot], self.ids[spot] = keys[todo[winner]], merged[todo[winner]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        spread = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (spread >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, NONE where the pair does not merge."""
        keys = (left.astype(np.int64) << 32) | right
        slot = self._slot(keys)
        out = np.full(len(keys), NONE, np.int32)
        todo = np.arange(len(keys))
        while len(todo):
            held = self.keys[slot[todo]]
            same = held == keys[todo]
            out[todo[same]] = self.ids[slot[todo[same]]]
            todo = todo[~same & (held >= 0)]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        return out


class Vocabulary:
    """Tokens by rank, the pairs that merge, and the bytes of all tokens in one array."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        size = max(self.ids.values()) + 1
        self.tokens = [b""] * size
        for token, i in self.ids.items():
            self.tokens[i] = token
        self.single = np.full(256, -1, np.int32)
        for b in range(256):
            self.single[b] = self.ids[bytes([b])]
        found = [(self.ids[t[:k]], self.ids[t[k:]], i) for t, i in self.ids.items()
                 for k in range(1, len(t)) if t[:k] in self.ids and t[k:] in self.ids]
        left, right, merged = np.array(found, np.int64).reshape(-1, 3).T
        self.pairs = Pairs(left, right, merged.astype(np.int32))
        self.safe = np.ones(size, bool)
        """Tokens that only merge into tokens of higher rank."""
        self.safe[left[merged < left]] = False
        self.safe[right[merged < right]] = False
        self.length = np.array([len(t) for t in self.tokens], np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.length)))[:-1]
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece. A piece that is a token stays whole."""
        out: list = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            whole = self.ids.get(piece)
            if whole is not None:
                out[k] = np.array([whole], np.int32)
            else:
                buckets.setdefault((len(piece) + 3) // 4 if len(piece) <= 64 else 16 + len(piece).bit_length(),
                                   []).append(k)
        for rows in buckets.values():
            width = max(len(pieces[k]) for k in rows)
            step = max(1, (1 << 18) // width)
            for a in range(0, len(rows), step):
                self._merge([pieces[k] for k in rows[a:a + step]], rows[a:a + step], width, out)
        return out

    def _merge(self, pieces: list[bytes], rows: list[int], width: int, out: list) -> None:
        ids = np.full((len(pieces), width), -1, np.int32)
        size = np.array([len(p) for p in pieces])
        ids[np.arange(width) < size[:, None]] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = np.full((len(pieces), width), NONE, np.int32)
        pair = np.arange(width - 1) < size[:, None] - 1
        rank[:, :-1][pair] = self.pairs.find(ids[:, :-1][pair], ids[:, 1:][pair])
        row = np.array(rows)
        while len(row):
            at = rank.argmin(axis=1)
            line = np.arange(len(row))
            best = rank[line, at]
            done = best == NONE
            if done.any():
                for k in np.flatnonzero(done):
                    out[row[k]] = ids[k, :size[k]].copy()
                ids, rank, size, row = (x[~done] for x in (ids, rank, size, row))
                if not len(row):
                    return
                width = int(size.max())
                ids, rank, at, best = ids[:, :width], rank[:, :width], at[~done], best[~done]
                line = np.arange(len(row))
            if width >= LONG_PIECE:
                ids, rank, size = self._merge_all(ids, rank, size, best, at)
                width = ids.shape[1]
                continue
            spot = np.arange(width)
            take = np.minimum(spot + (spot > at[:, None]), width - 1)
            ids, rank = np.take_along_axis(ids, take, 1), np.take_along_axis(rank, take, 1)
            size = size - 1
            ids[line, at] = best
            ids[line, size], rank[line, size] = -1, NONE
            rank[line, size - 1] = NONE
            for k, near in ((at - 1, at > 0), (at, at < size - 1)):
                rank[line[near], k[near]] = self.pairs.find(ids[line[near], k[near]], ids[line[near], k[near] + 1])

    def _merge_all(self, ids: np.ndarray, rank: np.ndarray, size: np.ndarray, best: np.ndarray, at: np.ndarray):
        """All occurrences of each row's best pair, from the left and without overlap:
        a safe merged token makes no pair that would come before the rest. For
        other tokens the leftmost occurrence alone."""
        hit = rank == best[:, None]
        hit &= self.safe[best][:, None] | (np.arange(ids.shape[1]) == at[:, None])
        start = hit & ~np.concatenate((np.zeros((len(hit), 1), bool), hit[:, :-1]), axis=1)
        spot = np.arange(ids.shape[1])
        first = np.maximum.accumulate(np.where(start, spot, 0), axis=1)
        hit &= (spot - first) % 2 == 0  # every second one of a stretch a a a a
        ids = np.where(hit, best[:, None], ids)
        gone = np.concatenate((np.zeros((len(hit), 1), bool), hit[:, :-1]), axis=1)
        size = size - hit.sum(axis=1)
        keep = ~gone & (ids >= 0)
        width = int(size.max())
        out = np.full((len(ids), width), -1, np.int32)
        live = np.arange(width) < size[:, None]
        out[live] = ids[keep]
        rank = np.full((len(ids), width), NONE, np.int32)
        if width > 1:
            pair = live[:, 1:]
            rank[:, :-1][pair] = self.pairs.find(out[:, :-1][pair], out[:, 1:][pair])
        return out, rank, size

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of each row of ids."""
        length = self.length[ids]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        source = np.arange(total) + np.repeat(self.start[ids] - (ends - length), length)
        data = self.bytes[source].tobytes()
        at = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]
        return [data[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodes texts and remembers the pieces it has met."""

    def __init__(self, path: str, pattern: str):
        self.words = vocabulary(path)
        self.pattern = regex.compile(pattern)
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.counts = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)
        self.spelled: list[str] = []

    def _learn(self, pieces: list[str]) -> None:
        ids = self.words.encode_pieces([p.encode() for p in pieces])
        counts = np.array([len(x) for x in ids], np.int64)
        base = len(self.flat)
        for piece in pieces:
            self.place[piece] = len(self.place)
        self.starts = np.concatenate((self.starts, base + np.cumsum(counts) - counts))
        self.counts = np.concatenate((self.counts, counts))
        self.flat = np.concatenate((self.flat, *ids))
        self.spelled += [",".join(map(str, x.tolist())) for x in ids]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Flat ids, the number of ids of each text, and each text's ids as decimals."""
        if len(self.place) > KEPT_PIECES:
            self._forget()
        split = [self.pattern.findall(t) if t else [] for t in texts]
        new = set().union(*split).difference(self.place) if split else set()
        if new:
            self._learn(sorted(new))
        place = [list(map(self.place.__getitem__, s)) for s in split]
        decimals = [",".join(map(self.spelled.__getitem__, p)) for p in place]
        which = np.fromiter(itertools.chain.from_iterable(place), np.int64, sum(map(len, place)))
        counts = self.counts[which]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.flat[np.arange(total) + np.repeat(self.starts[which] - (ends - counts), counts)]
        pieces = np.concatenate(([0], np.cumsum([len(p) for p in place]))).astype(np.int64)
        per_text = np.diff(np.concatenate(([0], ends))[pieces])
        return flat, per_text, decimals


def _source(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    return docs.select(*[docs[c] for c in keep], docs[text].alias("_text"))


def encode(docs: DataFrame, text: str = "text", keep: list[str] | None = None, path: str = RANKS,
           pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """The kept columns and `ids array<int>`."""
    source = _source(docs, text, keep or ["doc_id"])
    names = source.columns[:-1]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, pattern)
        for batch in batches:
            for part in runs(batch, "_text"):
                flat, counts, _ = encoder.encode(part.column(len(names)).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], lists(flat, counts, pa.int32())], names=[*names, "ids"])

    return source.mapInArrow(work, f"{schema}, ids array<int>")


def decode(encoded: DataFrame, path: str = RANKS) -> DataFrame:
    """`ids` back to the text they spell, in column `text`; bytes that are no UTF-8 become U+FFFD."""
    names = [c for c in encoded.columns if c not in ("ids", "text")]
    source = encoded.select(*names, "ids")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            held = batch.column(len(names))
            counts = np.array([len(x) if x.is_valid else 0 for x in held], np.int64)
            texts = words.decode(held.flatten().to_numpy(zero_copy_only=False), counts)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())],
                names=[*names, "text"])

    return source.mapInArrow(work, f"{schema}, text string" if schema else "text string")


def digest(docs: DataFrame, text: str = "text", path: str = RANKS,
           pattern: str = public_tokenizers.PATTERN, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) and, if wanted, ids: every text
    is encoded, and the bytes hashed last are decoded from its ids."""
    source = _source(docs, text, ["doc_id"])
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, pattern)
        for batch in batches:
            for part in runs(batch, "_text"):
                flat, counts, decimals = encoder.encode(part.column(1).to_pylist())
                back = encoder.words.decode(flat, counts)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(counts, pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decimals]),
                    pa.array([hashlib.sha256(x).hexdigest() for x in back]),
                    *([lists(flat, counts, pa.int32())] if with_ids else [])], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(work, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
                             + (", ids array<int>" if with_ids else ""))
