"""64-bit hashes of words, lines and shingles, computed on whole byte buffers.

A stretch of bytes b(0) … b(m-1) hashes to mix(sum (b(i)+1) * P^i mod 2^64). Prefix
sums over the buffer give it for every stretch at once, wherever it starts.
Distinct values are taken as equal when their 64 bits are equal.
"""

from __future__ import annotations

import functools

import numpy as np

U = np.uint64
P = 0x9E3779B97F4A7C15 | 1
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits (finalizer with two multiplications)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def up(base: int) -> np.ndarray:
        out = np.full(n, base, U)
        out[0] = 1
        return np.multiply.accumulate(out)
    return up(P), up(pow(P, -1, 1 << 64))


def stretches(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of data[start:end] for every pair."""
    size = 1 << max(16, int(len(data)).bit_length())
    power, inverse = _powers(size)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * power[:len(data)], out=sums[1:])
    raw = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(raw ^ (U(seed) + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93)))


def tokens(data: np.ndarray, at: np.ndarray, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of every maximal run of bytes that are not breaks; a
    run ends at the end of its text."""
    if len(data) == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~breaks[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.concatenate(([False], inside[:-1])) & ~edge[:-1]
    after = np.concatenate((inside[1:], [False])) & ~edge[1:]
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(at, starts, side="right") - 1


def shingles(words: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, owner) of every run of `size` words of one owner, in order; an owner
    with fewer words has its whole sequence as one."""
    n = len(words)
    if n == 0:
        return words, owner
    weights = mix(np.arange(1, size + 1, dtype=U))
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    length = np.diff(np.concatenate((first, [n])))
    out, who = [], []
    if n >= size:
        total = np.zeros(n - size + 1, U)
        for j in range(size):
            total += words[j:n - size + 1 + j] * weights[j]
        whole = owner[size - 1:] == owner[:n - size + 1]
        out.append(total[whole])
        who.append(owner[:n - size + 1][whole])
    for m in range(1, size):
        at = first[length == m]
        if len(at):
            total = np.full(len(at), m, U)
            for j in range(m):
                total += words[at + j] * weights[j]
            out.append(total)
            who.append(owner[at])
    value, who = mix(np.concatenate(out)), np.concatenate(who)
    order = np.argsort(who, kind="stable")
    return value[order], who[order]
