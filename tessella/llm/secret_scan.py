"""Secrets in texts: fixed patterns, and two character Markov models.

Two models of the next character given the last one are trained on the corpus
itself: one on strings that the patterns label as secrets, together with the
values behind key words, the other on the ordinary words and identifiers outside
of them. A run of key characters whose log-likelihood ratio, in total and per
character, is above the thresholds is reported as kind `markov`, unless a pattern
already covers it. Patterns always stay.

Spans are half open and count code points. The span of an `assign` match is the
whole match, key word included; its value is group 2.

Defined cases: a NULL or empty text has no spans; very long texts are searched
whole; equal rows give equal rows; with no labelled secret in the table the
random model is the uniform one, with no ordinary word the other is; an empty
table gives an empty result. Only the two named columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base patterns and the least lengths of what they match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ["assign", "access", "hex", "markov"]

KEY_WORDS = ("passw", "secret", "token", "key")
"""One of these is in every lower-cased text that ASSIGN matches."""
LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
MIXED = re.compile(r"[A-Za-z][^A-Za-z]*[0-9]|[0-9][^0-9]*[A-Za-z]")
"""Random keys of this length hold letters and digits."""
ORDINARY = re.compile(r"[A-Za-z0-9+/_=-]{6,}")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
START = len(ALPHABET)
SIZE = START + 1
CODE = np.full(128, START, np.int64)
CODE[[ord(c) for c in ALPHABET]] = np.arange(START)

UNIFORM = (0.5, 0.1)
"""Share of the uniform distribution in the random and in the ordinary model: keys
use characters that the labelled ones may lack, words much less so."""
LEAST_RATIO = 20.0
"""Nats by which the random model must lead over a whole candidate."""
LEAST_PER_CHARACTER = 0.8


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """What the fixed patterns find."""
    found = []
    low = text.lower()
    if any(w in low for w in KEY_WORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text)
                  if len(m.group(2)) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)
                  if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), m.end(), "hex") for m in LONG_HEX.finditer(text)]
    return found


def _labelled(text: str) -> tuple[list[str], list[str]]:
    """(secret strings, ordinary strings) of one text."""
    spans = base_spans(text)
    secret = []
    for a, b, kind in spans:
        value = ASSIGN.match(text, a).group(2) if kind == "assign" else text[a:b]
        if kind != "assign" or CANDIDATE.fullmatch(value):
            secret.append(value)
    edge, rest = 0, []
    for a, b, _ in sorted(spans):
        rest.append(text[edge:max(edge, a)])
        edge = max(edge, b)
    rest.append(text[edge:])
    return secret, [w for part in rest for w in ORDINARY.findall(part)]


def pair_counts(strings: list[str]) -> np.ndarray:
    """How often each character follows each other one, or starts a string."""
    if not strings:
        return np.zeros(SIZE * SIZE, np.int64)
    codes = CODE[np.frombuffer((" " + " ".join(strings)).encode("ascii"), np.uint8)]
    keep = codes[1:] != START
    return np.bincount(codes[:-1][keep] * SIZE + codes[1:][keep], minlength=SIZE * SIZE)


def train(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Log-likelihood ratio of every character pair, random over ordinary, counted
    over all texts. Each task sends one row per pair it met, at most 2 * 68^2."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, SIZE * SIZE), np.int64)
        for batch in batches:
            both = [_labelled(t) for t in batch["_text"] if t]
            for k in (0, 1):
                total[k] += pair_counts([w for pair in both for w in pair[k]])
        side, pair = np.nonzero(total)
        yield pd.DataFrame({"side": side, "pair": pair, "n": total[side, pair]})

    rows = (docs.select(docs[text].alias("_text")).mapInPandas(count, "side long, pair long, n long")
            .groupBy("side", "pair").agg(F.sum("n").alias("n")).collect())
    counts = np.zeros((2, SIZE, SIZE))
    for side, pair, n in rows:
        counts[side, pair // SIZE, pair % SIZE] += n
    return log_ratio(counts)


def log_ratio(counts: np.ndarray) -> np.ndarray:
    """Pair counts of both sides → log chance of a character after another one,
    random less ordinary; after a character that a side never met, uniform."""
    counts = counts[:, :, :START]
    total = counts.sum(axis=2, keepdims=True)
    met = np.divide(counts, total, out=np.full_like(counts, 1 / START), where=total > 0)
    share = np.array(UNIFORM)[:, None, None]
    chance = np.log((1 - share) * met + share / START)
    return chance[0] - chance[1]


def markov_spans(text: str, ratio: np.ndarray, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Candidates that the models call random and no pattern covers."""
    out = []
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        if (a and text[a - 1].isalnum()) or (b < len(text) and text[b].isalnum()):
            continue  # a piece of a longer word in other letters
        if any(x < b and a < y for x, y, _ in taken) or not MIXED.search(m.group()):
            continue
        codes = np.concatenate(([START], CODE[np.frombuffer(m.group().encode("ascii"), np.uint8)]))
        score = float(ratio[codes[:-1], codes[1:]].sum())
        if score >= LEAST_RATIO and score >= LEAST_PER_CHARACTER * (b - a):
            out.append((a, b, "markov"))
    return out


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns and `spans array<struct<kind, start, end>>`, by start and
    then kind in the order of KINDS."""
    keep = keep or ["doc_id"]
    ratio = docs.sparkSession.sparkContext.broadcast(train(docs, text))  # 68 x 67 numbers
    source = docs.select(*[docs[c] for c in keep], docs[text].alias("_text"))
    order = {kind: k for k, kind in enumerate(KINDS)}

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            spans = []
            for t in batch["_text"]:
                found = base_spans(t) if t else []
                if t:
                    found += markov_spans(t, ratio.value, found)
                found.sort(key=lambda s: (s[0], order[s[2]]))
                spans.append([{"kind": k, "start": a, "end": b} for a, b, k in found])
            yield batch.drop(columns="_text").assign(spans=spans)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1])
    return source.mapInPandas(find, f"{schema}, spans array<struct<kind:string,start:int,end:int>>")


def digest(scanned: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov)."""
    def spelled(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s.kind != "markov")
    return scanned.select("doc_id", *[count(k) for k in KINDS[:3]],
                          F.sha2(spelled(base), 256).alias("base_sha256"),
                          spelled(F.col("spans")).alias("spans"), count("markov"))
