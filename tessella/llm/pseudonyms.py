"""Format-preserving pseudonyms for personal data.

Numbers and dates that pass their validation are replaced by others of the same
format, which pass it too. Each format is a range 0 … n-1 of all its valid values,
and a keyed Feistel network permutes that range: its halves are the quotient and the
remainder by a number near the square root of n, and results outside of the range are
permuted again (cycle walking). Equal values get equal pseudonyms in every
document, different values different ones, and whoever holds the key can turn
them back.

kind   | validated by                          | permuted
email  | local@labels.tld                      | letters and digits of the local part
card   | 13 to 19 digits, Luhn                 | all digits but the check digit
iban   | two letters, modulo 97                | letters and digits of the account
ssn    | ddd-dd-dddd, assigned areas           | all valid numbers
phone  | + and 8 to 15 digits, or (ddd) ddd-dddd | digits after the country's first
ip     | four octets                           | all four
date   | ISO, d.m.y or m/d/y, in the calendar  | days of 1900 to 2099, or of the years around

Defined cases: NULL stays NULL; a text without such data is unchanged; numbers that
fail their validation are left alone; of overlapping finds the one that starts first
stays, and of those the first in the table; long texts are read whole; equal rows give
equal rows; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
DEMO_KEY = b"tessella demonstration key"
"""For the registered query; callers bring their own."""
KINDS = ["email", "card", "iban", "ssn", "phone", "ip", "date"]
LETTERS = "abcdefghijklmnopqrstuvwxyz"
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


class Permutation:
    """A keyed permutation of 0 … n-1 for each n and tweak, and its inverse."""

    def __init__(self, key: bytes):
        self.key = hashlib.sha256(key).digest()

    def _round(self, k: int, half: int, below: int, tweak: str) -> int:
        size = (below.bit_length() + 7) // 8 + 16  # 128 spare bits leave no bias
        data = b"%b|%d|%b|%d|%d" % (self.key, k, tweak.encode(), below, half)
        return int.from_bytes(hashlib.shake_256(data).digest(size), "big") % below

    def _once(self, x: int, n: int, tweak: str, back: bool) -> int:
        width = math.isqrt(n - 1) + 1
        height = -(-n // width)
        a, b = divmod(x, width)  # a below height, b below width
        for k in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
            sign = -1 if back else 1
            if k % 2 == 0:
                a = (a + sign * self._round(k, b, height, tweak)) % height
            else:
                b = (b + sign * self._round(k, a, width, tweak)) % width
        return a * width + b

    def __call__(self, x: int, n: int, tweak: str, back: bool = False) -> int:
        if n < 2:
            return x
        x = self._once(x, n, tweak, back)
        while x >= n:
            x = self._once(x, n, tweak, back)
        return x


def check_digit(body: str) -> str:
    """Luhn."""
    total = sum(d if k % 2 else sum(divmod(2 * d, 10)) for k, d in enumerate(map(int, reversed(body))))
    return str(-total % 10)


def put_digits(form: str, digits: str) -> str:
    """The form with its digits replaced in order."""
    new = iter(digits)
    return "".join(next(new) if c.isdigit() else c for c in form)


def permute_characters(text: str, permute: Permutation, tweak: str, back: bool) -> str:
    """ASCII letters and digits in mixed radix; case and everything else stay."""
    alphabets = [LETTERS if c.isascii() and c.isalpha() else "0123456789" if c.isascii() and c.isdigit() else ""
                 for c in text]
    x, n = 0, 1
    for c, alphabet in zip(text, alphabets):
        if alphabet:
            x, n = x * len(alphabet) + alphabet.index(c.lower()), n * len(alphabet)
    shape = "".join("a" if len(a) == 26 else "0" if a else c for a, c in zip(alphabets, text))
    x = permute(x, n, f"{tweak} {shape}", back)
    out = []
    for c, alphabet in zip(reversed(text), reversed(alphabets)):
        if alphabet:
            x, k = divmod(x, len(alphabet))
            c = alphabet[k].upper() if c.isupper() else alphabet[k]
        out.append(c)
    return "".join(reversed(out))


def _email(m: re.Match, permute: Permutation, back: bool) -> str:
    local, domain = m.group().rsplit("@", 1)
    # Case does not tell addresses apart, so it is no part of the value.
    return f"{permute_characters(local, permute, f'email {domain.lower()}', back)}@{domain}"


def _card(m: re.Match, permute: Permutation, back: bool) -> str | None:
    digits = re.sub(r"\D", "", m.group())
    if not 13 <= len(digits) <= 19 or check_digit(digits[:-1]) != digits[-1]:
        return None
    size = len(digits) - 1
    body = str(permute(int(digits[:-1]), 10 ** size, f"card {size}", back)).zfill(size)
    return put_digits(m.group(), body + check_digit(body))


def _iban(m: re.Match, permute: Permutation, back: bool) -> str | None:
    value = m.group().replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(value) <= 34 or number(value[4:] + value[:4]) % 97 != 1:
        return None
    account = permute_characters(value[4:], permute, f"iban {value[:2]}", back)
    new = iter(f"{value[:2]}{98 - number(account + value[:2] + '00') % 97:02d}{account}")
    return "".join(c if c == " " else next(new) for c in m.group())


def _ssn(m: re.Match, permute: Permutation, back: bool) -> str | None:
    area, group, serial = map(int, m.group().split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    x, serial = divmod(permute(x, 898 * 99 * 9999, "ssn", back), 9999)
    area, group = divmod(x, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _phone(m: re.Match, permute: Permutation, back: bool) -> str | None:
    digits = re.sub(r"\D", "", m.group())
    keep = 1 if m.group()[0] == "+" else 0  # the country's zone
    if not (8 <= len(digits) <= 15 if keep else len(digits) == 10):
        return None
    size = len(digits) - keep
    # With or without the country code, a ten-digit number is one value.
    tweak = "phone 1 10" if not keep else f"phone {digits[0]} {size}"
    return put_digits(m.group(), digits[:keep] + str(permute(int(digits[keep:]), 10 ** size, tweak, back)).zfill(size))


def _ip(m: re.Match, permute: Permutation, back: bool) -> str | None:
    parts = m.group().split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    x = permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "ip", back)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _date(m: re.Match, permute: Permutation, back: bool) -> str | None:
    mark = re.search(r"\D", m.group()).group()
    a, b, c = m.group().split(mark)
    year, month, day = {"-": (a, b, c), ".": (c, b, a), "/": (c, a, b)}[mark]
    try:
        at = datetime.date(int(year), int(month), int(day)).toordinal()
    except ValueError:
        return None
    last = datetime.date(9999, 12, 31).toordinal()
    low, high = next((p, q) for p, q in ((1, FIRST_DAY - 1), (FIRST_DAY, LAST_DAY), (LAST_DAY + 1, last)) if p <= at <= q)
    new = datetime.date.fromordinal(low + permute(at - low, high - low + 1, f"date {low}", back))
    year, month, day = f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}"
    return mark.join({"-": (year, month, day), ".": (day, month, year), "/": (month, day, year)}[mark])


Rule = Callable[[re.Match, Permutation, bool], str | None]
RULES: dict[str, tuple[re.Pattern, Rule]] = {
    "email": (re.compile(r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?!\w)", re.A), _email),
    "card": (re.compile(r"(?<![\w.+-])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})"
                        r"(?![\w-]|\.[0-9])"), _card),
    "iban": (re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?!\w)"), _iban),
    "ssn": (re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"), _ssn),
    "phone": (re.compile(r"(?<![\w+])(?:(?:\+1[ .-]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}"
                         r"|\+1[ .-]?[0-9]{3}[ .-]?[0-9]{3}[ .-]?[0-9]{4}|\+[2-9](?:[ .-]?[0-9]){7,14})(?![\w-])"), _phone),
    "ip": (re.compile(r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w|\.[0-9])"), _ip),
    "date": (re.compile(r"(?<![\w./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})"
                        r"(?!\w|[./-][0-9])"), _date),
}
SUSPECT = re.compile(r"[0-9@]")


def replace(text: str, permute: Permutation, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, end) of each in the text given."""
    if not SUSPECT.search(text):
        return text, []
    found = [(m.start(), k, m, kind) for k, kind in enumerate(KINDS) for m in RULES[kind][0].finditer(text)]
    out, spans, edge = [], [], 0
    for start, _, m, kind in sorted(found, key=lambda f: f[:2]):
        if start < edge:
            continue
        new = RULES[kind][1](m, permute, back)
        if new is None:
            continue
        out += [text[spans[-1][2] if spans else 0:start], new]
        spans.append((kind, start, m.end()))
        edge = m.end()
    return ("".join(out) + text[edge:], spans) if spans else (text, [])


@functools.lru_cache(maxsize=4)
def _permutation(key: bytes) -> Permutation:
    return Permutation(key)


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", keep: list[str] | None = None,
                 back: bool = False) -> DataFrame:
    """The kept columns, `text` with pseudonyms, and `spans array<struct<kind, start,
    end>>` of what was replaced, in code points of the text given. `back` turns the
    pseudonyms into the values again."""
    source = docs.select(*[docs[c] for c in keep or ["doc_id"]], docs[text].alias("_text"))
    names = source.columns[:-1]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        permute = _permutation(key)
        for batch in batches:
            done = [(t, []) if t is None else replace(t, permute, back) for t in batch["_text"]]
            yield batch[names].assign(text=[t for t, _ in done], spans=[
                [{"kind": k, "start": a, "end": b} for k, a, b in s] for _, s in done])
    return source.mapInPandas(work, f"{schema}, text string, spans array<struct<kind:string,start:int,end:int>>")


def report(docs: DataFrame, key: bytes = DEMO_KEY) -> DataFrame:
    """(doc_id, text, n_<kind> …, spans): every document with its pseudonyms."""
    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    spelled = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    return pseudonymise(docs, key).select("doc_id", "text", *map(count, KINDS), spelled.alias("spans"))
