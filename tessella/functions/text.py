"""Column expressions over text. All of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes, written so that Java and RE2 agree.
CJK = r"[\x{4e00}-\x{9fff}]"
CJK_NARROW = r"[\x{4e00}-\x{9fa5}]"
LATIN = r"[a-zA-Z]"
SPACE_SET = (r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
             r"\x{202f}\x{205f}\x{3000}")
SPACE = f"[{SPACE_SET}]"
ODD_SPACE = f"[{SPACE_SET}&&[^ ]]"
NON_SPACE = f"[^{SPACE_SET}]"
PUNCTUATION = (r"[!-/:-@\[-`{-~\x{3000}-\x{303f}\x{ff00}-\x{ffef}\x{2000}-\x{206f}\x{b7}]")
WORD_RUNS = r"[\x{4e00}-\x{9fff}]+|[a-zA-Z0-9\x{c0}-\x{24f}]+"
WORD_LETTER = r"[a-zA-Z\x{c0}-\x{24f}\x{4e00}-\x{9fff}]"
SENTENCE_END = r"[.!?]+"
PARAGRAPH_GAP = rf"\n{SPACE}*\n"
TAG = r"<[^>]+>"


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _closed(pattern: str, at: int) -> int:
    """The place behind the class or group that opens at `at`."""
    if pattern[at] == "[":
        end = at + 2
        while pattern[end] != "]":
            end += 2 if pattern[end] == "\\" else 1
        return end + 1
    end = at + 1
    while pattern[end] != ")":
        end = _closed(pattern, end) if pattern[end] in "([" else end + (2 if pattern[end] == "\\" else 1)
    return end + 1


def _atoms(pattern: str) -> list[str]:
    out, at = [], 0
    while at < len(pattern):
        end = _closed(pattern, at) if pattern[at] in "([" else pattern.index("}", at) + 1 if pattern[at] == "{" else (
            at + (2 if pattern[at] == "\\" else 1))
        out.append(pattern[at:end])
        at = end
    return out


def needed(pattern: str) -> tuple[str, ...]:
    """Strings of which every match of a regular expression holds one; none if it has no
    such strings, or flags. The longest part of it decides: searching a text for a few
    strings is many times faster than matching."""
    atoms = _atoms(pattern)
    if "|" in atoms:
        cuts = [-1, *[k for k, a in enumerate(atoms) if a == "|"], len(atoms)]
        each = [needed("".join(atoms[a + 1:b])) for a, b in zip(cuts, cuts[1:])]
        found = {x for e in each for x in e} if all(each) else set()
        return tuple(sorted(x for x in found if not any(y != x and y in x for y in found)))
    best: tuple[str, ...] = ()
    run = ""

    def offer(strings: tuple[str, ...]) -> None:
        nonlocal best
        if min(map(len, strings), default=0) > min(map(len, best), default=0):
            best = strings
    for k, atom in enumerate(atoms):
        after = atoms[k + 1] if k + 1 < len(atoms) else ""
        optional = after in ("?", "*") or after.startswith("{0")
        plain = atom[-1] if len(atom) == 1 and atom not in ".^$?*+" or len(atom) == 2 and atom[0] == "\\" and not atom[1].isalnum() else ""
        if plain and not optional:
            run += plain
        if not plain or optional or after == "+" or after.startswith("{"):
            offer((run,) if run else ())
            run = ""
        if atom.startswith("(?") and not atom.startswith(("(?:", "(?<", "(?!", "(?=")):
            return ()
        if atom[0] == "(" and not optional and not atom.startswith(("(?<", "(?!", "(?=")):
            offer(needed(atom[1:-1].removeprefix("?:")))
    offer((run,) if run else ())
    return best


def holds(text: Column, pattern: str, most: int = 8, lowered: bool = False) -> Column | None:
    """Whether a text holds what a pattern needs; no answer if that is nothing or many strings."""
    strings = sorted({x.lower() if lowered else x for x in needed(pattern)})
    if not 0 < len(strings) <= most:
        return None
    out = F.contains(text, F.lit(strings[0]))
    for x in strings[1:]:
        out = out | F.contains(text, F.lit(x))
    return out


def ahead(pattern: str) -> str:
    """A pattern that begins with a word bound or a look back, with a look at its first character put
    before, which is many times cheaper to try at every place of a text; others as they are."""
    atoms = _atoms(pattern)
    k = next((k for k, a in enumerate(atoms) if a != r"\b" and not a.startswith("(?<")), 0)
    if not k or "|" in atoms:
        return pattern
    first, after = atoms[k], atoms[k + 1] if k + 1 < len(atoms) else ""
    if first.startswith("(?:"):
        heads = [a[:1] for a in first[3:-1].split("|")]
        first = "[" + "".join(sorted(set(heads))) + "]" if all(h.isalnum() for h in heads) else ""
    if not (first.startswith("[") or first in (r"\d", r"\s")) or after in ("?", "*") or after.startswith("{0"):
        return pattern
    return f"(?={first}){pattern}"


def first_letters(words: str) -> str:
    """Alternatives put together by their first letter, in their order, so that one character chooses among them."""
    by: dict[str, list[str]] = {}
    for w in words.split("|"):
        by.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by.items())


def by_first(pattern: str) -> str:
    """A pattern whose last group, of words, is put together by first letters."""
    head, tail = pattern.rsplit("(?:", 1)
    words, end = tail.split(")", 1)
    return f"{head}(?:{first_letters(words)}){end}"


def language_by_ratio(text: Column) -> Column:
    """Above 0.7 CJK share chinese, below 0.3 english, in between mixed."""
    cjk, latin = count(text, CJK), count(text, LATIN)
    share = cjk / (cjk + latin)
    return (F.when(cjk + latin == 0, "unknown").when(share > 0.7, "chinese")
            .when(share < 0.3, "english").otherwise("mixed"))


def language_by_threshold(text: Column, threshold: float = 0.3) -> Column:
    cjk, latin = count(text, CJK), count(text, LATIN)
    return F.when((cjk + latin > 0) & (cjk / (cjk + latin) > threshold),
                  "chinese").otherwise("english")


def language_by_majority(text: Column) -> Column:
    """Letters are counted only where both scripts occur."""
    mixed = F.when(count(text, CJK_NARROW) >= count(text, LATIN), "chinese").otherwise("english")
    return F.when(text.rlike(CJK_NARROW), mixed).when(text.rlike(LATIN), "english").when(text.isNull(), "english").otherwise("chinese")


def words_en(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), 0)


def words_unicode(text: Column) -> Column:
    """The same rule for languages written with accents."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), 0)


def squeeze(text: Column) -> Column:
    """Single blanks, of which most white space is made, are left as they are."""
    return F.trim(F.regexp_replace(text, f"(?=[^!-~])(?: {SPACE}+|{ODD_SPACE}{SPACE}*)", " "))


def squeeze_ends(text: Column) -> Column:
    """Trim every kind of white space."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def strip_punctuation(text: Column) -> Column:
    return squeeze(F.regexp_replace(text, PUNCTUATION, " "))


def words_zh(text: Column) -> Column:
    """Overlapping character pairs of every CJK run, Latin words as they are."""
    runs = F.regexp_extract_all(strip_punctuation(text), F.lit(WORD_RUNS), 0)
    lettered = F.filter(runs, lambda r: r.rlike(WORD_LETTER))
    return F.flatten(F.transform(lettered, lambda r: F.when(
        r.rlike("^" + CJK),
        F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))),
                    lambda i: F.substring(r, i, F.lit(2))),
    ).otherwise(F.array(r))))


def clean_en(text: Column) -> Column:
    kept = r"""(?![ -~\t-\r&&[a-zA-Z0-9\s.,!?'"\-]])"""  # most characters are told by this short class
    return squeeze(F.regexp_replace(text, rf"""{kept}[^a-zA-Z0-9{SPACE_SET}.,!?'"\-]+""", ""))


def clean_zh(text: Column) -> Column:
    return squeeze(F.regexp_replace(
        text, rf"(?![ -~\t-\r&&[a-zA-Z0-9\s]])[^\x{{4e00}}-\x{{9fff}}a-zA-Z0-9{SPACE_SET}]+", ""))


def strip_html(html: Column) -> Column:
    return F.regexp_replace(html, TAG, "")


def non_blank_pieces(text: Column, separator: str) -> Column:
    return F.size(F.filter(F.split(text, separator), lambda s: s.rlike(NON_SPACE)))


def visible_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[\n ]", ""))
