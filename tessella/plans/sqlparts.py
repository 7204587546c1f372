"""Pieces shared by the DuckDB checks."""

from __future__ import annotations

from tessella.data import stopwords
from tessella.functions import text as tx


def values(rows, columns: str) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, (int, float)):
            return repr(v)
        return "'" + str(v).replace("'", "''") + "'"
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({columns}))"


def word_list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


STOP_EN = word_list(stopwords.ENGLISH)
STOP_ALL = word_list(stopwords.ENGLISH + stopwords.CHINESE)

COUNTS = f"""
tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents),
cnt AS (SELECT doc_id, term, count(*) AS n FROM tok WHERE term NOT IN ({STOP_EN}) GROUP BY ALL)"""

SPACE = tx.SPACE
SPACE_SET = tx.SPACE_SET


def squeeze(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '{tx.SPACE}+', ' ', 'g'), ' ')"


def strip_punctuation(expr: str) -> str:
    return squeeze(f"regexp_replace({expr}, '{tx.PUNCTUATION}', ' ', 'g')")


def words_zh(expr: str) -> str:
    runs = f"regexp_extract_all({strip_punctuation(expr)}, '{tx.WORD_RUNS}')"
    lettered = f"list_filter({runs}, lambda r: regexp_matches(r, '{tx.WORD_LETTER}'))"
    return (f"flatten(list_transform({lettered}, lambda r: CASE WHEN regexp_matches(r, '^{tx.CJK}') "
            f"THEN list_transform(range(1, greatest(length(r) - 1, 1) + 1), "
            f"lambda i: substr(r, i, 2)) ELSE [r] END))")
