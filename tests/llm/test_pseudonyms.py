import datetime
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import pseudonyms as P

KEY = P.Permutation(b"k")
TEXT = """Mail for.43@mail7.example.com or Jane.Doe+x@EX.org, card 4845168114407329 and 4845 1681 1440 7329 30 bad
9807915762804490, +1 (487) 555-7209 (487) 555-7209, +49 30 1234567, ip 97.51.17.173 999.1.1.1 1.2.3.4.5, 2024-02-29
2023-02-29 29.02.2024 02/29/2024, ssn 078-05-1120 000-12-3456 DE89 3704 0044 0532 0130 00 GB82WEST12345698765432
token="40d78a45c418324758e099eb7cb89bc0f5fa9f62" version 2.0."""


def test_permutes_every_range():
    for n in (1, 2, 3, 7, 10, 100, 101, 997):
        assert sorted(KEY(x, n, "t") for x in range(n)) == list(range(n))
        assert all(KEY(KEY(x, n, "t"), n, "t", True) == x for x in range(n))


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**30), st.integers(1, 10**30))
def test_back(x, n):
    y = KEY(x % n, n, "t")
    assert 0 <= y < n and KEY(y, n, "t", True) == x % n


def test_formats_stay_and_turn_back():
    new, spans = P.replace(TEXT, KEY)
    assert P.replace(new, KEY, back=True)[0] == TEXT
    assert [k for k, _, _ in spans] == ["email"] * 2 + ["card"] * 2 + ["phone"] * 3 + ["ip"] + ["date"] * 3 + ["ssn"] + ["iban"] * 2
    for clean in ("9807915762804490", "999.1.1.1", "1.2.3.4.5", "2023-02-29", "000-12-3456", "40d78a45c4", "version 2.0."):
        assert clean in new
    for value in ("for.43@", "4845168114407329", "555-7209", "97.51.17.173", "2024-02-29", "078-05-1120", "GB82WEST"):
        assert value not in new
    assert len(re.findall(r"\+1 \((\d{3})\) (\d{3}-\d{4}) \(\1\) \2", new)) == 1  # one number, two spellings
    day = re.search(r"\d{4}-\d{2}-\d{2}", new).group()
    assert datetime.date.fromisoformat(day).strftime("%d.%m.%Y") in new
    card = re.search(r"card (\d{16})", new).group(1)
    assert P.check_digit(card[:-1]) == card[-1] and " ".join(card[k:k + 4] for k in range(0, 16, 4)) in new


def test_equal_values_stay_linked(spark):
    docs = spark.createDataFrame([(1, "a 97.51.17.173 b"), (2, "97.51.17.173"), (3, "97.51.17.174")], "doc_id long, text string")
    got = {r.doc_id: r for r in P.report(docs).collect()}
    assert got[2].text in got[1].text and got[3].text != got[2].text
    assert got[1].spans == "ip:2:14" and got[1].n_ip == 1
    back = P.pseudonymise(P.pseudonymise(docs, b"x"), b"x", back=True).collect()
    assert {r.doc_id: r.text for r in back} == {r.doc_id: r.text for r in docs.collect()}


def test_odd_rows(odd_docs, no_docs):
    got = P.report(odd_docs).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in got))) == sorted(map(str, ((r.doc_id, r.text) for r in odd_docs.collect())))
    assert P.report(no_docs).count() == 0
