import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quorumlake.llm.lookalike import _tables, canonical, canonical_texts, lookalike_pairs

SAME = [
    ("ｅ​́", "é"), ("ﬁ", "fi"), ("Ⅱ", "II"), ("ΙΙ", "II"), ("‑", "-"), ("－", "-"), ("ο̂", "ô"), ("й", "й"), ("ﻻ", "لا"), ("ﬠ", "ע"), ("ℶ", "ב"), ("װ", "וו"), ("שׁ", "שׁ"), ("a\r\nb", "a\nb"),
    ("a\tb", "a b"), ("a b", "a b"), ("Ё", "Ё"), ("أ", "أ"), ("ی", "ي"), ("Ａ", "А"), ("׳", "'"), ("״", "＂"), ("가", "가"), ("שּׁ", "שּׁ"), ("ȩ́", "ȩ́"), ("a﻿b", "ab"), ("­x", "x"),
    ("\u0995\u09cb", "\u0995\u09c7\u09be"), ("\u0b95\u0bca", "\u0b95\u0bc6\u0bbe"), ("ρν", "pv"), ("օ", "o"), ("Ӏ", "I"),
]
APART = [("²", "2"), ("–", "-"), ("אָ", "א"), ("a  b", "a b"), ("“", '"'), ("É", "E"), ("À", "A"), ("ی", "ى"), ("½", "1/2"), ("①", "1"), ("O", "0"), ("l", "1"), ("ç", "c"), ("л", "Л"), ("ё", "é"), ("—", "–"), ("a\nb", "a b")]


@pytest.mark.parametrize("a,b", SAME)
def test_same(a, b):
    assert canonical(a) == canonical(b)
    assert canonical(f"x{a}y") == canonical(f"x{b}y")


@pytest.mark.parametrize("a,b", APART)
def test_apart(a, b):
    assert canonical(a) != canonical(b)


def test_every_composition():
    """Composed and decomposed spellings of all characters have one form, spacing marks too."""
    apart = []
    for code in range(0x110000):
        if 0xD800 <= code < 0xE000:
            continue
        for form in ("NFD", "NFC"):
            other = unicodedata.normalize(form, chr(code))
            if other != chr(code) and canonical(f"x{other}y") != canonical(f"x{chr(code)}y"):
                apart.append(code)
    assert not apart


ALPHABET = "aeoсеоАВאבשָּׁ̧́̈​  \r\nﬁﻻ²–１ｘ가가ی.,"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=ALPHABET, max_size=60))
def test_segments_equal_whole_text_form(text):
    first, shape, _ = _tables()
    whole = unicodedata.normalize("NFC", unicodedata.normalize("NFD", unicodedata.normalize("NFD", text.replace("\r\n", "\n").replace("\r", "\n")).translate(first)).translate(shape))
    assert canonical(text) == whole
    assert canonical(whole) == whole


def test_pairs(spark):
    rows = [(1, "fi x"), (2, "ﬁ x"), (3, "fi x"), (4, "fi x"), (5, None), (6, ""), (7, "​"), (8, "‎"), (9, "FI x"), (10, "plain"), (11, "plain"), (2, "ﬁ x"), (None, "fi x"), (12, "é" * 20000), (13, "é" * 20000)]
    df = spark.createDataFrame(rows, "stored bigint, form string")
    got = {tuple(r) for r in lookalike_pairs(df, "stored", "form").collect()}
    assert got == {(1, 2), (1, 4), (2, 3), (2, 4), (3, 4), (12, 13)}
    assert lookalike_pairs(df.limit(0), "stored", "form").count() == 0
    forms = {r["stored"]: r["form"] for r in canonical_texts(df.where("stored < 9"), "stored", "form").collect()}
    assert forms[2] == "fi x" and forms[5] is None and forms[6] == ""
