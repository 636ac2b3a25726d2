import pytest

from quorumlake.operators.packed import explode_packed, split_packed

CASES = [
    ("א ב, ג ד", ["א ב", "ג ד"]),
    ('"כהן, דן"; "עו""ד לוי, יעל"; רון', ["כהן, דן", 'עו"ד לוי, יעל', "רון"]),
    ('ד"ר א, עו"ד ב', ['ד"ר א', 'עו"ד ב']),
    ('["ח\\"כ א ב", "ג"]', ['ח"כ א ב', "ג"]),
    ("1. א\n2. ב\n3. ג", ["א", "ב", "ג"]),
    ("(1) א (2) ב (3) ג", ["א", "ב", "ג"]),
    ("1) א; 2) ב", ["א", "ב"]),
    ("• א • ב", ["א", "ב"]),
    ("· א ב · ג", ["א ב", "ג"]),
    ('א (מ"מ, סיעת הגשר), ב', ['א (מ"מ, סיעת הגשר)', "ב"]),
    ("א (לשעבר ב, ג - ד); ה", ["א (לשעבר ב, ג - ד)", "ה"]),
    (", א,, ב ,  , ", ["א", "ב"]),
    ("א / ב | ג || ד", ["א", "ב", "ג", "ד"]),
    ("א\r\nב\tג", ["א", "ב", "ג"]),
    ("א、ב，ג；ד،ה", ["א", "ב", "ג", "ד", "ה"]),
    ("“כהן, דן”, “ד\"ר לוי, יעל”", ["כהן, דן", 'ד"ר לוי, יעל']),
    ("הרצביץ'-כהן, ס. לוי", ["הרצביץ'-כהן", "ס. לוי"]),
    ('"אין סוף, א', ["אין סוף", "א"]),
    ("- א\n- ב", ["א", "ב"]),
    ("a, a", ["a", "a"]),
    ("לבד", ["לבד"]),
    ("a (b (c) d, e), f", ["a (b (c) d, e)", "f"]),
    ("a [b, (c), d], e", ["a [b, (c), d]", "e"]),
    ("a (b, c; (d, e), f", ["a (b", "c", "(d, e)", "f"]),
    ("a), b (c, d)", ["a)", "b (c, d)"]),
    ("a (" + "x" * 500 + ", y), b", ["a (" + "x" * 500 + ", y)", "b"]),
    ('"a, 1. b", c', ["a, 1. b", "c"]),
    ("1000. a\n1001. b", ["a", "b"]),
    ('""', []),
    ("   ", []),
    ("", []),
    (None, None),
]


@pytest.fixture(scope="module")
def got(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string")
    return {r["i"]: r["v"] for r in df.select("i", split_packed(df.t).alias("v")).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_split(got, i):
    assert got[i] == CASES[i][1], CASES[i][0]


def test_long_text_and_table(spark):
    text = ",".join(f"שם{i}" for i in range(5000))
    df = spark.createDataFrame([(1, text, 5), (1, text, 5), (2, "א", 6), (3, None, 7), (4, "  ", 8)], "k int, t string, pos int")
    out = explode_packed(df, "t", ["k"], at_least=2)
    assert out.count() == 5000 and out.agg({"pos": "max"}).head()[0] == 5000
    assert explode_packed(df.limit(0), "t", ["k"]).count() == 0
