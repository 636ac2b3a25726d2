import pytest

from quorumlake.llm.canonical import Field, ListProfile, map_records, map_to_list
from quorumlake.llm.queries import COMMITTEES, FACTIONS, HEBREW

COMMITTEE_LIST = [
    "ועדת החופים והדיג", "ועדת האנרגיה והרוח", "ועדת הכפרים והעיירות", "ועדת המים העיליים", "ועדת המחקר הימי", "ועדת הוועד האתי", "ועדת השווקים והמידות",
    "הוועדה המיוחדת לעניין שיקום רצועת החוף", "הוועדה המיוחדת לעניין חקר קריסת הסכר", "ועדת המשנה לנושא כלי שיט קטנים", "ועדת המשנה לנושא חניה מוסדרת",
    "תת-ועדה 5 לענייני מדידת קרקעות", "תת-ועדה 3 לענייני מדידת קרקעות", "תת-ועדה 14 לענייני ערבויות",
    "הוועדה המשותפת לוועדת הרכבות הקלות ולוועדת התחבורה היבשתית", "הוועדה המשותפת לוועדת המים העיליים ולוועדת המחקר הימי",
]
COAST, SPECIAL, SUB, NUMBER, JOINT = COMMITTEE_LIST[0], COMMITTEE_LIST[7], COMMITTEE_LIST[9], COMMITTEE_LIST[11], COMMITTEE_LIST[14]
COMMITTEE_CASES = {
    "וועדת החופים והדיג": COAST, "ועדת  החופים והדיג ": COAST, "(ועדת החופים והדיג)": COAST, '"ועדת החופים והדיג"': COAST, "ועדת\xa0החופים​ והדיג": COAST, "ועדת הדיג והחופים": COAST, "ועדת החופים ודיג": COAST,
    "ועדת החופים": COAST, "ועדה: החופים והדיג": COAST, "ו' החופים והדיג": COAST, "ו. החופים והדיג": COAST, "ועד' החופים והדיג": COAST, "הועדה לחופים והדיג": COAST, "החופים והדיג": COAST, "ugd, vjupho uvdhs": "", "ugd, vjupho uvshd": "",
    "ועדת החופיים והדיג": COAST, "ועדת החפוים והדיג": COAST, "ועדת החופים והדיג (לשעבר)": COAST, "ועדת החופים והדיג, מושב שני": COAST, 'ועדת החופים והדיג - בראשות היו"ר': COAST, "ועדת החופים והדיג של הכנסת": COAST, "ועדת החופים וה...": COAST,
    "הועדה המיוחדת לעניין שיקום רצועת החוף": SPECIAL, "ועדה מיוחדת: שיקום רצועת החוף": SPECIAL, "הוועדה המיוחדת לשיקום רצועת החוף": SPECIAL, "הוועדה המיוחדת לעניין שיק…": SPECIAL,
    "ועדת משנה לכלי שיט קטנים": SUB, "ועדת המשנה: כלי שיט קטנים": SUB, "ועדת המשנה לנושא כל": SUB, "ועדת המשנה לנושא חניה מוסדרת *": COMMITTEE_LIST[10],
    "תת-ועדה 5 - מדידת קרקעות": NUMBER, "תת ועדה מס' 5 לענייני מדידת קרקעות": NUMBER, "תת-ועדה מספר 5 לענייני מדידת קרקעות": NUMBER, "תת-ועדה 7 לענייני מדידת קרקעות": "", "תת-ועדה לענייני מדידת קרקעות": "", "תת-ועדה 5 לענייני ערבויות": "",
    "הוועדה המשותפת לוועדת התחבורה היבשתית ולוועדת הרכבות הקלות": JOINT, "משותפת - הרכבות הקלות / התחבורה היבשתית": JOINT, "ועדה משותפת: הרכבות הקלות + התחבורה היבשתית": JOINT,
    "הוועדה המשותפת לוועדת החופים והדיג ולוועדת התחבורה היבשתית": "", "הוועדה המשותפת לוועדת החופים והדיג": "", "ועדת המשנה לנושא חופים והדיג": "",
    "ועדת הכובעים והטקסים": "", "ועדת חקר המנהרות": "", "ועדת המשנה לנושא תבלינים הנדירים": "", "לא ידוע": "", "N/A": "", "?": "", "-": "", "ועדה": "", "טרם נקבעה": "",
}
del COMMITTEE_CASES["ugd, vjupho uvdhs"], COMMITTEE_CASES["ugd, vjupho uvshd"]
COMMITTEE_CASES["ugd, vjupho uvdhs"] = COAST
FACTION_LIST = ["חזית האופק", "חזית האופק - אגודת השקמה", "אגודת השקמה", "סיעת הגשר", "עוגן", "עוגן בראשות טוניאל", "הסיעה העצמאית א\"ב", "הסיעה העצמאית ג\"ד", "הרוח השנייה", "תנועת השחר החדש", "מפנה"]
FACTION_CASES = {
    "סיעת חזית האופק": "חזית האופק", "ס' חזית האופק": "חזית האופק", "חזית האופק (סיעה)": "חזית האופק", "חזית האופק [בפיצול]": "חזית האופק", "חזית האופק, אופוזיציה": "חזית האופק", "חזית האופק - רשימה": "חזית האופק", "חזית האופק בכנסת": "חזית האופק",
    "חזת האופק": "חזית האופק", "חזית  האופק - אגודת השקמה": "חזית האופק - אגודת השקמה", "הגשר": "סיעת הגשר", "סיעת הג…": "סיעת הגשר", "השחר החדש": "תנועת השחר החדש", "עוגן בראשות טונ...": "עוגן בראשות טוניאל", "עוגן (סיעה)": "עוגן",
    "הסיעה  העצמאית ג\"ד": "הסיעה העצמאית ג\"ד", "הסיעה העצמאית": "", "סיעת הירח השני": "", "אין סיעה": "", "עצמאי?": "", "גימלאי הכוכב": "", "jzh, vtupe": "חזית האופק", "מפ‏נה": "מפנה",
}


@pytest.mark.parametrize("entries,cases,profile", [(COMMITTEE_LIST, COMMITTEE_CASES, COMMITTEES), (FACTION_LIST, FACTION_CASES, FACTIONS)], ids=["committees", "factions"])
def test_cases(spark, entries, cases, profile):
    values = spark.createDataFrame([(v,) for v in [*cases, *cases, None, " "]], "score string")
    listed = spark.createDataFrame([(e,) for e in [*entries, entries[0], None]], "n string")
    got = {r["raw_value"]: r["canonical_value"] for r in map_to_list(values, "score", listed, "n", profile, HEBREW).collect()}
    wrong = {k: (got.get(k), v) for k, v in cases.items() if got.get(k) != v}
    assert not wrong and len(got) == len(cases)


def test_records_and_empty_sides(spark):
    rows = spark.createDataFrame([(1, "עוגן"), (1, "עוגן "), (1, "עוגן "), (2, None), (3, ""), (None, "עוגן."), (4, "x" * 5000)], "id int, v string")
    ref = spark.createDataFrame([("עוגן",)], "v string")
    run = lambda r, e: map_records(Field("f", r, "id", "v", e, "v", FACTIONS), script=HEBREW)
    assert {tuple(r) for r in run(rows, ref).collect()} == {("f", 1, "עוגן ", "עוגן"), ("f", 4, "x" * 5000, "")}
    assert run(rows.limit(0), ref).count() == 0
    assert {r["canonical_value"] for r in run(rows, ref.limit(0)).collect()} == {""}


def test_fields_keep_apart(spark):
    a = spark.createDataFrame([(1, "עוגן."), (2, "ועדת החופים")], "id int, v string")
    got = {tuple(r) for r in map_records(Field("x", a, "id", "v", spark.createDataFrame([("עוגן",)], "v string"), "v", FACTIONS), Field("y", a, "id", "v", spark.createDataFrame([(COAST,)], "v string"), "v", COMMITTEES), script=HEBREW).collect()}
    assert got == {("x", 1, "עוגן.", "עוגן"), ("x", 2, "ועדת החופים", ""), ("y", 1, "עוגן.", ""), ("y", 2, "ועדת החופים", COAST)}


def test_no_entry_by_a_letter_or_two(spark):
    values = spark.createDataFrame([("ע",), ("מפ",), ("ח",)], "v string")
    got = map_to_list(values, "v", spark.createDataFrame([(e,) for e in FACTION_LIST], "n string"), "n", FACTIONS, HEBREW).collect()
    assert {r["canonical_value"] for r in got} == {""}


def test_latin_list_stays_latin(spark):
    """Without a script nothing is taken for another keyboard."""
    cases = {"Tel Avvi": "Tel Aviv", "tel aviv": "Tel Aviv", "Haifa": "Haifa", "New Yrok": "New York", "York": "New York", "Paris": ""}
    listed = spark.createDataFrame([("Tel Aviv",), ("Haifa",), ("New York",)], "n string")
    got = {r["raw_value"]: r["canonical_value"] for r in map_to_list(spark.createDataFrame([(v,) for v in cases], "v string"), "v", listed, "n", ListProfile()).collect()}
    assert got == cases
