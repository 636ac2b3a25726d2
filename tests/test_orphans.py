import datetime as dt

from quorumlake.operators.orphans import Reference, orphan_references, orphan_report

T = dt.datetime(2020, 5, 1)


def tables(spark):
    return {
        "top": spark.createDataFrame([(1, "available", T), (2, "deleted", T), (3, "available", T + dt.timedelta(days=9)), (3, "available", T + dt.timedelta(days=8)), (None, "available", T)], "id int, state string, loaded_at timestamp_ntz"),
        "mid": spark.createDataFrame([(10, 1, T), (11, 2, T), (12, 3, T), (13, 99, T), (14, None, T), (13, 99, T)], "mid int, id int, loaded_at timestamp_ntz"),
        "leaf": spark.createDataFrame([(100, 10, T), (101, 11, T), (102, 12, T), (103, 13, T), (104, 77, T)], "leaf int, mid int, loaded_at timestamp_ntz"),
        "twig": spark.createDataFrame([(1000, 103, T), (1001, 100, T)], "twig int, leaf int, loaded_at timestamp_ntz"),
    }


REFS = [
    Reference("mid", "id", "mid", "top", "id", "state", "loaded_at"),
    Reference("leaf", "mid", "leaf", "mid", "mid"),
    Reference("twig", "leaf", "twig", "leaf", "leaf"),
]


def test_direct_reasons_and_cascade(spark):
    got = {(r["table_name"], r["row_key"], r["reason"], r["depth"]) for r in orphan_references(tables(spark), REFS).collect()}
    assert got == {
        ("mid", "11", "deleted", 0), ("mid", "12", "late", 0), ("mid", "13", "missing", 0), ("leaf", "104", "missing", 0),
        ("leaf", "101", "inherited", 1), ("leaf", "103", "inherited", 1), ("twig", "1000", "inherited", 2),
    }


def test_cycle_ends(spark):
    t = {"a": spark.createDataFrame([(1, 2, T), (2, 1, T), (3, 9, T), (4, 3, T)], "id int, up int, loaded_at timestamp_ntz")}
    got = {(r["row_key"], r["kind"]) for r in orphan_references(t, [Reference("a", "up", "id", "a", "id")]).collect()}
    assert got == {("3", "direct"), ("4", "inherited")}


def test_empty_tables_and_report(spark):
    t = tables(spark)
    t["top"] = t["top"].limit(0)
    direct = orphan_references(t, REFS[:1], cascade=False)
    assert {r["reason"] for r in direct.collect()} == {"missing"} and direct.count() == 4
    t["mid"] = t["mid"].limit(0)
    assert orphan_references(t, REFS[:1]).count() == 0
    rows = orphan_report(orphan_references(tables(spark), REFS)).collect()
    assert sum(r["n_refs"] for r in rows) == 7 and {r["period"] for r in rows} == {"2020-05"}
