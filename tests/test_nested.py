import json

import pytest

from quorumlake.operators.nested import flatten_nested, parse_payload, visit


def files(payload):
    out = set()
    for tag, _, _, _, body in visit(1, payload if isinstance(payload, (str, type(None))) else json.dumps(payload)):
        x = json.loads(body)
        if tag == "file":
            out.add((x["stage_no"], x["doc_no"], x["file_no"], x["path"]))
        if tag == "document" and x["n_files"] == 0:
            out.add((x["stage_no"], x["doc_no"], -1, ""))
    return out


def wrap(docs):
    return {"general": {"Id": 1}, "sessionAndDocs": {"LegalDocuments": docs}}


ONE = {(-1, 0, 0, "p")}


@pytest.mark.parametrize("docs", [
    [{"FilePath": "p"}], {"FilePath": "p"}, {"Items": [{"FilePath": "p"}]}, json.dumps([{"FilePath": "p"}]), json.dumps({"FilePath": ["p"]}),
    [{"FilePath": ["p"]}], [{"FilePath": [{"Path": "p"}]}], [{"FilePath": {"Path": "p", "Format": "PDF"}}], [{"FilePath": {"Items": [{"Path": "p"}]}}], [{"FilePath": json.dumps(["p"])}],
])
def test_shapes_do_not_matter(docs):
    assert files(wrap(docs)) == ONE


def test_positions_count_nulls():
    docs = [None, {"FileText": "a"}, {}, {"FilePath": [None, {"Format": "x"}, {"Path": ""}, "q", {"Path": "r"}]}, {"FilePath": None}, "text"]
    assert files(wrap(docs)) == {(-1, 1, -1, ""), (-1, 3, 3, "q"), (-1, 3, 4, "r"), (-1, 4, -1, "")}


def test_stages():
    d = [{"FilePath": "p"}]
    p = {"sessionAndDocs": {"Stages": [{"StageId": 1}, None, {"LegalDocuments": d}], "LegalDocuments": d, "DraftLaws": d}}
    assert files(p) == {(-1, 0, 0, "p"), (2, 0, 0, "p")}
    assert files({"sessionAndDocs": {"Stages": {"StageId": 1, "LegalDocuments": d}}}) == {(0, 0, 0, "p")}
    assert files({"sessionAndDocs": {"Stages": {"Items": [{"LegalDocuments": {"Items": d}}]}}}) == {(0, 0, 0, "p")}


def test_wrapping_of_payloads():
    text = json.dumps(wrap({"FilePath": "p"}))
    for p in ("﻿" + text, f"  {text}\n", f"[{text}]", json.dumps(text), f"callback({text});", text + "\x00", f"data: {text}"):
        assert files(p) == ONE, p
    for p in (None, "", "x", text[:-4], "{}", "[]", "null", "3", text[: len(text) // 2]):
        assert files(p) == set(), p
    assert parse_payload('"' * 5) is None


def test_tables_keep_links(spark):
    rows = [(1, json.dumps(wrap([{"FilePath": ["a", "b"]}])), "x"), (1, json.dumps(wrap([{"FilePath": ["a", "b"]}])), "x"), (2, None, "y"), (None, json.dumps(wrap({"FilePath": "p"})), "z")]
    t = flatten_nested(spark.createDataFrame(rows, "id bigint, payload string, tag string"), "id", "payload")
    assert t["file"].count() == 2 and t["document"].count() == 1 and t["record"].count() == 1
    assert {r["parent_pk"] for r in t["file"].collect()} == {r["pk"] for r in t["document"].collect()}
    empty = flatten_nested(spark.createDataFrame([], "id bigint, payload string"), "id", "payload")
    assert empty["file"].count() == 0


def test_deep_and_huge():
    assert files("[" * 5000 + "]" * 5000) == set()
    assert len(files(wrap([{"FilePath": [f"p{i}" for i in range(20000)]}]))) == 20000


def test_any_depth_of_wrapping():
    """A payload held as text in text, however deep, is read; so is a wrapped collection."""
    doc = {"sessionAndDocs": {"LegalDocuments": [{"FilePath": "http://x/a.pdf"}]}}
    text = json.dumps(doc)
    for _ in range(14):
        text = json.dumps(text)
    assert [r[0] for r in visit(1, text)] == ["record", "document", "file"]
    held = [{"FilePath": "http://x/a.pdf"}]
    for n in range(20):
        held = {f"w{n}": held}
    assert [r[0] for r in visit(1, json.dumps({"sessionAndDocs": {"LegalDocuments": held}}))] == ["record", "document", "file"]
