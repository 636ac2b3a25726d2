"""Chunks, vectors, marts, sources, sinks and resumable ingestion."""

import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quorumlake.operators.chunking import JOINT, Span, embedding_input, legal_units, pack_units, split_long, spans_column, tagged_items, truncate, whole_document_budget, word_count
from quorumlake.operators import vectors
from quorumlake.operators.nested import flatten_nested
from quorumlake.operators.vectors import DensityConfig, density_labels, nearest_neighbors
from quorumlake.plans import marts, pipeline
from quorumlake.sources import providers, readers, sinks
from quorumlake.streaming.resume import ingest_available

WORDS = st.text(alphabet="אבגד ab.\n", max_size=120)


@settings(max_examples=60, deadline=None)
@given(st.lists(WORDS, max_size=8), st.integers(1, 12))
def test_packing_keeps_text_and_budget(texts, budget):
    units = [Span(t.strip(), "h", 1, f"b{i}") for i, t in enumerate(texts) if t.strip()]
    chunks = pack_units(units, budget)
    flat = "".join(s.text for c in chunks for s in c)
    assert "".join(flat.split()) == "".join("".join(u.text for u in units).split())
    for c in chunks:
        assert word_count(JOINT.join(s.text for s in c)) <= budget or len(c) == 1
    assert [s.block_id for c in chunks for s in c] == sorted((s.block_id for c in chunks for s in c), key=lambda b: int(b[1:]))


def test_whole_document_is_one_chunk(spark):
    blocks = [("heading", None, ["א", "ב"], None, None), ("text", "1. x\n2. y", None, 3, "b1"), ("text", "z", None, 4, "b2")]
    df = spark.createDataFrame([(blocks,)], "b array<struct<kind:string,text:string,heading_path:array<string>,page_no:int,block_id:string>>")
    units = [Span(*u) for u in df.select(spans_column(F.col("b"))).head()[0]]
    assert [(u.text, u.heading_path, u.page_no) for u in units] == [("1. x", "א > ב", 3), ("2. y", "א > ב", 3), ("z", "א > ב", 3)]
    assert pack_units(units, 100) == [units]
    assert split_long("aa bb cc", 2, word_count) == ["aa bb", "cc"]
    assert truncate("aa bb cc", 2) == "aa bb" and truncate("  ", 2) == "" and truncate("aa", 0) == ""
    assert whole_document_budget(1000, 100, 50) == 850
    with pytest.raises(ValueError):
        whole_document_budget(10, 10, 0)


def test_columns(spark):
    df = spark.createDataFrame([("פתיח\nסעיף 1. א\n2) ב\nא. ג",)], "t string")
    assert df.select(legal_units(F.col("t"))).head()[0] == ["פתיח", "סעיף 1. א", "2) ב", "א. ג"]
    assert df.select(tagged_items(F.lit("<B> x </B><B> </B><B>y\nz</B>"), "B")).head()[0] == ["x", "y\nz"]
    assert df.select(embedding_input("q: ", F.lit(" t "), F.lit(None).cast("string"), F.lit("b"))).head()[0] == "q: [t] b"


def test_neighbors_match_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    x[7] = 0
    x[11] = x[12]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None)], "id bigint, v array<double>")
    got = {}
    for r in nearest_neighbors(df.where("id % 50 = 0"), df, "id", "v", 4, block_rows=64).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["neighbor_id"])
    u = x / np.where(np.linalg.norm(x, axis=1) == 0, 1, np.linalg.norm(x, axis=1))[:, None]
    for q in range(0, 300, 50):
        s = u @ u[q]
        want = sorted((i for i in range(300) if i != q), key=lambda i: (-round(s[i], 12), i))[:4]
        assert got[q] == want
    with pytest.raises(ValueError):
        nearest_neighbors(df, df, "id", "v", 0)


@pytest.mark.parametrize("method", ["leaf", "eom"])
def test_density_finds_groups(method):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(4, 16)) * 4
    x = np.vstack([c + rng.normal(size=(30, 16)) * 0.2 for c in centers] + [rng.normal(size=(10, 16)) * 4])
    labels, p = density_labels(x, DensityConfig(5, 5, method))
    assert labels.min() >= -1 and (p >= 0).all() and (p <= 1).all()
    groups = [set(labels[i * 30 : (i + 1) * 30]) - {-1} for i in range(4)]
    assert all(len(g) >= 1 for g in groups) and not any(a & b for i, a in enumerate(groups) for b in groups[:i])
    assert all(n >= 5 for n in np.bincount(labels[labels >= 0]))
    with pytest.raises(ValueError):
        density_labels(x[:2], DensityConfig())
    with pytest.raises(ValueError):
        DensityConfig(method="x")


def test_density_in_blocks(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([c + rng.normal(size=(30, 16)) * 0.2 for c in rng.normal(size=(4, 16)) * 4] + [rng.normal(size=(10, 16)) * 4])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None)], "id bigint, v array<double>")
    few = DensityConfig(5, 5, "eom", max_rows=50)
    labels, p = density_labels(x, few)
    got = sorted(vectors.density_clusters(df, "id", "v", few).collect())
    assert [r["cluster_id"] for r in got] == labels.tolist() and np.allclose([r["membership_probability"] for r in got], p)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    d = np.sqrt(np.maximum(0, 2 - 2 * u @ u.T))
    core = np.partition(d, 5, axis=1)[:, 5]
    d = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    best, total, out = d[0].copy(), 0.0, set(range(1, len(x)))
    while out:
        at = min(out, key=lambda i: best[i])
        total += best[at]
        out.remove(at)
        best = np.minimum(best, d[at])
    tree = vectors.spanning_tree(df.where("v is not null"), len(x), few, block_rows=16).collect()
    assert len(tree) == len(x) - 1 and abs(sum(r["w"] for r in tree) - total) < 1e-9


def test_tags_of_all_chunks(spark, tmp_path):
    texts = [(1, "head\n" + "\n".join(f"{i}. " + "w " * 200 for i in range(1, 4))), (2, "only a heading"), (3, None)]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    seen = pipeline.tag_extract(spark, str(tmp_path)).collect()
    assert sorted(r["chunk_id"] for r in seen) == ["1:0000", "1:0001", "1:0002", "1:h0000", "2:h0000"] and {r["state"] for r in seen} == {"success"}
    assert [(r["n_bullets"], r["n_chunks"]) for r in pipeline.bullet_accounting(spark, str(tmp_path)).collect()] == [(1, 5)]
    asked = spark.createDataFrame([("7:0000", "a"), ("7:0001", "")], "chunk_id string, text string")
    answers = lambda ts: ["<BULLET>x</BULLET><BULLET>y</BULLET>" if t else "<EMPTY/>" for t in ts]
    got = {(r["doc_id"], r["chunk_id"], r["state"], r["bullet_ordinal"], r["bullet"]) for r in pipeline._bullets(asked, answers).collect()}
    assert got == {(7, "7:0000", "success", 0, "x"), (7, "7:0000", "success", 1, "y"), (7, "7:0001", "no_usable_quotes", None, "")}
    assert {r["state"] for r in pipeline._bullets(asked, lambda ts: 1 / 0).collect()} == {"failed"}


def test_marts(spark, sf):
    report = {r["check"]: r["violations"] for r in pipeline.dq_concept_report(spark, sf).collect()}
    assert report["one concept row a bill"] == 0 and report["no concept of noise"] == 0 and report["links without rating"] == 0
    for r in pipeline.bill_concepts(spark, sf).collect():
        assert r["n_bullets"] >= r["n_noise_bullets"] and (r["noise_ratio"] is None) == (r["n_bullets"] == 0)


def test_document_selection(spark):
    bills = spark.createDataFrame([(1,), (2,), (3,)], "bill_id bigint")
    rows = [
        (1, "a", "DraftLaws", "הצעה לקריאה הראשונה", "http://x/a.pdf", None, "2020-01-01", 0), (1, "b", "LegalDocuments", "חוק - נוסח לא רשמי", "http://x/b.docx", None, "2019-01-01", 1),
        (1, "c", "LegalDocuments", "חוק - נוסח לא רשמי", "http://x/c.pdf", None, None, 2), (1, "d", "LegalDocuments", "חוק - נוסח לא רשמי", "http://x/d.pdf", None, "2018-01-01", 3),
        (2, "e", "DraftLaws", "לוח תיקונים לקריאה הראשונה", "http://x/e.pdf", None, None, 0), (2, "f", "DraftLaws", "דיון מוקדם", "", "pdf", None, 1),
    ]
    docs = spark.createDataFrame(rows, "bill_id bigint, bill_document_id string, source_field string, document_label string, document_url string, document_format string, document_date string, document_ordinal int")
    got = {r["bill_id"]: (r["bill_document_id"], r["selection_state"], r["candidate_count"]) for r in marts.select_documents(bills, docs).collect()}
    assert got == {1: ("d", "selected", 4), 2: (None, "no_supported_document", 0), 3: (None, "no_supported_document", 0)}


def test_drafts_are_selected(spark, tmp_path):
    draft = {"FileText": "הצעת חוק לקריאה הראשונה", "FilePath": "http://x/a.pdf", "FileDate": "2020-01-01"}
    law = {"FileText": "נוסח רשמי", "FilePath": "http://x/b.pdf"}
    bodies = [(1, json.dumps({"sessionAndDocs": {"DraftLaws": [draft]}})), (2, json.dumps({"sessionAndDocs": {"DraftLaws": [draft], "LegalDocuments": [law]}}))]
    spark.createDataFrame(bodies, "raw_id bigint, payload string").write.parquet(f"{tmp_path}/passed_bills_raw.parquet")
    got = {r["bill_id"]: (r["source_field"], r["selected_stage"], r["candidate_count"]) for r in pipeline.doc_select(spark, str(tmp_path)).collect()}
    assert got == {1: ("DraftLaws", "first_reading", 1), 2: ("LegalDocuments", "official_law", 2)}
    t = flatten_nested(spark.createDataFrame(bodies, "raw_id bigint, payload string"), "raw_id", "payload")
    assert [r["path"] for r in t["file"].collect()] == ["http://x/b.pdf"]


def test_sources(spark, tmp_path):
    (tmp_path / "coalition_membership.csv").write_text("party_id,knesset_num,start,end,kind,note\na,25,2022-12-29,,government,\n", encoding="utf-8")
    row = readers.read_lookup(spark, f"file://{tmp_path}", "coalition_membership").head()
    assert row["end"] is None and str(row["start"]) == "2022-12-29"
    df = spark.createDataFrame([('{"Tables": {"T": [{"VoteId": 1}], "U": [{"VoteId": 2}]}}',), ('{"Table": [{"VoteId": 3}]}',), ('[{"VoteId": 4}]',)], "b string")
    assert {r["VoteId"] for r in readers.records_of(df, "b", "VoteId bigint").collect()} == {1, 2, 3, 4}
    blobs = spark.createDataFrame([(b"%PDF-1",), (b"PK\x03\x04 word/document.xml",), (b"{\\rtf1",), (b"\xd0\xcf\x11\xe0\xa1",), (b"x",)], "c binary")
    assert [r[0] for r in blobs.select(readers.content_kind(F.col("c"))).collect()] == ["pdf", "zip", "rtf", "ole", None]
    assert [r[0] for r in blobs.select(readers.is_word_archive(F.col("c"))).collect()] == [False, True, False, False, False]
    assert blobs.limit(1).select(readers.hyperlink_of(F.lit('=HYPERLINK("https://a/b","x")'))).head()[0] == "https://a/b"
    items = spark.createDataFrame([(1, [("a", 1), ("b", 2)], [("c", 3)])], "k int, x array<struct<n:string,v:int>>, y array<struct<n:string,v:int>>")
    out = readers.explode_allowed(items, ["k"], ["x", "y"])
    assert out.count() == 3 and out.select("item_id").distinct().count() == 3
    assert items.select(readers.first_match(F.col("x"), lambda d: d["v"] > 1, "n")).head()[0] == "b"
    one = tmp_path / "m.txt"
    one.write_text("x")
    assert len(readers.manifest(spark, [str(one)])) == 16


def test_sinks_and_resume(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    assert sinks.read_or_none(spark, path) is None
    assert sinks.build_once(spark, path, "v1", build).count() == 3 and sinks.build_once(spark, path, "v1", build).count() == 3 and len(calls) == 1
    sinks.build_once(spark, path, "v2", build)
    assert len(calls) == 2
    src, target = tmp_path / "src", f"file://{tmp_path}/target"
    schema = "k int, v string, n int"
    spark.createDataFrame([(1, "a", 1), (2, "b", 1)], schema).coalesce(1).write.parquet(f"file://{src}/1")
    args = (spark, f"file://{src}/*", schema, target, f"file://{tmp_path}/cp", ["k"], "n")
    assert ingest_available(*args).count() == 2
    spark.createDataFrame([(2, "late", 0), (3, "c", 1), (1, "new", 2)], schema).coalesce(1).write.parquet(f"file://{src}/2")
    assert {r["k"]: r["v"] for r in ingest_available(*args).collect()} == {1: "new", 2: "b", 3: "c"}
    assert ingest_available(*args).count() == 3
    # a table is replaced by one switch: the version that a reader has begun stays
    held = sinks.read_or_none(spark, path)
    sinks.write_atomic(spark.range(5), path)
    assert held.count() == 3 and sinks.read_or_none(spark, path).count() == 5
    sinks.write_manifest(spark, f"{path}/run.json", {"b": 1, "a": "א"})
    assert json.loads((tmp_path / "t" / "run.json").read_text()) == {"a": "א", "b": 1}
    lists = [spark.createDataFrame([(1, "x")], "id int, u string"), spark.createDataFrame([(1, "y"), (2, "z")], "id int, u string")]
    assert {(r["id"], r["u"]) for r in sinks.first_by_priority(lists, "id").collect()} == {(1, "x"), (2, "z")}


def test_providers(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "boom"), (3, "")], "id int, t string")

    def call(texts):
        if "boom" in texts:
            raise RuntimeError("no")
        return [t.upper() for t in texts]

    got = {r["id"]: (r["result"], r["state"]) for r in providers.map_batches(df.coalesce(1), "id", "t", call, batch=1).collect()}
    assert got == {1: ("A B", "success"), 2: (None, "failed"), 3: ("", "success")}
    status = spark.createDataFrame([(1, "success", "v"), (2, "failed", "v"), (3, "success", "old")], "id int, state string, version string")
    assert {r["id"] for r in providers.pending(df, status, "id", "v").collect()} == {2, 3}
    assert providers.stub_embeddings(["a b"])[0] == providers.stub_embeddings(["b a"])[0]


def test_prompts():
    from quorumlake.functions import prompts

    assert prompts.fill("{a} and {b}", a="x", b="y") == "x and y"
    with pytest.raises(ValueError, match="b"):
        prompts.fill("{a} {b}", a="x")
    assert prompts.json_object('say ```json\n{"a": {"b": 1}}\n``` done') == {"a": {"b": 1}} == prompts.json_object('x {"a": {"b": 1}} y')
    for bad in ("none", "} {"):
        with pytest.raises(ValueError):
            prompts.json_object(bad)
    assert prompts.concept_id("r", 1, "n", "p") != prompts.concept_id("r", 2, "n", "p") and len(prompts.prompt_hash("a", "b")) == 16
    with pytest.raises(ValueError):
        prompts.check_examples(["a", "z"], {"a"})


def test_dim_bullets_refuses_unresolved(spark):
    links = spark.createDataFrame([("a", ["a", "b"])], "primary_evidence_bullet_id string, bullet_ids array<string>")
    concepts = spark.createDataFrame([(["a"],)], "representative_bullet_ids array<string>")
    good = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "bullet_row_id string, bill_id int, bullet string")
    assert marts.dim_bullets(links, concepts, good).count() == 2
    with pytest.raises(ValueError):
        marts.dim_bullets(links, concepts, good.limit(1))


def test_concept_lists_must_be_unique(spark):
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string")
    assert marts.at_most_one(twice, "k").count() == 2
    with pytest.raises(Exception, match="more than one row"):
        marts.at_most_one(twice.union(spark.createDataFrame([(2, "c")], "k int, v string")), "k").collect()


def test_provenance_and_foreign_examples(spark):
    concepts = spark.createDataFrame([("c", ["a", "gone"]), ("d", [])], "concept_id string, representative_bullet_ids array<string>")
    bullets = spark.createDataFrame([("a", 1, "x")], "bullet_row_id string, bill_id bigint, bullet string")
    assert {tuple(r) for r in marts.provenance(concepts, bullets).collect()} == {("c", 0, "a", True, 1, "x"), ("c", 1, "gone", False, None, None)}
    members = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, i string")
    given = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "k int, i string")
    assert {tuple(r) for r in marts.foreign_examples(given, members, "k", "i").collect()} == {(1, "b"), (2, None)}
