"""Identities of the analytical model, and unit cases of its rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quorumlake.functions import sqlfn, text
from quorumlake.functions.dates import to_day, to_moment
from quorumlake.plans import pages as P
from quorumlake.plans import pages_catalogue as Q
from quorumlake.plans import quality
from quorumlake.plans.model import Model, first_delivery


@pytest.fixture(scope="module")
def m(spark, sf):
    return Model.of(spark, sf)


def test_dates(spark):
    cases = {
        "2003-03-31T18:49:54": "2003-03-31 18:49:54", "2003-04-21 11:50:03": "2003-04-21 11:50:03", "2004-07-13T16:19:52.000": "2004-07-13 16:19:52", "2009-03-10T21:00": "2009-03-10 21:00:00",
        "2020-03-16": "2020-03-16 00:00:00", "14/10/2004": "2004-10-14 00:00:00", "1.2.2004": "2004-02-01 00:00:00", "05-06-2007 10:11": "2007-06-05 10:11:00", "20210507": "2021-05-07 00:00:00",
        " 2020-03-16 ": "2020-03-16 00:00:00", "לא ידוע": None, "": None, "2020-13-01": None, "31/02/2020": None, "12345": None,
    }
    df = spark.createDataFrame(list(cases.items()), "t string, want string")
    for r in df.select("t", "want", to_moment(F.col("t")).cast("string").alias("got"), to_day(F.col("t")).cast("string").alias("day")).collect():
        assert r["got"] == r["want"], r["t"]
        assert r["day"] == (r["want"][:10] if r["want"] else None)


def test_sql_functions(spark):
    df = spark.createDataFrame([(1, 5, None), (1, 7, "b"), (1, 7, "a"), (1, 9, None), (2, None, "c")], "k int, y int, x string")
    got = {r["k"]: r["v"] for r in df.groupBy("k").agg(sqlfn.arg_max(F.col("x"), F.col("y")).alias("v")).collect()}
    assert got == {1: "b", 2: None}
    one = df.limit(1).select(sqlfn.safe_div(F.lit(1), F.lit(0)).alias("a"), sqlfn.contains(F.array(F.lit(None).cast("string"), F.lit("q")), F.lit("z")).alias("b"), text.name_key(F.lit("ב-א (ג)")).alias("c"), text.title_tidy(F.lit("  a \n b.. ")).alias("d"), text.url_canonical(F.lit("https:\\\\h.x\\a\\\\b//c.pdf?v=1//2")).alias("e"), text.document_format(F.lit("DOCX"), F.lit("u.pdf")).alias("f"), text.document_format(F.lit(None).cast("string"), F.lit("u.PDF?v=2")).alias("g"), F.round(text.script_ratio(F.lit("אב c")), 4).alias("h")).head()
    assert one["a"] is None and one["b"] is False and one["c"] == "א ב ג" and one["d"] == "a b" and one["f"] == "docx" and one["g"] == "pdf" and one["h"] == 0.6667
    assert one["e"].startswith("https://h.x/a/b/c.pdf")
    assert sqlfn.page_count(0) == 1 and sqlfn.page_count(50) == 1 and sqlfn.page_count(51) == 2


def test_url_and_reading(spark):
    urls = {
        "https://a//b///c?u=http://x//y&z=p//q": "https://a/b/c?u=http://x//y&z=p//q", "//host//x": "//host/x", "https:\\\\fs.example\\23//law//a.docx": "https://fs.example/23/law/a.docx",
        " http://h//p#a//b ": "http://h/p#a//b", "a//b": "a/b", "": "", "https://h": "https://h",
    }
    df = spark.createDataFrame(list(urls.items()), "u string, want string")
    assert [r["u"] for r in df.where(text.url_canonical(F.col("u")) != F.col("want")).collect()] == []
    motions = [("להעביר את הצעת החוק לוועדה להכנה לקריאה שניה ושלישית", 1), ("לקבל את הצעת החוק בקריאה שלישית", 3), ("לקבל בקריאה שנייה", 2), ("לדחות את ההצעה", None), (None, None)]
    df = spark.createDataFrame(motions, "m string, want int")
    assert df.where(~text.reading_of(F.col("m")).eqNullSafe(F.col("want"))).count() == 0


def test_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from quorumlake.session import shared_dir

    none = SimpleNamespace(isDefined=lambda: False)
    sc = SimpleNamespace(master="spark://h:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    with pytest.raises(ValueError):
        shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=sc))


def test_first_delivery(spark):
    t = dt.datetime(2020, 1, 1)
    df = spark.createDataFrame([(1, None, t), (1, "x", t), (1, "y", t + dt.timedelta(1)), (2, None, t)], "k int, v string, loaded_at timestamp_ntz")
    assert {(r["k"], r["v"]) for r in first_delivery(df, "k").collect()} == {(1, "x"), (2, None)}


def test_no_fan_out(m):
    votes = m.votes
    assert votes.count() == m.raw("fact_votes").select("vote_id").distinct().count()
    known = m.ballots.join(votes.select("vote_id"), "vote_id").count()
    assert m.ballots_x.count() == known == m.ballots_x.select("ballot_id").distinct().count()
    assert m.bills.count() == m.raw("dim_bills").select("bill_id").distinct().count()
    assert m.party_vote.groupBy("vote_id", "party_id").count().where("count > 1").isEmpty()
    assert m.mk_service.groupBy("member_id", "knesset_num").count().where("count > 1").isEmpty()


def test_party_vote_and_blocs(m):
    pv = m.party_vote
    assert pv.where("(position = 'for' and n_for <= n_against) or (position = 'split' and n_for <> n_against)").isEmpty()
    assert pv.where("rice is null and n_for + n_against > 0 or rice < 0 or rice > 1").isEmpty()
    total = m.ballots_x.where("party_id is not null and choice = 'for'").count()
    assert pv.agg(F.sum("n_for")).head()[0] == total
    assert m.vote_bloc.where("is_bloc_vote and (coalition_position is null or opposition_position is null or coalition_position = opposition_position)").isEmpty()


def test_shares_and_totals(m):
    c = Q.concept(m)
    for r in P.concept_parties(m, c).collect():
        assert abs(r["for_share"] - r["n_for"] / (r["n_for"] + r["n_against"])) < 1e-6
    rows = P.concept_stages(m, c).collect()
    assert sum(r["n_votes"] for r in rows if r["stage"] is not None) == sum(r["n_votes"] for r in rows if r["stage"] is None)
    who = Q.member(m)
    whole = P.mk_kpi(m, who).head()["n_ballots"]
    terms = [r[0] for r in m.mk_service.where(F.col("member_id") == who).select("knesset_num").collect()]
    assert whole == sum(P.mk_kpi(m, who, k).head()["n_ballots"] for k in terms)


def test_paging(m):
    p = Q.party(m)
    first, second = (P.party_votes(m, p, number=n).collect() for n in (1, 2))
    assert len(first) == min(50, first[0]["total"]) and not {r["vote_id"] for r in first} & {r["vote_id"] for r in second}
    assert all(r["split"] for r in P.party_votes(m, p, split_only=True).collect())


def test_missing_parameters_give_no_rows(m):
    assert P.vote(m, -5).count() == 0 and P.mk_kpi(m, -5).count() == 0 and P.party(m, "none").count() == 0
    assert P.search(m, "x").count() == 0 and P.votes(m, 99).count() == 0


def test_quality_report(m):
    report = quality.quality_report(m)
    rows = {r["check"]: r for r in report.collect()}
    assert rows["duplicate bill_id"]["status"] == "pass" and rows["vote-bill link without bill"]["violations"] > 0
    with pytest.raises(ValueError, match="blocking"):
        quality.raise_on_blocking(report)


def test_all_linked_bills(spark, tmp_path):
    at = dt.datetime(2020, 1, 1)
    def one(rows, shape, name):
        spark.createDataFrame(rows, shape).write.parquet(f"{tmp_path}/{name}.parquet")

    votes = [(1, "2020-02-01", 3, "x"), (2, "2020-01-01", None, "לדחות את ההצעה"), (3, "2020-01-01", 2, "x"), (4, "2020-03-01", None, "x")]
    rows = [(v, 23, f"{d} 10:00:00", "t", said, r, True, 1, "v", 1, 1, 1, at) for v, d, r, said in votes]
    one(rows, "vote_id bigint, knesset_num int, vote_datetime string, item_title string, decision string, reading int, accepted boolean, lu_item_type int, vote_type string, discovery_date int, discovery_date_count int, counter_total int, loaded_at timestamp", "fact_votes")
    one([(1, 1, 1, "f", 7, at)], "ballot_id bigint, vote_id bigint, member_id bigint, source_faction_name string, vote_result_id int, loaded_at timestamp", "fact_ballots")
    one([(1, 10), (1, 20), (1, 20), (2, 10), (2, 20), (3, 20)], "vote_id bigint, bill_id bigint", "bridge_vote_bills")
    one([(20, "b", "s", "p", 23, "c", "s", "i", at)], "bill_id bigint, name string, status string, proposal_type string, knesset_num int, committee_name string, summary string, initiators string, loaded_at timestamp", "dim_bills")
    one([("c", "t")], "committee_name string, topic_id string", "committee_topics")
    m = Model(spark, str(tmp_path), keep=False)
    assert [(str(r["first_vote_date"]), str(r["final_date"])) for r in m.bills.collect()] == [("2020-01-01", "2020-02-01")]
    assert {(r["vote_id"], r["bill_id"], r["stage"]) for r in m.vote_bills.collect()} == {(1, 10, "third"), (1, 20, "third"), (2, 10, "preliminary"), (2, 20, "reservation"), (3, 20, "second")}
    assert {(r["vote_id"], r["bill_id"], r["stage"], r["n_for"]) for r in m.votes.collect()} == {(1, 10, "third", 1), (2, 10, "reservation", 0), (3, 20, "second", 0), (4, None, "other", 0)}
    assert {r["vote_id"] for r in P.bill_path(m, 1).collect()} == {1, 2, 3}
