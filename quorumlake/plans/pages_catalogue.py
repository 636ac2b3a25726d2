"""Registered queries of the model with the parameters picked from the data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.functions.sqlfn import nulls_last
from quorumlake.plans import pages as P
from quorumlake.plans.model import Model

C = F.col


def _first(df: DataFrame, default=None):
    row = df.head()
    return row[0] if row else default


def term(m: Model) -> int:
    """The term with most votes."""
    return _first(m.votes.groupBy("knesset_num").agg(F.count(F.lit(1)).alias("n")).orderBy(*nulls_last("-n", "-knesset_num")).limit(1), -1)


def member(m: Model) -> int:
    """The known member with most ballots."""
    known = m.ballots_x.join(m.members.select("member_id"), "member_id", "left_semi")
    return _first(known.groupBy("member_id").agg(F.count(F.lit(1)).alias("n")).orderBy(*nulls_last("-n", "member_id")).limit(1), -1)


def minister(m: Model) -> int:
    """The member with most government positions."""
    g = m.raw("dim_governments").where("member_id is not null").groupBy("member_id").agg(F.count(F.lit(1)).alias("n"))
    return _first(g.orderBy(*nulls_last("-n", "member_id")).limit(1), -1)


def party(m: Model) -> str:
    """The party with most votes."""
    return _first(m.party_vote.groupBy("party_id").agg(F.count(F.lit(1)).alias("n")).orderBy(*nulls_last("-n", "party_id")).limit(1), "")


def concept(m: Model) -> str:
    """The concept with most bills."""
    return _first(m.concepts.orderBy(*nulls_last("-n_bills", "concept_id")).select("concept_id").limit(1), "")


def vote(m: Model) -> int:
    """The most attended vote on a bill with evidence for its concepts."""
    shown = m.bill_concepts.join(m.bullets.select(C("bullet_row_id").alias("primary_evidence_bullet_id")), "primary_evidence_bullet_id", "left_semi")
    v = m.votes.join(shown.select("bill_id").distinct(), "bill_id", "left_semi").withColumn("n", C("n_for") + C("n_against"))
    return _first(v.orderBy(*nulls_last("-n", "vote_id")).select("vote_id").limit(1), -1)


def topic(m: Model) -> str:
    """The topic with most bills."""
    return _first(m.bills.where("topic_id is not null").groupBy("topic_id").agg(F.count(F.lit(1)).alias("n")).orderBy(*nulls_last("-n", "topic_id")).select("topic_id").limit(1), "")


def _text(*names: str) -> list:
    return [C(n).cast("string").alias(n) for n in names]


MODEL: dict[str, Callable[[Model], DataFrame]] = {
    "v01_votes": lambda m: m.votes.select("vote_id", "knesset_num", C("ts").cast("string").alias("ts"), "item_title", "decision", "reading", "accepted", "bill_id", "n_for", "n_against", "n_abstain", "has_ballots"),
    "v02_vote_stage": lambda m: m.votes.select("vote_id", "stage"),
    "v03_stints": lambda m: m.stints.select("member_id", "knesset_num", "faction_name", *_text("start_date")),
    "v04_bills": lambda m: m.bills.select("bill_id", "name", "status", "proposal_type", "knesset_num", "committee_name", "passed", "topic_id", *_text("first_vote_date", "first_reading_date", "final_date")),
    "v05_concepts": lambda m: m.concepts,
    "v06_ballots_x": lambda m: m.ballots_x.withColumn("vote_date", C("vote_date").cast("string")),
    "v07_party_vote": lambda m: m.party_vote.withColumn("rice", F.round("rice", 6)),
    "v08_vote_bloc": lambda m: m.vote_bloc,
    "v09_mk_service": lambda m: m.mk_service.select("member_id", "knesset_num", *_text("first_date", "last_date"), "last_party_id", "n_ballots"),
    "v10_bill_initiators": lambda m: m.bill_initiators,
    "v11_search_index": lambda m: m.search_index,
    "q01_search": lambda m: P.search(m, "ים"),
    "q02_parties": P.parties,
    "q03_topics": P.topics,
    "q04_home_counts": P.home_counts,
    "q05_recent_laws": P.recent_laws,
    "q06_laws_by_year": P.laws_by_year,
    "q07_laws_funnel": lambda m: P.laws_funnel(m, term(m)),
    "q08_laws_time": P.laws_time,
    "q09_laws_consensus": P.laws_consensus,
    "q10_members": lambda m: P.members(m, term(m)),
    "q11_mk_service": lambda m: P.mk_service(m, member(m)),
    "q12_mk_positions": lambda m: P.mk_positions(m, minister(m)),
    "q13_mk_kpi": lambda m: P.mk_kpi(m, member(m)),
    "q14_mk_yearly": lambda m: P.mk_yearly(m, member(m)),
    "q15_mk_participation": lambda m: P.mk_participation(m, member(m)),
    "q16_mk_concepts": lambda m: P.mk_concepts(m, member(m)),
    "q17_mk_concept_votes": lambda m: P.mk_concept_votes(m, concept(m), member(m)),
    "q18_mk_votes": lambda m: P.mk_votes(m, member(m)),
    "q19_mk_similar": lambda m: P.mk_similar(m, member(m)),
    "q20_mk_bills": lambda m: P.mk_bills(m, member(m)),
    "q21_mk_stints": lambda m: P.mk_stints(m, member(m)),
    "q22_coverage": P.coverage,
    "q23_concept": lambda m: P.concept(m, concept(m)),
    "q24_concept_parties": lambda m: P.concept_parties(m, concept(m)),
    "q25_concept_stages": lambda m: P.concept_stages(m, concept(m)),
    "q26_concept_bills": lambda m: P.concept_bills(m, concept(m)),
    "q27_concept_evidence": lambda m: P.concept_evidence(m, concept(m)),
    "q28_concept_contested": lambda m: P.concept_contested(m, concept(m)),
    "q29_concept_yearly": lambda m: P.concept_yearly(m, concept(m)),
    "q30_concept_party_terms": lambda m: P.concept_party_terms(m, concept(m)),
    "q31_concepts_summary": P.concepts_summary,
    "q32_concepts_list": P.concepts_list,
    "q33_concepts_yearly": P.concepts_yearly,
    "q34_concepts_trend": P.concepts_trend,
    "q35_parties_list": lambda m: P.parties_list(m, term(m)),
    "q36_parties_faces": lambda m: P.parties_faces(m, term(m)),
    "q37_party": lambda m: P.party(m, party(m)),
    "q38_party_coalition": lambda m: P.party_coalition(m, party(m)),
    "q39_party_kpi": lambda m: P.party_kpi(m, party(m)),
    "q40_party_concepts": lambda m: P.party_concepts(m, party(m)),
    "q41_party_votes": lambda m: P.party_votes(m, party(m), least_cohesive=True),
    "q42_party_bills": lambda m: P.party_bills(m, party(m)),
    "q43_party_members": lambda m: P.party_members(m, party(m)),
    "q44_vote": lambda m: P.vote(m, vote(m)),
    "q45_vote_by_party": lambda m: P.vote_by_party(m, vote(m)),
    "q46_vote_mks": lambda m: P.vote_mks(m, vote(m)),
    "q47_bill_path": lambda m: P.bill_path(m, vote(m)),
    "q48_vote_concepts": lambda m: P.vote_concepts(m, vote(m)),
    "q49_vote_evidence": lambda m: P.vote_evidence(m, vote(m)),
    "q50_votes": lambda m: P.votes(m, term(m), stage="first", q="חוק"),
    "q51_votes_summary": lambda m: P.votes_summary(m, term(m), stage="first", q="חוק"),
    # the same with the filters that are off above
    "q10_members_of_party": lambda m: P.members(m, term(m), q="א", party=party(m)),
    "q13_mk_kpi_term": lambda m: P.mk_kpi(m, member(m), term(m)),
    "q14_mk_yearly_term": lambda m: P.mk_yearly(m, member(m), term(m)),
    "q18_mk_votes_against": lambda m: P.mk_votes(m, member(m), against_only=True),
    "q18_mk_votes_page2": lambda m: P.mk_votes(m, member(m), term(m), number=2),
    "q19_mk_similar_free": lambda m: P.mk_similar(m, member(m), exclude_bloc=True, at_least=10),
    "q28_concept_contested_few": lambda m: P.concept_contested(m, concept(m), at_least=3),
    "q32_concepts_generic": lambda m: P.concepts_list(m, generic=True, q="ה"),
    "q39_party_kpi_term": lambda m: P.party_kpi(m, party(m), term(m)),
    "q41_party_votes_split": lambda m: P.party_votes(m, party(m), term(m), split_only=True),
    "q41_party_votes_page2": lambda m: P.party_votes(m, party(m), least_cohesive=True, number=2),
    "q50_votes_contested": lambda m: P.votes(m, term(m), topic=topic(m), contested=True),
    "q50_votes_page2": lambda m: P.votes(m, term(m), number=2),
    "q51_votes_contested": lambda m: P.votes_summary(m, term(m), topic=topic(m), contested=True),
}


def _bind(f: Callable[[Model], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: f(Model.of(spark, sf))


QUERIES = {name: _bind(f) for name, f in MODEL.items()}
