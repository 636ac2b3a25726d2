"""The catalogue of parameterised analytical queries over the model.

Each function takes the model and its parameters and returns a DataFrame; a
parameter of None or '' means no filter, and predicates are built only when they
are set, so that they reach the scans. Shares are rounded to six digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.functions.sqlfn import arg_max, count_if, days_between, nulls_last, page, safe_div, share, text_filter, top_per_group
from quorumlake.plans.model import COUNTED, Model

C = F.col
FOR_AGAINST = ("for", "against")


def _term(k: int | None) -> Column:
    return F.lit(True) if k is None else C("knesset_num") == k


def _text(name: str) -> Column:
    return C(name).cast("string").alias(name)


def _ratio(a: Column, b: Column, name: str) -> Column:
    return F.round(safe_div(a, b), 6).alias(name)


def _sided(f: Column, a: Column) -> Column:
    return _ratio(F.sum(f), F.sum(f + a), "x")


# search and lookups ------------------------------------------------------------
def search(m: Model, q: str) -> DataFrame:
    q = q.strip()
    hits = m.search_index.where(text_filter(C("label"), q) if len(q) >= 2 else F.lit(False))
    return hits.orderBy("kind", F.length("label"), "id").limit(30)


def parties(m: Model) -> DataFrame:
    return m.parties.orderBy("party_name", "party_id")


def topics(m: Model) -> DataFrame:
    return m.topics.orderBy("topic_name", "topic_id")


# home and laws -----------------------------------------------------------------
def home_counts(m: Model) -> DataFrame:
    one = [
        m.votes.agg(F.count(F.lit(1)).alias("votes"), F.max("vote_date").cast("string").alias("last_date")),
        m.ballots_x.agg(F.count(F.lit(1)).alias("ballots")),
        m.bills.agg(count_if(C("passed")).alias("laws_passed")),
        m.mk_service.agg(F.countDistinct("member_id").alias("mks"), F.countDistinct("last_party_id").alias("parties")),
        m.concepts.agg(count_if(~C("is_generic")).alias("concepts")),
    ]
    out = one[0]
    for x in one[1:]:
        out = out.crossJoin(F.broadcast(x))
    return out


def recent_laws(m: Model, n: int = 20) -> DataFrame:
    final = m.vote_bills.where("stage = 'third'").groupBy("bill_id").agg(arg_max(C("vote_id"), C("ts")).alias("final_vote_id"))
    top = m.bills.where("passed and final_date is not null").orderBy(*nulls_last("-final_date", "-bill_id")).limit(n)
    return top.join(final, "bill_id", "left").select("bill_id", "name", _text("final_date"), "final_vote_id")


def laws_by_year(m: Model) -> DataFrame:
    return m.bills.where("first_vote_date is not null").groupBy(F.year("first_vote_date").alias("year"), "proposal_type", "passed").agg(F.count(F.lit(1)).alias("n"))


def laws_funnel(m: Model, k: int) -> DataFrame:
    return m.vote_bills.where(_term(k) & C("stage").isin(*COUNTED)).groupBy("stage").agg(F.countDistinct("bill_id").alias("bills"))


def laws_time(m: Model) -> DataFrame:
    d = days_between(C("final_date"), C("first_reading_date")).cast("double")
    b = m.bills.where("final_date is not null and first_reading_date is not null").withColumn("d", d)
    return b.groupBy("proposal_type").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.percentile("d", F.lit(q)), 6).alias(name) for q, name in ((0.5, "median_days"), (0.25, "p25"), (0.75, "p75"))])


def laws_consensus(m: Model) -> DataFrame:
    third = m.votes.where("stage = 'third'")
    none = C("n_against") == 0
    return third.groupBy(F.year("vote_date").alias("year")).agg(share(none).alias("zero_against_share"), count_if(none).alias("zero_against"), F.count(F.lit(1)).alias("finals"))


# members -----------------------------------------------------------------------
def members(m: Model, k: int, q: str = "", party: str = "") -> DataFrame:
    s = m.eligible.where(_term(k) & ((C("last_party_id") == party) if party else F.lit(True)))
    named = s.join(m.members.where(text_filter(C("member_name"), q)).select("member_id", "member_name"), "member_id")
    return named.withColumnRenamed("last_party_id", "party_id").join(m.parties, "party_id", "left").select("member_id", "member_name", "party_id", "party_name", "color_index", "n_ballots", _ratio(C("n_ballots"), C("eligible"), "participation"))


def mk_service(m: Model, member: int) -> DataFrame:
    s = m.mk_service.where(C("member_id") == member).join(m.members.select("member_id", "member_name"), "member_id")
    named = s.join(m.parties.withColumnRenamed("party_id", "last_party_id"), "last_party_id", "left")
    return named.select("member_name", "knesset_num", _text("first_date"), _text("last_date"), "last_party_id", "party_name", "n_ballots")


def mk_positions(m: Model, member: int) -> DataFrame:
    g = m.raw("dim_governments").where(C("member_id") == member)
    return g.select("government_id", "position_name", "ministry_name", F.left("start_date", F.lit(10)).alias("start_date"), F.left("finish_date", F.lit(10)).alias("finish_date")).distinct()


def _own(m: Model, member: int, k: int | None) -> DataFrame:
    return m.ballots_x.where((C("member_id") == member) & _term(k))


def _with_party(m: Model, b: DataFrame) -> DataFrame:
    pv = m.party_vote.select("vote_id", "party_id", C("n_for").alias("p_for"), C("n_against").alias("p_against"), "position")
    return b.join(pv, ["vote_id", "party_id"])


def _against_party() -> Column:
    return C("choice").isin(*FOR_AGAINST) & C("position").isin(*FOR_AGAINST) & (C("choice") != C("position")) & (C("p_for") + C("p_against") >= 3)


def mk_kpi(m: Model, member: int, k: int | None = None) -> DataFrame:
    s = m.mk_service.where((C("member_id") == member) & _term(k))
    total = s.agg(F.sum("n_ballots").alias("n_ballots"), F.count(F.lit(1)).alias("n_k"))
    eligible = m.eligible.where((C("member_id") == member) & _term(k)).agg(F.coalesce(F.sum("eligible"), F.lit(0)).alias("eligible"))
    sided = _with_party(m, _own(m, member, k)).where(C("choice").isin(*FOR_AGAINST) & C("position").isin(*FOR_AGAINST) & (C("p_for") + C("p_against") >= 3))
    sided = sided.agg(count_if(C("choice") != C("position")).alias("against_party"), share(C("choice") == C("position")).alias("agreement_with_party"))
    b = m.bill_initiators.where(C("member_id") == member).join(m.bills.select("bill_id", "knesset_num", "passed"), "bill_id").join(s.select("knesset_num"), "knesset_num", "left_semi")
    b = b.agg(F.countDistinct("bill_id").alias("initiated"), F.countDistinct(F.when(C("passed"), C("bill_id"))).alias("passed"))
    days = _own(m, member, k).select("knesset_num", "vote_date").distinct()
    gap = days.withColumn("prev", F.lag("vote_date").over(Window.partitionBy("knesset_num").orderBy("vote_date"))).agg(F.max(days_between(C("vote_date"), C("prev"))).alias("max_gap_days"))
    out = total.where("n_k > 0")
    for x in (eligible, sided, b, gap):
        out = out.crossJoin(F.broadcast(x))
    return out.select("n_ballots", _ratio(C("n_ballots"), C("eligible"), "participation"), "against_party", "agreement_with_party", "initiated", "passed", "max_gap_days")


def mk_yearly(m: Model, member: int, k: int | None = None) -> DataFrame:
    b = _own(m, member, k).where(~C("stage").isin("reservation", "second"))
    return b.groupBy(F.year("vote_date").alias("year")).agg(*[count_if(C("choice") == c).alias(f"n_{c}") for c in ("for", "against", "abstain", "present")])


def mk_participation(m: Model, member: int, k: int | None = None) -> DataFrame:
    me = m.mk_service.where((C("member_id") == member) & _term(k)).select("knesset_num", "last_party_id")
    peers = m.mk_service.join(F.broadcast(me), ["knesset_num", "last_party_id"])
    days = m.votes.where("has_ballots and vote_date is not null").groupBy("knesset_num", "vote_date").agg(F.count(F.lit(1)).alias("n"))
    could = peers.join(days, "knesset_num").where("vote_date between first_date and last_date").groupBy("member_id", F.year("vote_date").alias("year")).agg(F.sum("n").alias("eligible"))
    did = m.ballots_x.join(peers.select("member_id", "knesset_num"), ["member_id", "knesset_num"], "left_semi").groupBy("member_id", F.year("vote_date").alias("year")).agg(F.count(F.lit(1)).alias("cast"))
    both = could.join(did, ["member_id", "year"], "left").withColumn("x", safe_div(F.coalesce("cast", F.lit(0)), C("eligible")))
    return both.groupBy("year").agg(F.round(F.max(F.when(C("member_id") == member, C("x"))), 6).alias("mk"), F.round(F.median("x"), 6).alias("party_median"))


def _tagged(m: Model, concept: str | None = None) -> DataFrame:
    t = m.bill_concepts
    return t.where(C("concept_id") == concept) if concept is not None else t


def _counted_tags(m: Model, concept: str | None = None) -> DataFrame:
    """(vote_id, concept_id), once each, over all linked bills at a counted stage."""
    v = m.vote_bills.where(C("stage").isin(*COUNTED)).select("vote_id", "bill_id")
    return v.join(_tagged(m, concept).select("bill_id", "concept_id"), "bill_id").select("vote_id", "concept_id").distinct()


def mk_concepts(m: Model, member: int, k: int | None = None) -> DataFrame:
    b = _own(m, member, k).where(C("choice").isin(*FOR_AGAINST))
    c = m.concepts.where("not is_generic").select("concept_id", "concept_label")
    t = _with_party(m, b).join(_counted_tags(m), "vote_id").join(c, "concept_id")
    out = t.groupBy("concept_id", "concept_label").agg(
        F.count(F.lit(1)).alias("n_votes"), share(C("choice") == "for").alias("a_share"), count_if(C("choice") == "for").alias("a_for"), count_if(C("choice") == "against").alias("a_against"),
        _sided(C("p_for"), C("p_against")).alias("b_share"), F.sum("p_for").alias("b_for"), F.sum("p_against").alias("b_against"),
    )
    return out.where("n_votes >= 5").orderBy(*nulls_last("-n_votes", "concept_label", "concept_id")).limit(50)


def mk_concept_votes(m: Model, concept: str, member: int, k: int | None = None) -> DataFrame:
    b = _own(m, member, k).where(C("choice").isin(*FOR_AGAINST)).drop("bill_id", "stage")
    tagged = _tagged(m, concept).select("bill_id", C("primary_evidence_bullet_id").alias("bullet_row_id"))
    t = _with_party(m, b).join(m.vote_bills.where(C("stage").isin(*COUNTED)).select("vote_id", "bill_id", "stage"), "vote_id").join(tagged, "bill_id")
    t = t.join(m.votes.select("vote_id", "ts", "item_title"), "vote_id").join(m.bullets.select("bullet_row_id", "bullet"), "bullet_row_id", "left")
    return t.orderBy(*nulls_last("-ts", "-vote_id")).limit(200).select("vote_id", _text("vote_date"), "item_title", "stage", "choice", "position", "bullet")


def mk_votes(m: Model, member: int, k: int | None = None, against_only: bool = False, number: int = 1) -> DataFrame:
    t = _with_party(m, _own(m, member, k)).withColumn("against_party", _against_party())
    t = t.where("against_party") if against_only else t
    t = t.join(m.votes.select("vote_id", "ts", "item_title"), "vote_id").select("vote_id", _text("vote_date"), "item_title", "stage", "choice", "position", "against_party", "ts", "ballot_id")
    return page(t, nulls_last("-ts", "-vote_id", "ballot_id"), number).drop("ts", "ballot_id")


def mk_similar(m: Model, member: int, k: int | None = None, exclude_bloc: bool = False, at_least: int = 100) -> DataFrame:
    mine = _own(m, member, k).where(C("choice").isin(*FOR_AGAINST)).select("vote_id", C("choice").alias("own"))
    bloc = m.vote_bloc.where("not is_bloc_vote") if exclude_bloc else m.vote_bloc
    o = m.ballots_x.where((C("member_id") != member) & C("choice").isin(*FOR_AGAINST)).join(mine, "vote_id").join(bloc.select("vote_id"), "vote_id", "left_semi")
    sim = o.groupBy("member_id").agg(arg_max(C("party_id"), C("vote_date")).alias("party_id"), F.count(F.lit(1)).alias("n_common"), share(C("choice") == C("own")).alias("agreement")).where(C("n_common") >= at_least)
    last = m.mk_service.where((C("member_id") == member) & _term(k)).agg(arg_max(C("last_party_id"), C("knesset_num")).alias("own_party"))
    out = sim.join(m.members.select("member_id", "member_name"), "member_id").join(m.parties, "party_id", "left").crossJoin(F.broadcast(last)).withColumn("cross_party", ~C("party_id").eqNullSafe(C("own_party")))
    return out.orderBy(*nulls_last("-agreement", "-n_common", "member_id")).limit(20).select("member_id", "member_name", "party_id", "party_name", "color_index", "n_common", "agreement", "cross_party")


def mk_bills(m: Model, member: int, k: int | None = None) -> DataFrame:
    b = m.bills.where(_term(k)).join(m.bill_initiators.where(C("member_id") == member).select("bill_id").distinct(), "bill_id").join(m.last_vote, "bill_id", "left")
    reached = F.when(C("passed"), "passed").when(C("first_reading_date").isNotNull(), "first").otherwise("preliminary")
    return b.select("bill_id", "name", "status", reached.alias("reached"), "last_vote_id")


def mk_stints(m: Model, member: int) -> DataFrame:
    return m.stints.where((C("member_id") == member) & (C("knesset_num") >= 16)).select("knesset_num", "faction_name", _text("start_date"))


def coverage(m: Model) -> DataFrame:
    return m.votes.groupBy("knesset_num").agg(F.count(F.lit(1)).alias("votes"), F.countDistinct("vote_date").alias("days"), count_if(C("stage") == "third").alias("finals"), F.min("vote_date").cast("string").alias("first_date"), F.max("vote_date").cast("string").alias("last_date"))


# concepts ----------------------------------------------------------------------
def concept(m: Model, concept_id: str) -> DataFrame:
    n = _tagged(m, concept_id).select("bill_id").join(m.vote_bills.select("bill_id", "vote_id"), "bill_id").agg(F.countDistinct("vote_id").alias("n_votes"))
    return m.concepts.where(C("concept_id") == concept_id).crossJoin(F.broadcast(n))


def _concept_ballots(m: Model, concept_id: str) -> DataFrame:
    b = m.ballots_x.where(C("choice").isin(*FOR_AGAINST) & C("party_id").isNotNull())
    return b.join(_counted_tags(m, concept_id), "vote_id", "left_semi")


def concept_parties(m: Model, concept_id: str) -> DataFrame:
    t = _concept_ballots(m, concept_id).groupBy("party_id").agg(share(C("choice") == "for").alias("for_share"), F.countDistinct("vote_id").alias("n_votes"), count_if(C("choice") == "for").alias("n_for"), count_if(C("choice") == "against").alias("n_against"))
    return t.join(m.parties, "party_id").orderBy(*nulls_last("-n_votes", "party_id")).limit(12).select("party_id", "party_name", "color_index", "for_share", "n_votes", "n_for", "n_against")


def concept_stages(m: Model, concept_id: str) -> DataFrame:
    """By stage, and totals of counted and uncounted stages (their stage is null)."""
    v = m.vote_bills.join(_tagged(m, concept_id).select("bill_id"), "bill_id").withColumn("is_counted", C("stage").isin(*COUNTED))
    sets = v.groupingSets([[C("stage")], [C("is_counted")]], C("stage"), C("is_counted"))
    out = sets.agg(F.countDistinct("vote_id").alias("n_votes"), F.countDistinct(F.when(C("n_against") > 0, C("vote_id"))).alias("n_contested"), F.countDistinct("bill_id").alias("n_bills"))
    return out.select("stage", F.coalesce("is_counted", C("stage").isin(*COUNTED)).alias("counted"), "n_votes", "n_contested", "n_bills")


def concept_bills(m: Model, concept_id: str) -> DataFrame:
    b = m.bills.join(_tagged(m, concept_id).select("bill_id"), "bill_id").join(m.last_vote, "bill_id", "left")
    return b.orderBy(*nulls_last("-first_vote_date", "bill_id")).select("bill_id", "name", "knesset_num", "proposal_type", "passed", _text("final_date"), "last_vote_id")


def _evidence(m: Model, tagged: DataFrame) -> DataFrame:
    """Bullets of a list column by an equi-join on its exploded ids."""
    ids = tagged.select("bill_id", "concept_id", "bill_bullet_share", "primary_evidence_bullet_id", F.explode(F.array_distinct("bullet_ids")).alias("bullet_row_id"))
    return ids.join(m.bullets.select("bullet_row_id", "bullet"), "bullet_row_id").withColumn("is_primary", C("bullet_row_id") == C("primary_evidence_bullet_id"))


def concept_evidence(m: Model, concept_id: str) -> DataFrame:
    return _evidence(m, _tagged(m, concept_id)).orderBy(*nulls_last("bill_id", "-is_primary", "bullet_row_id")).select("bill_id", "bullet", "is_primary")


def concept_contested(m: Model, concept_id: str, at_least: int = 10) -> DataFrame:
    ids = m.vote_bills.join(_tagged(m, concept_id).select("bill_id"), "bill_id").select("vote_id")
    v = m.votes.where(C("n_against") >= at_least).join(ids, "vote_id", "left_semi")
    return v.orderBy(*nulls_last("-ts", "-vote_id")).limit(50).select("vote_id", _text("vote_date"), "item_title", "stage", "n_for", "n_against", "n_abstain", "accepted")


def concept_yearly(m: Model, concept_id: str) -> DataFrame:
    b = m.bills.where("first_vote_date is not null").join(_tagged(m, concept_id).select("bill_id"), "bill_id")
    return b.groupBy(F.year("first_vote_date").alias("year")).agg(F.countDistinct(F.when(C("passed"), C("bill_id"))).alias("n_passed"), F.countDistinct(F.when(~C("passed"), C("bill_id"))).alias("n_other"))


def concept_party_terms(m: Model, concept_id: str, n: int = 6) -> DataFrame:
    b = _concept_ballots(m, concept_id)
    top = b.groupBy("party_id").agg(F.countDistinct("vote_id").alias("n")).orderBy(*nulls_last("-n", "party_id")).limit(n).select("party_id")
    t = b.join(F.broadcast(top), "party_id").groupBy("knesset_num", "party_id").agg(share(C("choice") == "for").alias("for_share"), F.countDistinct("vote_id").alias("n_votes"))
    return t.join(m.parties, "party_id").select("knesset_num", "party_id", "party_name", "color_index", "for_share", "n_votes")


def concepts_summary(m: Model) -> DataFrame:
    own = m.concepts.agg(count_if(~C("is_generic")).alias("n_concepts"), count_if(C("is_generic")).alias("n_generic"), F.min("k_from").alias("k_from"), F.max("k_to").alias("k_to"))
    return own.crossJoin(F.broadcast(m.bill_concepts.agg(F.countDistinct("bill_id").alias("n_bills"))))


def concepts_list(m: Model, generic: bool = False, q: str = "") -> DataFrame:
    c = m.concepts.where((C("is_generic") == generic) & text_filter(C("concept_label"), q)).select("concept_id", "concept_label", "n_bills", "k_from", "k_to")
    t = _tagged(m).select("concept_id", "bill_id").join(c, "concept_id").join(m.bills.select("bill_id", "passed"), "bill_id").join(m.vote_bills.select("bill_id", "vote_id"), "bill_id", "left")
    out = t.groupBy(*c.columns).agg(F.countDistinct("vote_id").alias("n_votes"), F.countDistinct(F.when(C("passed"), C("bill_id"))).alias("n_passed"))
    return out.orderBy(*nulls_last("-n_bills", "concept_label", "concept_id")).limit(60)


def concepts_yearly(m: Model, n: int = 5) -> DataFrame:
    top = m.concepts.where("not is_generic").orderBy(*nulls_last("-n_bills", "concept_id")).limit(n)
    top = top.withColumn("rn", F.row_number().over(Window.orderBy(*nulls_last("-n_bills", "concept_id"))).cast("bigint")).select("concept_id", "concept_label", "rn")
    b = m.bills.where("first_vote_date is not null").select("bill_id", F.year("first_vote_date").alias("year"))
    return _tagged(m).select("concept_id", "bill_id").join(F.broadcast(top), "concept_id").join(b, "bill_id").groupBy("year", "rn", "concept_id", "concept_label").agg(F.countDistinct("bill_id").alias("n_bills"))


def concepts_trend(m: Model, at_least: int = 3, term_bills: int = 50) -> DataFrame:
    b = _tagged(m).select("concept_id", "bill_id").join(m.bills.select("bill_id", "knesset_num"), "bill_id")
    terms = b.groupBy("knesset_num").agg(F.countDistinct("bill_id").alias("n")).where(C("n") >= term_bills)
    two = terms.orderBy(C("knesset_num").desc()).limit(2).agg(F.max(F.struct("knesset_num", "n")).alias("b"), F.min(F.struct("knesset_num", "n")).alias("a"), F.count(F.lit(1)).alias("n")).where("n = 2")
    two = two.select(C("a.knesset_num").alias("k1"), C("a.n").alias("all1"), C("b.knesset_num").alias("k2"), C("b.n").alias("all2"))
    c = m.concepts.where("not is_generic").select("concept_id", "concept_label")
    t = b.join(c, "concept_id").crossJoin(F.broadcast(two)).where("knesset_num in (k1, k2)").groupBy("concept_id", "concept_label", "k1", "k2", "all1", "all2")
    t = t.agg(*[F.countDistinct(F.when(C("knesset_num") == C(f"k{i}"), C("bill_id"))).alias(f"n{i}") for i in (1, 2)]).where(C("n1") + C("n2") >= at_least)
    s1, s2 = safe_div(C("n1"), C("all1")), safe_div(C("n2"), C("all2"))
    return t.select("concept_id", "concept_label", "k1", "k2", "n1", "n2", F.round(s1, 6).alias("share1"), F.round(s2, 6).alias("share2"), F.round(s2 - s1, 6).alias("delta"))


# parties -----------------------------------------------------------------------
def parties_list(m: Model, k: int) -> DataFrame:
    side = m.party_vote.where(_term(k)).groupBy("party_id").agg(share(C("is_coalition")).alias("coalition_share"))
    p = m.eligible.where(_term(k)).groupBy(C("last_party_id").alias("party_id")).agg(F.count(F.lit(1)).alias("n_mks"), _ratio(F.sum("n_ballots"), F.sum("eligible"), "participation"))
    return p.join(m.parties, "party_id").join(side, "party_id", "left").select("party_id", "party_name", "color_index", "n_mks", "participation", "coalition_share")


def parties_faces(m: Model, k: int, n: int = 5) -> DataFrame:
    s = m.mk_service.where(_term(k)).join(m.members.select("member_id", "member_name"), "member_id")
    return top_per_group(s, ["last_party_id"], nulls_last("-n_ballots", "member_id"), n).select(C("last_party_id").alias("party_id"), "member_id", "member_name")


def party(m: Model, party_id: str) -> DataFrame:
    served = m.mk_service.where(C("last_party_id") == party_id).select(C("last_party_id").alias("party_id"), "knesset_num").distinct()
    return m.parties.join(served, "party_id")


def party_coalition(m: Model, party_id: str, k: int | None = None) -> DataFrame:
    c = m.raw("coalition_membership").where((C("party_id") == party_id) & _term(k))
    return c.select("knesset_num", C("`start`").cast("string").alias("start"), C("`end`").cast("string").alias("end"), "kind").distinct()


def party_kpi(m: Model, party_id: str, k: int | None = None) -> DataFrame:
    own = m.eligible.where((C("last_party_id") == party_id) & _term(k)).agg(F.countDistinct("member_id").alias("n_mks"), _ratio(F.sum("n_ballots"), F.sum("eligible"), "participation"))
    stages = m.votes.where(C("stage").isin(*COUNTED)).select("vote_id")
    pv = m.party_vote.where((C("party_id") == party_id) & _term(k)).join(stages, "vote_id").join(m.vote_bloc, "vote_id")
    apart = C("position").isin(*FOR_AGAINST) & (C("coalition_position") != C("opposition_position"))
    kp = pv.agg(F.round(F.avg("rice"), 6).alias("cohesion"), share(F.when(apart, C("position") == C("coalition_position"))).alias("sided_with_coalition"))
    return own.crossJoin(F.broadcast(kp))


def party_concepts(m: Model, party_id: str, k: int | None = None) -> DataFrame:
    house = m.party_vote.groupBy("vote_id").agg(F.sum("n_for").alias("k_for"), F.sum("n_against").alias("k_against"))
    pv = m.party_vote.where((C("party_id") == party_id) & _term(k) & (C("n_for") + C("n_against") > 0)).select("vote_id", "n_for", "n_against")
    c = m.concepts.where("not is_generic").select("concept_id", "concept_label")
    t = pv.join(_counted_tags(m), "vote_id").join(house, "vote_id").join(c, "concept_id")
    out = t.groupBy("concept_id", "concept_label").agg(
        F.count(F.lit(1)).alias("n_votes"), _sided(C("n_for"), C("n_against")).alias("a_share"), F.sum("n_for").alias("a_for"), F.sum("n_against").alias("a_against"), _sided(C("k_for"), C("k_against")).alias("b_share"), F.sum("k_for").alias("b_for"), F.sum("k_against").alias("b_against")
    )
    return out.where("n_votes >= 5").orderBy(*nulls_last("-n_votes", "concept_label", "concept_id")).limit(50)


def party_votes(m: Model, party_id: str, k: int | None = None, split_only: bool = False, least_cohesive: bool = False, number: int = 1) -> DataFrame:
    pv = m.party_vote.where((C("party_id") == party_id) & _term(k)).withColumn("split", (C("n_for") + C("n_against") >= 3) & (C("rice") < 1))
    pv = pv.where("split") if split_only else pv
    own = pv.select("vote_id", "position", C("n_for").alias("p_for"), C("n_against").alias("p_against"), C("n_abstain").alias("p_abstain"), "split", "rice")
    t = own.join(m.votes.select("vote_id", "vote_date", "item_title", "stage", "ts"), "vote_id").select("vote_id", _text("vote_date"), "item_title", "stage", "position", C("p_for").alias("n_for"), C("p_against").alias("n_against"), C("p_abstain").alias("n_abstain"), "split", "rice", "ts")
    order = nulls_last(*(["rice"] if least_cohesive else []), "-ts", "-vote_id")
    return page(t, order, number).drop("rice", "ts")


def party_bills(m: Model, party_id: str, k: int | None = None) -> DataFrame:
    s = m.mk_service.where((C("last_party_id") == party_id) & _term(k)).select("member_id", "knesset_num")
    ids = m.bill_initiators.where("member_id is not null").join(m.bills.select("bill_id", "knesset_num"), "bill_id").join(s, ["member_id", "knesset_num"]).select("bill_id").distinct()
    return m.bills.join(ids, "bill_id").join(m.last_vote, "bill_id", "left").select("bill_id", "name", "status", "passed", "last_vote_id")


def party_members(m: Model, party_id: str, k: int | None = None) -> DataFrame:
    s = m.eligible.where((C("last_party_id") == party_id) & _term(k)).groupBy("member_id").agg(F.sum("n_ballots").alias("n_ballots"), F.sum("eligible").alias("eligible"))
    return s.join(m.members.select("member_id", "member_name"), "member_id").select("member_id", "member_name", "n_ballots", _ratio(C("n_ballots"), C("eligible"), "participation"))


# votes -------------------------------------------------------------------------
def vote(m: Model, vote_id: int) -> DataFrame:
    return m.votes.where(C("vote_id") == vote_id).select("vote_id", "knesset_num", _text("vote_date"), "item_title", "decision", "reading", "accepted", "vote_type", "bill_id", "n_for", "n_against", "n_abstain", "has_ballots", "stage")


def _serving(m: Model, vote_id: int) -> DataFrame:
    """Members whose window holds the vote's day, with their ballot if they cast one."""
    v = m.votes.where(C("vote_id") == vote_id).select("knesset_num", "vote_date")
    s = m.mk_service.join(F.broadcast(v), "knesset_num").where("vote_date between first_date and last_date").select("member_id", "last_party_id")
    cast = m.ballots_x.where(C("vote_id") == vote_id).select("member_id", C("party_id").alias("cast_party"), "choice")
    return s.join(cast, "member_id", "left").withColumn("party_id", F.coalesce("cast_party", "last_party_id"))


def vote_by_party(m: Model, vote_id: int) -> DataFrame:
    t = _serving(m, vote_id).groupBy("party_id").agg(*[count_if(C("choice") == c).alias(f"n_{c}") for c in ("for", "against", "abstain")], count_if(C("choice").isNull()).alias("n_absent"))
    return t.join(m.parties, "party_id").select("party_id", "party_name", "color_index", "n_for", "n_against", "n_abstain", "n_absent")


def vote_mks(m: Model, vote_id: int) -> DataFrame:
    t = _serving(m, vote_id).join(m.members.select("member_id", "member_name"), "member_id").join(m.parties, "party_id", "left")
    return t.select("member_id", "member_name", "party_name", F.coalesce("choice", F.lit("absent")).alias("choice"))


def _bills_of(m: Model, vote_id: int) -> DataFrame:
    """All bills linked to a vote."""
    return F.broadcast(m.vote_bills.where(C("vote_id") == vote_id).select("bill_id"))


def bill_path(m: Model, vote_id: int) -> DataFrame:
    ids = m.vote_bills.select("bill_id", "vote_id").join(_bills_of(m, vote_id), "bill_id").select("vote_id")
    return m.votes.join(ids, "vote_id", "left_semi").orderBy(*nulls_last("ts", "vote_id")).select("vote_id", _text("vote_date"), "stage", "decision", "accepted", "n_for", "n_against")


def vote_concepts(m: Model, vote_id: int) -> DataFrame:
    tagged = _tagged(m).join(_bills_of(m, vote_id), "bill_id").groupBy("concept_id").agg(F.max("bill_bullet_share").alias("bill_bullet_share"))
    t = tagged.join(m.concepts.select("concept_id", "concept_label", "is_generic"), "concept_id")
    return t.orderBy(*nulls_last("is_generic", "-bill_bullet_share", "concept_id")).select("concept_id", "concept_label", "is_generic")


def vote_evidence(m: Model, vote_id: int) -> DataFrame:
    t = _evidence(m, _tagged(m).join(_bills_of(m, vote_id), "bill_id")).join(m.concepts.select("concept_id", "concept_label", "is_generic"), "concept_id")
    return t.orderBy(*nulls_last("is_generic", "-bill_bullet_share", "-is_primary", "bullet_row_id", "concept_id")).select("concept_id", "concept_label", "bullet", "is_primary")


def _listed(m: Model, k: int, stage: str, topic: str, q: str, contested: bool) -> DataFrame:
    v = m.votes.where(_term(k) & text_filter(C("item_title"), q))
    v = v.where(C("stage") == stage) if stage != "all" else v
    v = v.where("n_against >= 10") if contested else v
    ids = m.vote_bills.select("bill_id", "vote_id").join(m.bills.where(C("topic_id") == topic).select("bill_id"), "bill_id").select("vote_id")
    return v.join(ids, "vote_id", "left_semi") if topic else v


def votes(m: Model, k: int, stage: str = "all", topic: str = "", q: str = "", contested: bool = False, number: int = 1) -> DataFrame:
    v = _listed(m, k, stage, topic, q, contested).select("vote_id", _text("vote_date"), "item_title", "stage", "n_for", "n_against", "n_abstain", "accepted", "ts")
    return page(v, nulls_last("-ts", "-vote_id"), number).drop("ts")


def votes_summary(m: Model, k: int, stage: str = "all", topic: str = "", q: str = "", contested: bool = False) -> DataFrame:
    return _listed(m, k, stage, topic, q, contested).agg(F.count(F.lit(1)).alias("n"), share(C("accepted")).alias("accepted_share"), count_if(C("n_against") >= 10).alias("contested"))


