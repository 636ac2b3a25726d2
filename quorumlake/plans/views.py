"""Shapes in which the analytical results are shown: pivots, slices, fills."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.functions.dates import to_day
from quorumlake.functions.sqlfn import nulls_last
from quorumlake.plans import pages as P
from quorumlake.plans import pages_catalogue as Q
from quorumlake.plans.model import COUNTED, Model

C = F.col


def laws_wide(m: Model) -> DataFrame:
    """Bills per year, one column per outcome."""
    p = P.laws_by_year(m).groupBy("year").pivot("passed", [True, False]).agg(F.sum("n"))
    return p.select("year", F.coalesce("true", F.lit(0)).alias("n_passed"), F.coalesce("false", F.lit(0)).alias("n_other"))


def concepts_wide(m: Model, n: int = 5) -> DataFrame:
    """Bills per year, one column per rank of the leading concepts."""
    p = P.concepts_yearly(m, n).groupBy("year").pivot("rn", list(range(1, n + 1))).agg(F.sum("n_bills"))
    return p.select("year", *[F.coalesce(str(i), F.lit(0)).alias(f"c{i}") for i in range(1, n + 1)])


def concept_terms_wide(m: Model, concept_id: str) -> DataFrame:
    """For-share per term, one column per party; nothing for fewer than two terms."""
    long = P.concept_party_terms(m, concept_id)
    terms = long.agg(F.countDistinct("knesset_num").alias("n_terms"))
    wide = long.groupBy("knesset_num").agg(F.array_sort(F.collect_list(F.struct("party_id", "for_share"))).alias("x"))
    return wide.crossJoin(F.broadcast(terms)).where("n_terms >= 2").select("knesset_num", F.to_json(F.map_from_entries("x")).alias("shares"))


def member_median(m: Model, k: int) -> DataFrame:
    """Median participation of the listed members, null for none."""
    return P.members(m, k).agg(F.round(F.median("participation"), 6).alias("median_participation"))


def evidence_by_bill(m: Model, concept_id: str) -> DataFrame:
    """Evidence of each bill as one ordered list, primary first."""
    e = P.concept_evidence(m, concept_id)
    return e.groupBy("bill_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((~F.coalesce("is_primary", F.lit(False))).alias("later"), "bullet"))), lambda x: x["bullet"]).alias("bullets"))


def concept_uncounted(m: Model, concept_id: str) -> DataFrame:
    """Contested votes of the stages that are not counted, and whether all counted
    votes were unanimous."""
    s = P.concept_stages(m, concept_id)
    total = F.max(F.when(C("stage").isNull() & C("counted"), C("n_contested")))
    return s.agg(F.coalesce(F.sum(F.when(C("stage").isin("reservation", "second"), C("n_contested"))), F.lit(0)).alias("n_contested_uncounted"), (F.coalesce(total, F.lit(0)) == 0).alias("all_consensus"))


def position_titles(m: Model, member: int, n: int = 8) -> DataFrame:
    """Distinct titles of a member, with the ministry where there is one, newest first."""
    p = m.raw("dim_governments").where(C("member_id") == member)
    title = F.concat_ws(" - ", "position_name", F.nullif(F.trim("ministry_name"), F.lit("")))
    t = p.groupBy(title.alias("title")).agg(F.max(to_day(C("start_date"))).alias("latest"))
    return t.orderBy(*nulls_last("-latest", "title")).limit(n)


def served_in_term(m: Model, member: int) -> DataFrame:
    """Terms of a member, and whether a government position overlaps each."""
    g = m.raw("dim_governments").where(C("member_id") == member).select(to_day(C("start_date")).alias("s"), to_day(C("finish_date")).alias("e")).where("s is not null").distinct()
    t = m.mk_service.where(C("member_id") == member).select("knesset_num", "first_date", "last_date")
    met = t.join(g, (C("s") <= C("last_date")) & (C("e").isNull() | (C("e") >= C("first_date"))), "left_semi").select("knesset_num", F.lit(True).alias("x"))
    return t.join(met, "knesset_num", "left").select("knesset_num", F.coalesce("x", F.lit(False)).alias("in_government"))


def coalition_seats(m: Model, k: int) -> DataFrame:
    """Members of the parties that sat in the coalition for at least half of the votes."""
    return P.parties_list(m, k).agg(F.coalesce(F.sum(F.when(C("coalition_share") >= 0.5, C("n_mks"))), F.lit(0)).alias("seats"))


def funnel_filled(m: Model, k: int) -> DataFrame:
    """The funnel with every counted stage, zero where no bill was."""
    stages = m.spark.createDataFrame([(s,) for s in COUNTED], "stage string")
    return F.broadcast(stages).join(P.laws_funnel(m, k), "stage", "left").select("stage", F.coalesce("bills", F.lit(0)).alias("bills"))


def known_term(m: Model, asked: str | int | None) -> int | None:
    """The term asked for; None for all; the latest there is for an unknown one."""
    if asked in (None, "all"):
        return None
    have = {r[0] for r in m.votes.select("knesset_num").distinct().collect()}  # a handful of terms
    return int(asked) if str(asked).isdigit() and int(asked) in have else max(have, default=None)


def percent(share: float | None) -> str:
    """A share as whole per cent, an en dash for none."""
    return "–" if share is None else f"{round(share * 100)}%"


def initials(name: str) -> str:
    """First letters of the first two words."""
    return "".join(w[0] for w in name.split()[:2])


MODEL = {
    "c01_laws_wide": laws_wide,
    "c02_concepts_wide": concepts_wide,
    "c03_concept_terms_wide": lambda m: concept_terms_wide(m, Q.concept(m)),
    "c04_member_median": lambda m: member_median(m, Q.term(m)),
    "c05_evidence_by_bill": lambda m: evidence_by_bill(m, Q.concept(m)),
    "c06_concept_uncounted": lambda m: concept_uncounted(m, Q.concept(m)),
    "c07_position_titles": lambda m: position_titles(m, Q.minister(m)),
    "c08_served_in_term": lambda m: served_in_term(m, Q.minister(m)),
    "c11_coalition_seats": lambda m: coalition_seats(m, Q.term(m)),
    "c12_funnel_filled": lambda m: funnel_filled(m, Q.term(m)),
}


def _bind(f):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return f(Model.of(spark, sf))

    return run


QUERIES = {name: _bind(f) for name, f in MODEL.items()}
