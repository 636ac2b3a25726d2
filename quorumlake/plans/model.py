"""The analytical model: derived tables over the star schema.

Repeated deliveries are reduced to the first one, dates are read from text once,
and every derived table is a declared plan. The tables that nearly all queries
read are written once per session and data folder, so that later queries start
from them; a fingerprint of the inputs decides whether a written table is current.
"""

from __future__ import annotations

import hashlib
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.functions.dates import to_day, to_moment
from quorumlake.functions.sqlfn import arg_max, count_if, safe_div
from quorumlake.functions.text import name_key, utrim
from quorumlake.operators.asof import asof_left_history, current_versions
from quorumlake.operators.packed import split_packed
from quorumlake.session import materialize, table

# Fixed values of the records.
FOR, AGAINST, ABSTAIN, PRESENT = 7, 8, 9, 6
NO_CONFIDENCE, MOTION, REGULATION = 3, 4, 6000
TEXT_PRELIMINARY = "%להכנה לקריאה ראשונה%"
TEXT_FIRST = "%להכנה לקריאה שני%"
ACCEPT_RESERVATION = "לקבל את ההסתייגות"
REJECT = "לדחות את ההצעה"
PASSED = "התקבלה בקריאה שלישית"
PRIVATE = "פרטית"
NO_COMMITTEE_YET = "טרם נקבעה"
TITLES = "^(ד\"ר|עו\"ד|ח\"כ|רו\"ח|פרופ')\\s+"
COUNTED = ("preliminary", "first", "third")
#: Labels that mix scripts (fixed pattern).
MIXED_SCRIPTS = r"[^\p{IsHebrew}\p{IsLatin}\P{L}]|\p{IsHebrew}\p{IsLatin}|\p{IsLatin}\p{IsHebrew}"


def first_delivery(df: DataFrame, *key: str, at: str = "loaded_at") -> DataFrame:
    """One row per key: the first one delivered, among equal times the one with the
    fewest nulls, then the smallest content. An aggregate, so it combines before the
    shuffle."""
    flat = [c for c in df.columns if c not in (*key, at)]
    gaps = sum((F.col(c).isNull().cast("int") for c in flat), F.lit(0))
    best = F.min(F.struct(F.col(at).alias("__at"), gaps.alias("__gaps"), *[F.col(c) for c in flat]))
    return df.groupBy(*key).agg(best.alias("__x")).select(*key, *[F.col(f"__x.{c}").alias(c) for c in flat], F.col("__x.__at").alias(at))


def fingerprint(spark: SparkSession, sf: str, names: list[str]) -> str:
    """16 hexadecimal digits that change when any input file does."""
    jvm = spark.sparkContext._jvm
    said = []
    for n in names:
        p = jvm.org.apache.hadoop.fs.Path(f"{sf}/{n}.parquet")
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(p):
            s = fs.getContentSummary(p)
            said.append(f"{n}:{s.getLength()}:{s.getFileCount()}:{fs.getFileStatus(p).getModificationTime()}")
    return hashlib.sha256("|".join(said).encode()).hexdigest()[:16]


_MODELS: dict[tuple[str, str, str], Model] = {}
_INPUTS = ["fact_votes", "fact_ballots", "bridge_vote_bills", "dim_bills", "dim_members", "bridge_member_factions", "faction_lineage", "committee_topics", "coalition_membership", "dim_concepts", "bridge_bill_concepts", "cluster_result"]


class Model:
    """Derived tables of one data folder, each built when first asked for."""

    def __init__(self, spark: SparkSession, sf: str, keep: bool = True):
        self.spark, self.sf, self.keep = spark, sf, keep

    @classmethod
    def of(cls, spark: SparkSession, sf: str) -> Model:
        """The model of this session for the present version of the folder."""
        key = (spark.sparkContext.applicationId, sf, fingerprint(spark, sf, _INPUTS))
        if key not in _MODELS:
            _MODELS[key] = cls(spark, sf)
        return _MODELS[key]

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.sf, name)

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        return materialize(df, name) if self.keep else df

    # lookups -----------------------------------------------------------------
    @cached_property
    def parties(self) -> DataFrame:
        """(party_id, party_name, color_index): the name is that of the faction that
        carries the party through most terms."""
        by = self.raw("faction_lineage").groupBy("party_id", "faction_name").agg(F.countDistinct("knesset_num").alias("n"))
        named = by.groupBy("party_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "faction_name")).alias("x"))
        return named.select("party_id", F.col("x.faction_name").alias("party_name"), (F.pmod(F.length("party_id"), F.lit(5)) + 1).cast("int").alias("color_index"))

    @cached_property
    def topics(self) -> DataFrame:
        return self.raw("committee_topics").select("topic_id", F.initcap("topic_id").alias("topic_name")).distinct()

    @cached_property
    def members(self) -> DataFrame:
        return self.raw("dim_members").dropDuplicates(["member_id"])

    @cached_property
    def lineage(self) -> DataFrame:
        return self.raw("faction_lineage").groupBy("faction_name", "knesset_num").agg(F.min("party_id").alias("party_id"))

    @cached_property
    def coalition_spans(self) -> DataFrame:
        """(party_id, knesset_num, spans): usable half-open periods as one list."""
        ok = self.raw("coalition_membership").where("`start` is not null and (`end` is null or `end` > `start`)")
        return ok.groupBy("party_id", "knesset_num").agg(F.collect_set(F.struct(F.col("start").alias("s"), F.col("end").alias("e"))).alias("spans"))

    # facts -------------------------------------------------------------------
    @cached_property
    def ballots(self) -> DataFrame:
        b = self.raw("fact_ballots").select("ballot_id", "vote_id", "member_id", "source_faction_name", "vote_result_id", "loaded_at")
        return self._keep(first_delivery(b, "ballot_id"), "ballots")

    @cached_property
    def links(self) -> DataFrame:
        """(vote_id, bill_id): every link once."""
        return self.raw("bridge_vote_bills").where("vote_id is not null and bill_id is not null").select("vote_id", "bill_id").distinct()

    @cached_property
    def _plain_votes(self) -> DataFrame:
        """One row per vote without its stage; ``bill_id`` is the smallest linked bill."""
        got = first_delivery(self.raw("fact_votes").drop("discovery_date", "discovery_date_count", "counter_total"), "vote_id")
        tallies = self.ballots.groupBy("vote_id").agg(
            count_if(F.col("vote_result_id") == FOR).alias("n_for"), count_if(F.col("vote_result_id") == AGAINST).alias("n_against"), count_if(F.col("vote_result_id") == ABSTAIN).alias("n_abstain")
        )
        zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
        ts = to_moment(F.col("vote_datetime"))
        votes = (
            got.join(self.links.groupBy("vote_id").agg(F.min("bill_id").alias("bill_id")), "vote_id", "left")
            .join(tallies.withColumn("has_ballots", F.lit(True)), "vote_id", "left")
            .select("vote_id", "knesset_num", ts.alias("ts"), ts.cast("date").alias("vote_date"), "item_title", "decision", "reading", "accepted", "lu_item_type", "vote_type", "bill_id", zero("n_for"), zero("n_against"), zero("n_abstain"), F.coalesce("has_ballots", F.lit(False)).alias("has_ballots"))
        )
        return self._keep(votes, "plain_votes")

    @cached_property
    def _second_days(self) -> DataFrame:
        """(bill_id, vote_date, has_second): days on which a bill had a second reading."""
        v = self._plain_votes.where("reading = 2 and vote_date is not null").select("vote_id", "vote_date")
        return v.join(self.links, "vote_id").select("bill_id", "vote_date").distinct().withColumn("has_second", F.lit(True))

    @cached_property
    def votes(self) -> DataFrame:
        """One row per vote with its smallest bill, moment, tallies and stage. A second
        reading on the same day counts when any linked bill had it."""
        rejected = self._plain_votes.where(F.col("decision") == REJECT).select("vote_id", "vote_date").join(self.links, "vote_id")
        second = rejected.join(self._second_days, ["bill_id", "vote_date"]).select("vote_id", "has_second").distinct()
        return self._keep(self._plain_votes.join(second, "vote_id", "left").withColumn("stage", _stage()).drop("has_second"), "votes")

    @cached_property
    def vote_bills(self) -> DataFrame:
        """One row per vote and linked bill, with the vote's columns and its stage for
        that bill. Whatever belongs to bills starts here, not from ``votes``."""
        v = self._plain_votes.drop("bill_id").join(self.links, "vote_id")
        return self._keep(v.join(self._second_days, ["bill_id", "vote_date"], "left").withColumn("stage", _stage()).drop("has_second"), "vote_bills")

    @cached_property
    def stints(self) -> DataFrame:
        """(member_id, knesset_num, faction_name, start_date), unique per member and day."""
        s = self.raw("bridge_member_factions").select("member_id", "knesset_num", utrim(F.col("faction_name")).alias("faction_name"), to_day(F.col("begin_date")).alias("start_date")).distinct()
        return current_versions(s, "member_id", "start_date", [F.col("knesset_num").desc_nulls_last(), F.col("faction_name").desc_nulls_last()])

    @cached_property
    def bills(self) -> DataFrame:
        """One row per bill with its topic and the first dates of its stages."""
        b = first_delivery(self.raw("dim_bills"), "bill_id")
        dates = self.vote_bills.groupBy("bill_id").agg(
            F.min("vote_date").alias("first_vote_date"), F.min(F.when(F.col("stage") == "first", F.col("vote_date"))).alias("first_reading_date"), F.min(F.when(F.col("stage") == "third", F.col("vote_date"))).alias("final_date")
        )
        b = b.select("bill_id", "name", "status", "proposal_type", "knesset_num", utrim(F.col("committee_name")).alias("committee_name"), "summary", "initiators", (F.col("status") == PASSED).alias("passed"))
        topic = self.raw("committee_topics").select("committee_name", "topic_id").dropDuplicates(["committee_name"])
        return self._keep(b.join(topic, "committee_name", "left").join(dates, "bill_id", "left"), "bills")

    @cached_property
    def bill_concepts(self) -> DataFrame:
        """Concepts of bills, once each; labels live in ``concepts``."""
        return first_delivery(self.raw("bridge_bill_concepts").drop("concept_label", "concept_criterion"), "bill_id", "concept_id")

    @cached_property
    def bullets(self) -> DataFrame:
        return self.raw("cluster_result").groupBy("bullet_row_id").agg(F.min("bill_id").alias("bill_id"), F.min("bullet").alias("bullet"))

    @cached_property
    def concepts(self) -> DataFrame:
        """Concepts that have bills, with their spread over committees; labels that mix
        scripts are left out."""
        tagged = self.bill_concepts.select("concept_id", "bill_id").join(self.bills.select("bill_id", "committee_name", "knesset_num"), "bill_id")
        known = F.when(F.col("committee_name") != NO_COMMITTEE_YET, F.col("committee_name"))
        spread = tagged.groupBy("concept_id").agg(F.countDistinct("bill_id").alias("n_bills"), F.countDistinct(known).alias("n_committees"), F.min("knesset_num").alias("k_from"), F.max("knesset_num").alias("k_to"))
        total = tagged.agg(F.countDistinct(known).alias("n_all"))
        mixed = F.col("concept_label").rlike(MIXED_SCRIPTS)
        limit = F.greatest(F.lit(3).cast("double"), F.ceil(F.col("n_all") * F.lit(2) / F.lit(10)).cast("double"))
        c = self.raw("dim_concepts").select("concept_id", "concept_label", "concept_criterion").where(~mixed)
        return self._keep(c.join(spread, "concept_id").crossJoin(F.broadcast(total)).withColumn("is_generic", F.col("n_committees") >= limit).drop("n_all"), "concepts")

    @cached_property
    def ballots_x(self) -> DataFrame:
        """One row per ballot of a known vote: choice, faction, party, coalition."""
        v = self.votes.select("vote_id", "knesset_num", "vote_date", "bill_id", "stage")
        b = self.ballots.select("ballot_id", "vote_id", "member_id", F.nullif(utrim(F.col("source_faction_name")), F.lit("")).alias("source_faction"), "vote_result_id").join(v, "vote_id")
        stints = self.stints.select("member_id", "start_date", F.col("faction_name").alias("stint_faction"))
        b = asof_left_history(b, stints, "member_id", "vote_date", "start_date", ["stint_faction"])
        b = b.withColumn("faction_name", F.coalesce("source_faction", "stint_faction"))
        b = b.join(self.lineage, ["faction_name", "knesset_num"], "left").join(self.coalition_spans, ["party_id", "knesset_num"], "left")
        inside = F.coalesce(F.exists("spans", lambda x: (x["s"] <= F.col("vote_date")) & (x["e"].isNull() | (F.col("vote_date") < x["e"]))), F.lit(False))
        r = F.col("vote_result_id")
        choice = F.when(r == FOR, "for").when(r == AGAINST, "against").when(r == ABSTAIN, "abstain").when(r == PRESENT, "present").otherwise("other")
        return self._keep(b.select("ballot_id", "vote_id", "member_id", "knesset_num", "vote_date", "bill_id", "stage", choice.alias("choice"), "faction_name", "party_id", inside.alias("is_coalition")), "ballots_x")

    @cached_property
    def party_vote(self) -> DataFrame:
        """Tallies, position and cohesion of each party in each vote."""
        f, a = F.col("n_for"), F.col("n_against")
        t = self.ballots_x.where("party_id is not null").groupBy("vote_id", "party_id", "knesset_num").agg(
            F.max("is_coalition").alias("is_coalition"), *[count_if(F.col("choice") == c).alias(f"n_{c}") for c in ("for", "against", "abstain")]
        )
        position = F.when(f > a, "for").when(a > f, "against").otherwise("split")
        return self._keep(t.withColumn("position", position).withColumn("rice", safe_div(F.abs(f - a), f + a)), "party_vote")

    @cached_property
    def vote_bloc(self) -> DataFrame:
        """Position of coalition and opposition, and whether all parties kept to them."""

        def position(side: Column) -> Column:
            f, a = F.sum(F.when(side, F.col("n_for"))), F.sum(F.when(side, F.col("n_against")))
            return F.when(f + a > 0, F.when(f > a, "for").otherwise("against"))

        bloc = self.party_vote.groupBy("vote_id").agg(position(F.col("is_coalition")).alias("coalition_position"), position(~F.col("is_coalition")).alias("opposition_position"))
        own = F.when(F.col("is_coalition"), F.col("coalition_position")).otherwise(F.col("opposition_position"))
        kept = self.party_vote.select("vote_id", "position", "is_coalition").join(bloc, "vote_id").groupBy("vote_id").agg(F.bool_and(F.col("position") == own).alias("kept"))
        apart = F.col("coalition_position") != F.col("opposition_position")
        return bloc.join(kept, "vote_id").withColumn("is_bloc_vote", F.coalesce(apart & F.col("kept"), F.lit(False))).drop("kept")

    @cached_property
    def mk_service(self) -> DataFrame:
        """Window of ballots of each member in each term, and the last party."""
        return self._keep(
            self.ballots_x.where("member_id is not null").groupBy("member_id", "knesset_num").agg(F.min("vote_date").alias("first_date"), F.max("vote_date").alias("last_date"), arg_max(F.col("party_id"), F.col("vote_date")).alias("last_party_id"), F.count(F.lit(1)).alias("n_ballots")), "service"
        )

    @cached_property
    def bill_initiators(self) -> DataFrame:
        """(bill_id, name, member_id): initiators of private bills, found by the exact
        name, else by the order-insensitive key without titles; unknown names keep a
        null member."""
        names = self.bills.where((F.col("proposal_type") == PRIVATE) & F.col("initiators").rlike(r"[^\s\p{Z}]")).select("bill_id", F.explode(split_packed(F.col("initiators"))).alias("name")).distinct()
        plain = F.regexp_replace(F.regexp_replace("name", r"\s*[(\[].*?[)\]]", ""), TITLES, "")
        exact = self.members.groupBy(F.col("member_name").alias("name")).agg(F.min("member_id").alias("by_name"))
        keyed = self.members.groupBy(name_key(F.col("member_name")).alias("key")).agg(F.min("member_id").alias("by_key"))
        out = names.withColumn("key", name_key(plain)).join(exact, "name", "left").join(keyed, "key", "left")
        return out.select("bill_id", "name", F.coalesce("by_name", "by_key").alias("member_id"))

    @cached_property
    def search_index(self) -> DataFrame:
        served = self.members.join(self.mk_service.select("member_id").distinct(), "member_id", "left_semi")
        mk = served.select(F.lit("mk").alias("kind"), F.col("member_id").cast("string").alias("id"), F.col("member_name").alias("label"))
        party = self.parties.select(F.lit("party").alias("kind"), F.col("party_id").alias("id"), F.col("party_name").alias("label"))
        last = self.last_vote
        bill = self.bills.join(last, "bill_id").select(F.lit("bill").alias("kind"), F.col("last_vote_id").cast("string").alias("id"), F.col("name").alias("label"))
        concept = self.concepts.select(F.lit("concept").alias("kind"), F.col("concept_id").alias("id"), F.col("concept_label").alias("label"))
        return mk.unionByName(party).unionByName(bill).unionByName(concept)

    @cached_property
    def last_vote(self) -> DataFrame:
        """(bill_id, last_vote_id): each bill's latest vote."""
        return self.vote_bills.where("ts is not null").groupBy("bill_id").agg(arg_max(F.col("vote_id"), F.col("ts")).alias("last_vote_id"))

    @cached_property
    def eligible(self) -> DataFrame:
        """mk_service with the ballot-carrying votes inside each window.

        Votes are first counted per term and day, so the range join meets days and
        not votes."""
        days = self.votes.where("has_ballots and vote_date is not null").groupBy("knesset_num", "vote_date").agg(F.count(F.lit(1)).alias("n"))
        s = self.mk_service
        met = s.join(days, (s.knesset_num == days.knesset_num) & F.col("vote_date").between(F.col("first_date"), F.col("last_date")))
        return met.groupBy(s.member_id, s.knesset_num).agg(F.sum("n").alias("eligible")).join(s, ["member_id", "knesset_num"])


def _stage() -> Column:
    """First rule that holds, in this order."""
    kind, reading, said = F.col("lu_item_type"), F.col("reading"), F.col("decision")
    return (
        F.when(kind == NO_CONFIDENCE, "no_confidence")
        .when(kind == MOTION, "motion")
        .when(kind == REGULATION, "regulation")
        .when(F.col("bill_id").isNull(), "other")
        .when(reading == 3, "third")
        .when(reading == 2, "second")
        .when(said.like(TEXT_PRELIMINARY), "preliminary")
        .when(said.like(TEXT_FIRST), "first")
        .when(said == ACCEPT_RESERVATION, "reservation")
        .when((said == REJECT) & F.col("has_second"), "reservation")
        .when(said == REJECT, "preliminary")
        .otherwise("other")
    )
