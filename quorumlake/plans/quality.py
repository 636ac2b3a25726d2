"""Data-quality report over the star schema: one row per check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.functions.dates import to_moment
from quorumlake.functions.text import name_key, title_tidy
from quorumlake.plans.model import Model, first_delivery

C = F.col
BLOCKING, REVIEW = "blocking", "review"
MAX_BALLOTS = 120
FIRST_DAY, LAST_DAY = "2003-01-01", "2027-01-01"


#: Fields that may not be empty, by table (the first delivery of each key counts).
REQUIRED = {"fact_votes": ("vote_type", "detail_state", "knesset_num", "discovery_date"), "dim_bills": ("detail_state", "knesset_num"), "fact_ballots": ("vote_id", "vote_result_id")}


def _one(df: DataFrame, name: str) -> DataFrame:
    """Rows of ``df`` as one named count."""
    return df.agg(F.count(F.lit(1)).alias(name))


def _surplus(df: DataFrame, *key: str, name: str) -> DataFrame:
    """Rows beyond the first of each key among distinct contents (repeated deliveries
    are no fault)."""
    return df.distinct().groupBy(*key).count().agg(F.coalesce(F.sum(C("count") - 1), F.lit(0)).alias(name))


def _lost(child: DataFrame, parent: DataFrame, key: str, name: str) -> DataFrame:
    return _one(child.select(key).where(C(key).isNotNull()).join(parent.select(key).distinct(), key, "left_anti"), name)


def checks(m: Model) -> list[tuple[str, DataFrame]]:
    """(severity, one row whose columns are checks): conditions on one table are counted
    in one pass over it."""
    votes, bills = m.raw("fact_votes"), m.raw("dim_bills")
    ballots, links = m.ballots, m.raw("bridge_vote_bills").select("vote_id", "bill_id", "decision", "reading")
    once, bill = first_delivery(votes, "vote_id"), first_delivery(bills, "bill_id")
    moment = to_moment(C("vote_datetime"))
    empty = lambda table, df: [F.count(F.when(C(c).isNull(), 1)).alias(f"empty {table}.{c}") for c in REQUIRED[table]]
    range_ = (moment < F.lit(FIRST_DAY).cast("timestamp_ntz")) | (moment >= F.lit(LAST_DAY).cast("timestamp_ntz"))
    per_vote = ballots.groupBy("vote_id").agg(F.count(F.lit(1)).alias("n"), (F.count("member_id") - F.countDistinct("member_id")).alias("again"))
    names = m.raw("fact_ballots").where("member_id is not null").select("member_id", "member_name_source").distinct().join(m.members, "member_id")
    titles = links.select("vote_id", "bill_id").distinct().join(once.select("vote_id", "item_title"), "vote_id").join(bill.select("bill_id", "name"), "bill_id")
    stints, government = m.raw("bridge_member_factions"), m.raw("dim_governments")
    called = m.members.select("member_id", name_key(C("member_name")).alias("key")).distinct().groupBy("key").count().where("count > 1")
    counted = once.where("counter_total > 0").select("vote_id", "counter_total").join(per_vote.select("vote_id", "n"), "vote_id", "left")
    return [
        (BLOCKING, _surplus(votes.select("vote_id", "vote_datetime", "item_title", "decision"), "vote_id", name="duplicate vote_id")),
        (BLOCKING, _surplus(m.raw("fact_ballots").select("ballot_id", "vote_id", "member_id", "vote_result_id"), "ballot_id", name="duplicate ballot_id")),
        (BLOCKING, _surplus(links, "vote_id", "bill_id", name="duplicate vote-bill link")),
        (BLOCKING, _surplus(bills.drop("loaded_at"), "bill_id", name="duplicate bill_id")),
        (BLOCKING, _surplus(m.raw("faction_lineage").select("faction_name", "knesset_num", "party_id"), "faction_name", "knesset_num", name="duplicate faction in a term")),
        (BLOCKING, per_vote.agg(F.coalesce(F.sum("again"), F.lit(0)).alias("duplicate member in a vote"), F.count(F.when(C("n") > MAX_BALLOTS, 1)).alias("too many ballots in a vote"))),
        (BLOCKING, _lost(ballots, once, "vote_id", "ballot without vote")),
        (BLOCKING, _lost(links.select("vote_id", "bill_id").distinct(), bill, "bill_id", "vote-bill link without bill")),
        (BLOCKING, _lost(links.select("vote_id", "bill_id").distinct(), once, "vote_id", "vote-bill link without vote")),
        (BLOCKING, once.agg(*empty("fact_votes", once))),
        (BLOCKING, bill.agg(*empty("dim_bills", bill))),
        (BLOCKING, ballots.agg(*empty("fact_ballots", ballots))),
        (REVIEW, once.agg(F.count(F.when(range_, 1)).alias("vote moment out of range"), F.count(F.when(C("vote_datetime").isNotNull() & moment.isNull(), 1)).alias("vote moment unreadable"), F.count(F.when(C("detail_state") != "available", 1)).alias("vote without detail"))),
        (REVIEW, ballots.agg(F.count(F.when(C("member_id").isNull(), 1)).alias("ballot without member"))),
        (REVIEW, _lost(ballots, m.members, "member_id", "ballot of unknown member")),
        (REVIEW, _lost(stints, m.members, "member_id", "stint of unknown member")),
        (REVIEW, _one(called, "name of several members")),
        (REVIEW, _one(names.where(name_key(C("member_name_source")) != name_key(C("member_name"))), "ballot name is not the member's")),
        (REVIEW, _one(titles.where(title_tidy(C("item_title")) != title_tidy(C("name"))), "bill name differs from vote title")),
        (REVIEW, _one(government.where("member_id is null").select("government_id", "position_name", "member_name_source").distinct(), "position without member")),
        (REVIEW, counted.agg(F.count(F.when(C("n").isNull(), 1)).alias("counted vote without ballots"), F.count(F.when(C("n") != C("counter_total"), 1)).alias("counter differs from ballots"))),
    ]


def quality_report(m: Model, limits: dict[str, int] | None = None) -> DataFrame:
    """(check, severity, violations, limit, status): pass if violations <= the check's
    limit, 0 where none is given."""
    allowed = limits or {}
    out = None
    for severity, row in checks(m):
        held = F.array(*[F.struct(F.lit(c).alias("check"), F.lit(severity).alias("severity"), C(f"`{c}`").cast("bigint").alias("violations"), F.lit(allowed.get(c, 0)).cast("bigint").alias("limit")) for c in row.columns])
        rows = row.select(F.inline(held))
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("status", F.when(C("violations") <= C("limit"), "pass").otherwise("fail"))


def raise_on_blocking(report: DataFrame) -> None:
    """Abort a full run on any blocking failure."""
    failed = [r["check"] for r in report.where((C("severity") == BLOCKING) & (C("status") == "fail")).collect()]
    if failed:
        raise ValueError("blocking checks failed: " + ", ".join(sorted(failed)))


def collection_summary(m: Model) -> DataFrame:
    """(metric, count) of the collected tables, one row per delivered key."""
    metrics = {
        "votes": m.raw("fact_votes").agg(F.countDistinct("vote_id").alias("n")),
        "votes without reading": m.raw("fact_votes").where("reading is null").agg(F.countDistinct("vote_id").alias("n")),
        "votes with another source term": m.raw("fact_votes").where("source_knesset_num <> knesset_num").agg(F.countDistinct("vote_id").alias("n")),
        "ballots": m.raw("fact_ballots").agg(F.countDistinct("ballot_id").alias("n")),
        "vote-bill links": m.raw("bridge_vote_bills").agg(F.countDistinct("vote_id", "bill_id").alias("n")),
        "bills": m.raw("dim_bills").agg(F.countDistinct("bill_id").alias("n")),
        "members": m.raw("dim_members").agg(F.countDistinct("member_id").alias("n")),
    }
    out = None
    for name, df in metrics.items():
        row = df.select(F.lit(name).alias("metric"), C("n").alias("count"))
        out = row if out is None else out.unionByName(row)
    return out


SUMMARY_SQL = """
select 'votes' metric, count(distinct vote_id) "count" from fact_votes
union all select 'votes without reading', count(distinct vote_id) from fact_votes where reading is null
union all select 'votes with another source term', count(distinct vote_id) from fact_votes where source_knesset_num <> knesset_num
union all select 'ballots', count(distinct ballot_id) from fact_ballots
union all select 'vote-bill links', count(*) from (select distinct vote_id, bill_id from bridge_vote_bills)
union all select 'bills', count(distinct bill_id) from dim_bills
union all select 'members', count(distinct member_id) from dim_members
"""


def report_sql(once, moment: str, key: str) -> str:
    """The report as SQL; ``once`` names the first delivery of a table by its key."""
    tidy = r"regexp_replace(trim(regexp_replace({c}, '[\s\p{{Z}}]+', ' ', 'g')), '\.+$', '')"
    surplus = lambda keys, cols, table: f"select coalesce(sum(n - 1), 0) from (select count(*) n from (select distinct {cols} from {table}) group by {keys})"
    lost = lambda c, child, parent: f"select count(*) from {child} where {c} is not null and {c} not in (select {c} from {parent} where {c} is not null)"
    ts = moment.format(c="vote_datetime")
    sql = {
        "duplicate vote_id": (BLOCKING, surplus("vote_id", "vote_id, vote_datetime, item_title, decision", "fact_votes")),
        "duplicate ballot_id": (BLOCKING, surplus("ballot_id", "ballot_id, vote_id, member_id, vote_result_id", "fact_ballots")),
        "duplicate vote-bill link": (BLOCKING, surplus("vote_id, bill_id", "vote_id, bill_id, decision, reading", "bridge_vote_bills")),
        "duplicate bill_id": (BLOCKING, surplus("bill_id", "* exclude (loaded_at)", "dim_bills")),
        "duplicate faction in a term": (BLOCKING, surplus("faction_name, knesset_num", "faction_name, knesset_num, party_id", "faction_lineage")),
        "duplicate member in a vote": (BLOCKING, "select coalesce(sum(n - 1), 0) from (select count(*) n from b where member_id is not null group by vote_id, member_id)"),
        "too many ballots in a vote": (BLOCKING, f"select count(*) from (from b select vote_id group by 1 having count(*) > {MAX_BALLOTS})"),
        "ballot without vote": (BLOCKING, lost("vote_id", "b", "v")),
        "vote-bill link without bill": (BLOCKING, lost("bill_id", "l", "d")),
        "vote-bill link without vote": (BLOCKING, lost("vote_id", "l", "v")),
        **{f"empty {t}.{c}": (BLOCKING, f"select count(*) from {a} where {c} is null") for t, a in (("fact_votes", "v"), ("dim_bills", "d"), ("fact_ballots", "b")) for c in REQUIRED[t]},
        "vote moment out of range": (REVIEW, f"select count(*) from v where {ts} < timestamp '{FIRST_DAY}' or {ts} >= timestamp '{LAST_DAY}'"),
        "vote moment unreadable": (REVIEW, f"select count(*) from v where vote_datetime is not null and {ts} is null"),
        "vote without detail": (REVIEW, "select count(*) from v where detail_state <> 'available'"),
        "ballot without member": (REVIEW, "select count(*) from b where member_id is null"),
        "ballot of unknown member": (REVIEW, lost("member_id", "b", "dim_members")),
        "stint of unknown member": (REVIEW, lost("member_id", "bridge_member_factions", "dim_members")),
        "name of several members": (REVIEW, f"select count(*) from (select {key.format(c='member_name')} k from dim_members group by 1 having count(distinct member_id) > 1)"),
        "ballot name is not the member's": (REVIEW, f"select count(*) from (select distinct member_id, member_name_source s from fact_ballots) join (select member_id, min(member_name) m from dim_members group by 1) using (member_id) where {key.format(c='s')} <> {key.format(c='m')}"),
        "bill name differs from vote title": (REVIEW, f"select count(*) from l join v using (vote_id) join d using (bill_id) where {tidy.format(c='item_title')} <> {tidy.format(c='name')}"),
        "position without member": (REVIEW, "select count(*) from (select distinct government_id, position_name, member_name_source from dim_governments where member_id is null)"),
        "counted vote without ballots": (REVIEW, "select count(*) from v where counter_total > 0 and vote_id not in (select vote_id from b where vote_id is not null)"),
        "counter differs from ballots": (REVIEW, "select count(*) from v join (select vote_id, count(*) n from b group by 1) using (vote_id) where counter_total > 0 and n <> counter_total"),
    }
    rows = " union all ".join(f"""select '{name.replace("'", "''")}' "check", '{severity}' severity, ({q})::bigint violations""" for name, (severity, q) in sql.items())
    held = f"v as materialized (from {once('fact_votes', 'vote_id')}), b as materialized (from {once('fact_ballots', 'ballot_id')}), d as materialized (from {once('dim_bills', 'bill_id')}), l as (select distinct vote_id, bill_id from bridge_vote_bills)"
    return f"with {held} select *, 0::bigint \"limit\", if(violations = 0, 'pass', 'fail') status from ({rows})"
