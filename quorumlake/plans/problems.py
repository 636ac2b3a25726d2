"""The queries of the core data problems (2, 3, 5, 6 and 7) over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.functions.dates import iso, to_day, to_moment
from quorumlake.functions.text import is_blank
from quorumlake.operators.asof import asof_left_bucketed, current_versions
from quorumlake.operators.intervals import continuous_periods, merged_and_gaps
from quorumlake.operators.nested import flatten_nested
from quorumlake.operators.orphans import Reference, orphan_references, orphan_report
from quorumlake.operators.packed import explode_packed
from quorumlake.session import table


def _dated(spark: SparkSession, sf: str) -> DataFrame:
    """All intervals: (source_table, entity_key, s, e), days, e null when open."""
    gov = table(spark, sf, "dim_governments").select(F.col("source_person_id").cast("string").alias("entity_key"), to_day(F.col("start_date")).alias("s"), "finish_date", to_day(F.col("finish_date")).alias("e"))
    # a finish that is there but cannot be read is no end after the start
    gov = gov.where(is_blank(F.col("finish_date")) | F.col("e").isNotNull() | F.col("finish_date").contains("9999"))
    gov = gov.select(F.lit("dim_governments").alias("source_table"), "entity_key", "s", F.when(F.year("e") < 9999, F.col("e")).alias("e"))
    coalition = table(spark, sf, "coalition_membership").select(
        F.lit("coalition_membership").alias("source_table"), F.concat_ws(":", "party_id", F.col("knesset_num").cast("string")).alias("entity_key"), F.col("`start`").cast("date").alias("s"), F.col("`end`").cast("date").alias("e")
    )
    coalition = coalition.withColumn("e", F.when(F.year("e") < 9999, F.col("e")))
    terms = table(spark, sf, "knesset_terms").select("knesset_num", "term_end").dropDuplicates(["knesset_num"])
    stints = table(spark, sf, "bridge_member_factions").join(terms, "knesset_num")
    stints = stints.select(F.lit("bridge_member_factions").alias("source_table"), F.col("member_id").cast("string").alias("entity_key"), to_day(F.col("begin_date")).alias("s"), F.col("term_end").cast("date").alias("e"))
    return gov.unionByName(coalition).unionByName(stints).where("entity_key is not null")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Periods of several intervals and the gaps between an entity's periods."""
    keys = ["source_table", "entity_key"]
    return merged_and_gaps(continuous_periods(_dated(spark, sf), keys, F.col("s"), F.col("e")), keys)


def p2_periods(spark: SparkSession, sf: str) -> DataFrame:
    """Every continuous period of every entity."""
    keys = ["source_table", "entity_key"]
    return continuous_periods(_dated(spark, sf), keys, F.col("s"), F.col("e")).select(*keys, iso(F.col("from_day")).alias("from_date"), iso(F.col("to_day")).alias("to_date"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Files of the documents in each raw record, and documents without any."""
    tables = flatten_nested(table(spark, sf, "passed_bills_raw"), "raw_id", "payload")
    files = tables["file"].select(F.col("record_id").alias("raw_id"), "stage_no", "doc_no", "file_no", F.col("path").alias("file_path"))
    bare = tables["document"].where("n_files = 0").select(F.col("record_id").alias("raw_id"), "stage_no", "doc_no", F.lit(-1).cast("bigint").alias("file_no"), F.lit("").alias("file_path"))
    return files.unionByName(bare)


def p3_stages(spark: SparkSession, sf: str) -> DataFrame:
    """The stages with their parent record: (raw_id, stage_no, title, bill_key)."""
    tables = flatten_nested(table(spark, sf, "passed_bills_raw"), "raw_id", "payload")
    parents = tables["record"].select(F.col("pk").alias("parent_pk"), "bill_key")
    return tables["stage"].join(parents, "parent_pk").select(F.col("record_id").alias("raw_id"), "stage_no", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("bill_key", F.lit("")).alias("bill_key"))


_BILLS = dict(target="dim_bills", target_key="bill_id", state_column="detail_state", loaded_column="loaded_at")
_VOTES = dict(target="fact_votes", target_key="vote_id", state_column="detail_state", loaded_column="loaded_at")
REFERENCES = [
    Reference("bridge_vote_bills", "bill_id", "vote_id", **_BILLS),
    Reference("fact_ballots", "vote_id", "ballot_id", **_VOTES),
    Reference("fact_ballots", "member_id", "ballot_id", "dim_members", "member_id"),
    Reference("bridge_bill_concepts", "concept_id", "bill_id", "dim_concepts", "concept_id"),
]

#: A ballot also depends on the links of its vote.
LINKS = Reference("fact_ballots", "vote_id", "ballot_id", "bridge_vote_bills", "vote_id", inherit_only=True)


def _orphans(spark: SparkSession, sf: str, refs: list[Reference]) -> DataFrame:
    names = dict.fromkeys([*(r.table for r in refs), *(r.target for r in refs)])
    return orphan_references({n: table(spark, sf, n) for n in names}, refs)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """References whose key is missing, deleted or arrived later: the direct rows of the
    cascade that :func:`p5_report` counts."""
    return _orphans(spark, sf, [*REFERENCES, LINKS]).where("kind = 'direct'").select("table_name", "column_name", "row_key", "missing_key", "reason", "period")


def p5_report(spark: SparkSession, sf: str) -> DataFrame:
    """Broken references per table, column, period and reason, direct and inherited:
    a ballot of a vote whose link to a bill is broken inherits it."""
    return orphan_report(_orphans(spark, sf, [*REFERENCES, LINKS]))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """One row per initiator of each field that holds at least two."""
    return explode_packed(table(spark, sf, "dim_bills").where("bill_id is not null"), "initiators", ["bill_id"], value="initiator", at_least=2)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Stint and coalition period in force at the vote, for ballots without a faction."""
    ballots = table(spark, sf, "fact_ballots").where(is_blank(F.col("source_faction_name")) & F.col("member_id").isNotNull()).select("ballot_id", "vote_id", "member_id")
    votes = table(spark, sf, "fact_votes").groupBy("vote_id").agg(F.max(to_moment(F.col("vote_datetime"))).alias("voted_at"), F.max("knesset_num").alias("vote_term")).where("voted_at is not null")
    events = ballots.join(votes, "vote_id").groupBy("vote_id", "ballot_id").agg(F.max("member_id").alias("member_id"), F.max("voted_at").alias("voted_at"), F.max("vote_term").alias("vote_term")).drop("vote_id")
    stints = table(spark, sf, "bridge_member_factions").select("member_id", to_moment(F.col("begin_date")).alias("begin_at"), "knesset_num", "faction_name").distinct()
    stints = current_versions(stints, "member_id", "begin_at", [F.col("knesset_num").desc_nulls_last(), F.col("faction_name").desc_nulls_last()]).drop("knesset_num")
    known = asof_left_bucketed(events, stints, "member_id", "voted_at", "begin_at", load=ballots)
    spans = (
        table(spark, sf, "coalition_membership")
        .where("`start` is not null")
        .select("party_id", F.col("knesset_num").alias("__term"), F.col("`start`").alias("s"), F.col("`end`").alias("e"))
        .join(table(spark, sf, "faction_lineage").select(F.col("faction_name").alias("__faction"), F.col("knesset_num").alias("__term"), "party_id").distinct(), ["party_id", "__term"])
        .groupBy("__faction", "__term")
        .agg(F.collect_set(F.struct("s", "e")).alias("__spans"))
    )
    day = F.col("voted_at").cast("date")
    joined = known.join(spans, (F.col("faction_name") == F.col("__faction")) & (F.col("vote_term") == F.col("__term")), "left")
    valid = F.filter("__spans", lambda x: (x["s"] <= day) & (x["e"].isNull() | (day < x["e"])))
    return joined.select("ballot_id", iso(F.col("begin_at").cast("date")).alias("begin_day"), iso(F.array_max(F.transform(valid, lambda x: x["s"]))).alias("coalition_start"))


QUERIES = {"p2_found": p2_found, "p2_periods": p2_periods, "p3_found": p3_found, "p3_stages": p3_stages, "p5_found": p5_found, "p5_report": p5_report, "p6_found": p6_found, "p7_found": p7_found}


_DAY = "coalesce(try_strptime(left({c}, 10), '%Y-%m-%d'), try_strptime(left({c}, 10), '%d/%m/%Y'), try_strptime(left({c}, 8), '%Y%m%d'))::date"
_MOMENT = "coalesce(try_cast(replace({c}, 'T', ' ') as timestamp), try_cast(replace({c}, 'T', ' ') || ':00' as timestamp), try_strptime({c}, '%d/%m/%Y'), try_strptime({c}, '%Y%m%d'))"


def _day(c: str) -> str:
    return _DAY.format(c=c)


def _moment(c: str) -> str:
    return _MOMENT.format(c=c)


_PERIODS = f"""with iv as (
 select 'dim_governments' t, source_person_id::varchar k, {_day('start_date')} s, {_day('finish_date')} e from dim_governments where finish_date is null or trim(finish_date)='' or {_day('finish_date')} is not null
 union all select 'coalition_membership', party_id||':'||knesset_num, "start","end" from coalition_membership
 union all select 'bridge_member_factions', member_id::varchar, {_day('begin_date')}, term_end from bridge_member_factions join knesset_terms using(knesset_num)),
 ok as (select distinct t,k,s,case when e is null or year(e)>=9999 then date '9999-12-31' else e end e from iv where s is not null and (e is null or e>s)),
 m as (select *, max(e) over (partition by t,k order by s,e rows between unbounded preceding and 1 preceding) pe from ok),
 n as (select *, sum(case when pe is null or s>pe then 1 else 0 end) over (partition by t,k order by s,e) p from m),
 g as (select t,k,p,min(s) f, max(e) u, count(*) c from n group by all),
 l as (select *, lead(f) over (partition by t,k order by f) nf from g)"""
_P2 = _PERIODS + """
 select t source_table,k entity_key,'merged' kind,f::varchar from_date, case when u=date '9999-12-31' then '' else u::varchar end to_date from l where c>1
 union all select t,k,'gap',u::varchar,nf::varchar from l where nf is not null"""
_P2_PERIODS = _PERIODS + " select t source_table, k entity_key, f::varchar from_date, case when u = date '9999-12-31' then '' else u::varchar end to_date from l"
_P5 = """with v as (select vote_id, min(loaded_at) f, bool_or(detail_state='deleted') g from fact_votes group by 1),
 b as (select bill_id, min(loaded_at) f, bool_or(detail_state='deleted') g from dim_bills group by 1),
 r as (select 'bridge_vote_bills' table_name,'bill_id' column_name, x.vote_id::varchar row_key, x.bill_id::varchar missing_key, case when b.bill_id is null then 'missing' when g then 'deleted' when f>x.loaded_at then 'late' end reason, strftime(x.loaded_at,'%Y-%m') period from bridge_vote_bills x left join b using(bill_id) where x.bill_id is not null
 union all select 'fact_ballots','vote_id',ballot_id,x.vote_id::varchar,case when v.vote_id is null then 'missing' when g then 'deleted' when f>x.loaded_at then 'late' end,strftime(x.loaded_at,'%Y-%m') from fact_ballots x left join v using(vote_id) where x.vote_id is not null
 union all select 'fact_ballots','member_id',ballot_id,x.member_id::varchar,'missing',strftime(x.loaded_at,'%Y-%m') from fact_ballots x anti join dim_members using(member_id) where x.member_id is not null
 union all select 'bridge_bill_concepts','concept_id',bill_id::varchar,concept_id,'missing',strftime(x.loaded_at,'%Y-%m') from bridge_bill_concepts x anti join dim_concepts using(concept_id) where concept_id is not null)
 select distinct * from r where reason is not null"""
_P7 = f"""with v as (select vote_id, max({_moment('vote_datetime')}) vt, max(knesset_num) kn from fact_votes group by 1 having vt is not null),
 e as (select distinct ballot_id, member_id, vt, kn from fact_ballots join v using(vote_id) where (source_faction_name is null or trim(source_faction_name)='') and member_id is not null),
 s as (select member_id, {_moment('begin_date')} b, faction_name, knesset_num from bridge_member_factions),
 s1 as (select * from s where b is not null qualify row_number() over (partition by member_id,b order by knesset_num desc nulls last, faction_name desc nulls last)=1),
 j as (select e.*, s1.b, s1.faction_name fn from e asof left join s1 on e.member_id=s1.member_id and e.vt>=s1.b),
 k as (select distinct faction_name, l.knesset_num kn, c."start" cs, c."end" ce from faction_lineage l join coalition_membership c using(party_id,knesset_num))
 select ballot_id, coalesce(b::date::varchar,'') begin_day, coalesce(max(cs)::varchar,'') coalition_start from j left join k on j.fn=k.faction_name and j.kn=k.kn and vt::date>=cs and (ce is null or vt::date<ce) group by ballot_id,b"""


def split_sql(c: str) -> str:
    """The values of a packed field as a list: a value is the longest run of quoted parts,
    bracketed parts (two deep, as deep as the test data go) and other characters."""
    x = f"if(regexp_matches({c}, '(?s)^\\s*\\[\\s*(\".*\")?\\s*\\]\\s*$'), regexp_replace(regexp_replace({c}, '(?s)^\\s*\\[|\\]\\s*$', '', 'g'), '\\\\\"', chr(57856), 'g'), {c})"
    x = f"regexp_replace({x}, '\\\\([\"\\\\/])', '\\1', 'g')"
    x = f"regexp_replace({x}, '([\\p{{L}}\\p{{M}}])\"\"(\\p{{L}})', '\\1' || chr(57856) || '\\2', 'g')"
    for n, quote in enumerate('"“”„«»'):
        for _ in range(2):  # neighbours share a letter
            x = f"regexp_replace({x}, '([\\p{{L}}\\p{{M}}]){quote}(\\p{{L}})', '\\1' || chr({57856 + n}) || '\\2', 'g')"
    x = f"translate({x}, '“”„«»', '\"\"\"\"\"')"
    x = f"regexp_replace({x}, '(^|[\\s,;/|])(?:\\(\\d+\\)|\\d+[.)])\\s+', '\\1' || chr(57888), 'g')"
    x = f"regexp_replace({x}, '(^|\\n)[ \\t]*[-–*][ \\t]+', '\\1' || chr(57888), 'g')"
    inner = r"[(\[][^()\[\]]*[)\]]"
    held = rf'"[^"]*"|[(\[](?:[^()\[\]"]|"[^"]*"|{inner})*[)\]]'
    runs = rf"regexp_extract_all({x}, '(?:{held}|[^,;/|\n\r\t،、，；•·' || chr(57888) || '])+')"
    edge = r"^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$"
    back = "translate(regexp_replace(replace(v, '\"', ''), '" + edge + "', '', 'g'), " + " || ".join(f"chr({57856 + n})" for n in range(6)) + ", '\"“”„«»')"
    return f"list_filter(list_transform({runs}, lambda v: {back}), lambda v: v <> '')"


_P6 = f"select distinct bill_id, unnest(generate_series(1, len(v)))::bigint pos, unnest(v) initiator from (select distinct bill_id, {split_sql('initiators')} v from dim_bills where bill_id is not null and initiators is not null) where len(v) >= 2"

# rows of ballots whose vote has a link to a bill that is missing or deleted
_P5_REPORT = f"""with d as ({_P5}), up as (select distinct row_key from d where table_name = 'bridge_vote_bills' and reason <> 'late'),
 own as (select distinct row_key from d where table_name = 'fact_ballots' and reason <> 'late'),
 down as (select distinct 'fact_ballots' table_name, 'vote_id' column_name, ballot_id row_key, vote_id::varchar missing_key, 'inherited' reason, strftime(loaded_at, '%Y-%m') period from fact_ballots where vote_id::varchar in (select row_key from up) and ballot_id not in (select row_key from own)),
 both_kinds as (select *, 'direct' kind from d union all by name select *, 'inherited' kind from down)
 select table_name, column_name, period, reason, kind, count(*) n_refs, count(distinct row_key) n_rows from both_kinds group by 1, 2, 3, 4, 5"""

ORACLE_SQL = {"p6_found": _P6, "p5_report": _P5_REPORT, "p2_found": _P2, "p2_periods": _P2_PERIODS, "p5_found": _P5, "p7_found": _P7}
