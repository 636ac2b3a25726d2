"""One query per relational construct, over the order, event and text tables.

The SQL of a construct is written once in the common ground of Spark SQL and
DuckDB, with total orders, guarded divisions and explicit casts, so that the very
same text is its own check. Constructs that Spark spells differently have a
DataFrame recipe instead, and their own SQL beside it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quorumlake.functions import text as T
from quorumlake.functions.sqlfn import any_non_null, arg_max, contains, count_if, evenly_spaced, nulls_last, page, safe_div, top_per_group
from quorumlake.operators.asof import asof_left
from quorumlake.session import table

C = F.col

#: Same text in both engines; {name} is a table.
SHARED = {
    "scan_parquet": "select * from {supplier}",
    "project_cast": "select o_orderkey, cast(floor(o_totalprice) as bigint) as price, cast(o_orderdate as date) as day, cast(cast(o_orderdate as date) as varchar(10)) as day_text from {orders}",
    "filter_equal": "select c_custkey, c_name from {customer} where c_mktsegment = 'BUILDING' and c_nationkey <> 3",
    "filter_in": "select o_orderpriority, count(*) as n from {orders} where o_orderstatus in ('F', 'O') and o_orderpriority not in ('5-LOW') group by o_orderpriority",
    "between": "select l_orderkey, l_partkey, l_quantity from {lineitem} where l_quantity between 49 and 50 and l_discount between 0.05 and 0.07",
    "half_open": "select count(*) as n from {orders} where o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1997-01-01'",
    "null_tests": "select count(*) as n, count(case when x is null then 1 end) as n_null from (select nullif(p_size, 5) as x from {part}) t",
    "is_distinct_from": "select p_partkey, nullif(p_size, 5) is distinct from 7 as differs from {part}",
    "like_contains": "select p_partkey from {part} where p_name like '%a%' and p_name not like 'b%'",
    "ilike_contains": "select n_nationkey, n_name from {nation} where n_name ilike '%N_1%'",
    "case_first_match": "select l_returnflag, cast(sum(case when l_quantity < 10 then 1 when l_quantity < 30 then 2 else 3 end) as bigint) as score from (select l_returnflag, l_quantity from {lineitem}) t group by l_returnflag",
    "case_on_value": "select o_orderkey, case o_orderstatus when 'F' then 'final' when 'O' then 'open' else 'other' end as state from {orders}",
    "scalar_functions": "select p_partkey, coalesce(nullif(p_size, 5), 0) as size0, greatest(p_size, 10) as g, abs(p_size - 25) as a, cast(ceil(p_retailprice) as bigint) as c, cast(length(p_name) as int) as len, concat(p_brand, '|', p_type) as label, left(p_name, 4) as head from {part}",
    "flag_projection": "select c_custkey, c_acctbal > 0 as solvent from {customer}",
    "join_inner_using": "select o_orderkey, c_name from {orders} join {customer} on o_custkey = c_custkey where o_totalprice > 400000",
    "join_two_keys": "select a.n_nationkey, b.n_name from {nation} a join {nation} b on a.n_regionkey = b.n_regionkey and a.n_nationkey = b.n_nationkey",
    "join_left_chain": "select c_custkey, n_name, r_name from {customer} left join {nation} on c_nationkey = n_nationkey and n_regionkey < 3 left join {region} on n_regionkey = r_regionkey",
    "join_interval_half_open": "select o.o_custkey, count(*) as n from {orders} o join (select o_custkey, min(o_orderdate) as s, case when count(*) > 1 then max(o_orderdate) end as e from {orders} group by o_custkey) w on w.o_custkey = o.o_custkey and o.o_orderdate >= w.s and (w.e is null or o.o_orderdate < w.e) group by o.o_custkey",
    "join_service_window": "select w.c_nationkey, count(*) as n from {orders} o join (select c_custkey, c_nationkey, min(o_orderdate) as first_day, max(o_orderdate) as last_day from {orders} join {customer} on o_custkey = c_custkey where o_orderstatus = 'F' group by c_custkey, c_nationkey) w on w.c_custkey = o.o_custkey and o.o_orderdate between w.first_day and w.last_day group by w.c_nationkey",
    "join_absent": "select c.c_custkey, o.o_orderkey is null as absent from {customer} c left join (select o_custkey, min(o_orderkey) as o_orderkey from {orders} where o_orderstatus = 'P' group by o_custkey) o on o.o_custkey = c.c_custkey",
    "join_coalesce_key": "select t.k, n.n_name from (select s_suppkey, coalesce(nullif(s_nationkey, 3), 7) as k from {supplier}) t join {nation} n on n.n_nationkey = t.k",
    "join_self_similarity": "select a.l_suppkey as s1, b.l_suppkey as s2, count(*) as n_common, cast(sum(case when a.l_returnflag = b.l_returnflag then 1 else 0 end) as bigint) as n_same from (select distinct l_orderkey, l_suppkey, l_returnflag from {lineitem}) a join (select distinct l_orderkey, l_suppkey, l_returnflag from {lineitem}) b on a.l_orderkey = b.l_orderkey and a.l_suppkey < b.l_suppkey group by a.l_suppkey, b.l_suppkey",
    "join_cross_scalar": "select r_name, n_nations, n_all from (select n_regionkey, count(*) as n_nations from {nation} group by n_regionkey) t join {region} on r_regionkey = n_regionkey cross join (select count(*) as n_all from {nation}) u",
    "join_semi": "select c_custkey from {customer} where c_custkey in (select o_custkey from {orders} where o_totalprice > 450000)",
    "join_anti": "select c_custkey from {customer} where c_custkey not in (select o_custkey from {orders} where o_custkey is not null and o_totalprice > 100000)",
    "exists_flag": "select o_orderkey, o_orderkey in (select l_orderkey from {lineitem} where l_quantity > 49) as has_large from {orders}",
    "scalar_correlated": "select n_nationkey, (select count(*) from {supplier} where s_nationkey = n_nationkey) as n_suppliers from {nation}",
    "lookup_precedence": "select s_suppkey, coalesce(a.n_name, b.n_name) as name from {supplier} left join (select n_nationkey, n_name from {nation} where n_regionkey = 1) a on a.n_nationkey = s_nationkey left join {nation} b on b.n_nationkey = s_nationkey % 5",
    "agg_filter": "select l_returnflag, count(*) filter (where l_quantity > 25) as n_large, cast(sum(l_quantity) filter (where l_quantity > 25) as bigint) as q, min(l_shipdate) filter (where l_quantity > 49) as first_large from {lineitem} group by l_returnflag",
    "agg_count_distinct_filter": "select o_orderstatus, count(distinct o_custkey) as n, count(distinct o_custkey) filter (where o_totalprice > 300000) as n_rich from {orders} group by o_orderstatus",
    "agg_share": "select o_orderpriority, round(avg(case when o_orderstatus = 'F' then 1 else 0 end), 6) as final_share from {orders} group by o_orderpriority",
    "agg_bool_and": "select c_nationkey, bool_and(c_acctbal > -900) as all_above from {customer} group by c_nationkey",
    "agg_median": "select p_brand, round(median(p_retailprice), 6) as m from {part} group by p_brand",
    "agg_grouping_sets": "select o_orderstatus, o_orderpriority, count(*) as n from {orders} group by grouping sets ((o_orderstatus), (o_orderpriority))",
    "agg_having_alias": "select o_custkey, count(*) as n from {orders} group by o_custkey having n >= 15",
    "agg_two_level": "select cast(n as bigint) as n_orders, count(*) as n_customers from (select o_custkey, count(*) as n from {orders} group by o_custkey) t group by n",
    "agg_distinct": "select distinct o_orderstatus, o_orderpriority from {orders}",
    "agg_global": "select count(*) as n, min(o_orderdate) as first, max(o_orderdate) as last, round(avg(o_totalprice), 4) as mean from {orders}",
    "win_topn_group": "select c_nationkey, c_custkey, rn from (select c_nationkey, c_custkey, cast(row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as bigint) as rn from {customer}) t where rn <= 5",
    "win_total_count": "select c_custkey, count(*) over () as total from {customer} where c_acctbal > 9900",
    "win_dedup_first": "select user_id, event_type, event_id from (select *, row_number() over (partition by user_id, event_type order by ts, event_id) as rn from {events}) t where rn = 1",
    "win_dedup_last": "select user_id, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from {events}) t where rn = 1",
    "win_ordinal": "select o_custkey, o_orderkey, cast(row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 as bigint) as ordinal from {orders}",
    "sort_conditional": "select o_orderkey from {orders} order by case when o_orderstatus = 'F' then o_totalprice end desc nulls last, o_orderkey limit 40",
    "sort_nulls_last": "select p_partkey, nullif(p_size, 5) as size0 from {part} order by size0 asc nulls last, p_partkey limit 30",
    "topk": "select o_orderkey, o_totalprice from {orders} order by o_totalprice desc, o_orderkey limit 20",
    "page_offset": "select o_orderkey from {orders} order by o_orderdate desc, o_orderkey desc limit 50 offset 100",
    "union_all_index": "select 'customer' as kind, c_name as label from {customer} union all select 'supplier', s_name from {supplier} union all select 'nation', n_name from {nation}",
    "union_distinct": "select c_nationkey as k from {customer} union select s_nationkey from {supplier}",
    "set_difference": "select p_partkey from {part} except select l_partkey from {lineitem} where l_quantity < 3",
    "interval_overlap": "select a.s_suppkey as s1, b.s_suppkey as s2 from {supplier} a join {supplier} b on a.s_nationkey = b.s_nationkey and a.s_suppkey < b.s_suppkey and a.s_acctbal < b.s_acctbal + 500 and b.s_acctbal < a.s_acctbal + 500",
}


def _shared(text: str):
    names = sorted(set(re.findall(r"{(\w+)}", text)))

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return spark.sql(text, **{n: table(spark, sf, n) for n in names})

    return run


def _purchases(spark, sf):
    e = table(spark, sf, "events")
    return e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.where("event_type = 'click'").select("user_id", C("ts").alias("since"), C("event_id").alias("click_id"))


def join_asof_left(spark, sf):
    buys, clicks = _purchases(spark, sf)
    return asof_left(buys, clicks, "user_id", "ts", "since", ["click_id"]).select("event_id", "click_id")


def join_array_member(spark, sf):
    """Membership of an array by explode and equi-join."""
    t = table(spark, sf, "bridge_bill_concepts").select("bill_id", "concept_id", F.explode(F.array_distinct("bullet_ids")).alias("bullet_row_id")).distinct()
    b = table(spark, sf, "cluster_result").select("bullet_row_id", "bullet").distinct()
    return t.join(b, "bullet_row_id")


def list_contains(spark, sf):
    t = table(spark, sf, "bridge_vote_bills")
    return t.groupBy("source_endpoint").agg(count_if(contains(C("source_fields"), F.element_at("source_fields", 1))).alias("n_has"), F.count(F.lit(1)).alias("n"))


def agg_arg_max(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(arg_max(C("o_orderkey"), C("o_totalprice")).alias("largest"))


def agg_any_value(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer").select(C("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
    return o.groupBy("o_custkey").agg(any_non_null(F.when(C("o_orderkey") % 3 != 0, C("c_name"))).alias("name"))


def agg_ratio_of_sums(spark, sf):
    l = table(spark, sf, "lineitem")
    return l.groupBy("l_returnflag").agg(F.round(safe_div(F.sum(F.when(C("l_linestatus") == "F", C("l_quantity"))), F.sum("l_quantity")), 6).alias("ratio"))


def agg_quantiles(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand").agg(*[F.round(F.percentile("p_retailprice", F.lit(q)), 6).alias(f"q{int(q * 100)}") for q in (0.25, 0.5, 0.75)])


def agg_collect_sorted(spark, sf):
    n = table(spark, sf, "nation")
    return n.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_set("n_name")), ",").alias("names"))


def agg_nested_json(spark, sf):
    n = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("x"))
    return n.select("n_regionkey", F.to_json("x").alias("nations_json"))


def win_topn_global(spark, sf):
    top = table(spark, sf, "customer").orderBy(C("c_acctbal").desc(), "c_custkey").limit(5)
    return top.select("c_custkey", F.row_number().over(Window.orderBy(C("c_acctbal").desc(), "c_custkey")).cast("bigint").alias("rn"))


def win_topn_labels(spark, sf):
    return top_per_group(table(spark, sf, "part").select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], nulls_last("-p_retailprice", "p_partkey"), 3)


def paged_total(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_totalprice")
    return page(o, nulls_last("-o_totalprice", "o_orderkey"), 2)


def sample_even(spark, sf):
    r = table(spark, sf, "knesset_terms").select("knesset_num")
    return evenly_spaced(r, [C("knesset_num")], r.count(), 4)


def split_unnest(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("pos", "word")).withColumn("word", T.utrim(C("word")))


def json_props(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.from_json("props", "k bigint").getField("k").alias("k"))


def regex_script(spark, sf):
    d = table(spark, sf, "documents").where("text is not null")
    return d.select("doc_id", (~C("text").rlike(r"\p{IsHebrew}\p{IsLatin}|\p{IsLatin}\p{IsHebrew}")).alias("unmixed"))


def script_ratio(spark, sf):
    d = table(spark, sf, "documents").where("text is not null")
    return d.select("doc_id", F.round(T.script_ratio(C("text")), 6).alias("ratio"))


def name_key(spark, sf):
    """Ballots whose written name is the member's in another order."""
    b = table(spark, sf, "fact_ballots").where("member_id is not null").select("member_id", "member_name_source").distinct()
    m = table(spark, sf, "dim_members").dropDuplicates(["member_id"])
    j = b.join(m, "member_id").select("member_id", "member_name_source", (T.name_key(C("member_name_source")) == T.name_key(C("member_name"))).alias("same_key"))
    return j.groupBy("same_key").agg(F.count(F.lit(1)).alias("n"))


def title_tidy(spark, sf):
    return table(spark, sf, "fact_votes").where("item_title is not null").select("vote_id", T.title_tidy(C("item_title")).alias("title")).distinct()


def content_key(spark, sf):
    b = table(spark, sf, "dim_bills").select("bill_id", F.substring(T.content_key(name=C("name"), status=C("status")), 1, 24).alias("key")).distinct()
    return b


def fmt_ids(spark, sf):
    o = table(spark, sf, "orders")
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    f = o.select(F.format_string("%d:%04d", "o_custkey", n).alias("id"))
    return f.select("id", F.substring_index("id", ":", 1).alias("parent"))


def term_lookup(spark, sf):
    """Term of a day: the last one that began on or before it."""
    t = table(spark, sf, "knesset_terms").select("knesset_num", "term_start", "term_end")
    d = table(spark, sf, "coalition_membership").where("`start` is not null").select(C("`start`").alias("day")).distinct()
    return d.join(F.broadcast(t), (C("day") >= C("term_start")) & (C("term_end").isNull() | (C("day") < C("term_end"))), "left").select(C("day").cast("string").alias("day"), "knesset_num")


def pivot_year_type(spark, sf):
    o = table(spark, sf, "orders").select(F.year("o_orderdate").alias("year"), "o_orderstatus")
    p = o.groupBy("year").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return p.select("year", *[F.coalesce(c, F.lit(0)).alias(f"n_{c.lower()}") for c in ("F", "O", "P")])


def value_counts(spark, sf):
    return table(spark, sf, "fact_votes").groupBy("detail_state").count().withColumnRenamed("count", "n")


def starts_with(spark, sf):
    return table(spark, sf, "fact_votes").where(C("item_title").isNotNull()).groupBy(C("item_title").startswith("הצעת חוק").alias("is_bill")).agg(F.countDistinct("vote_id").alias("n"))


def win_lag_gap(spark, sf):
    """Longest gap in days between days on which a user did something."""
    d = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("day")).distinct()
    before = F.lag("day").over(Window.partitionBy("user_id").orderBy("day"))
    return d.withColumn("gap", F.datediff("day", before)).groupBy("user_id").agg(F.max("gap").alias("longest"))


def reading_rule(spark, sf):
    """The reading that each motion tells of, beside the one that was recorded."""
    v = table(spark, sf, "fact_votes").select("decision", C("reading").alias("recorded"), T.reading_of(C("decision")).alias("reading"))
    return v.groupBy("decision", "recorded", "reading").agg(F.count(F.lit(1)).alias("n"))


def lookup_term_name(spark, sf):
    """Member of each ballot's name: by term and order-insensitive name, else by name."""
    known = table(spark, sf, "bridge_member_factions").where("member_id is not null").select("member_id", "knesset_num", T.name_key(C("member_name")).alias("key")).where("key <> ''")
    in_term = known.groupBy("knesset_num", "key").agg(F.min("member_id").alias("in_term"))
    anywhere = known.groupBy("key").agg(F.min("member_id").alias("anywhere"))
    terms = table(spark, sf, "fact_votes").groupBy("vote_id").agg(F.min("knesset_num").alias("knesset_num"))
    names = table(spark, sf, "fact_ballots").select("vote_id", "member_name_source").join(terms, "vote_id").select("knesset_num", "member_name_source").distinct().withColumn("key", T.name_key(C("member_name_source")))
    found = names.join(in_term, ["knesset_num", "key"], "left").join(anywhere, "key", "left")
    return found.select("knesset_num", "member_name_source", F.coalesce("in_term", "anywhere").alias("member_id"), F.when(C("in_term").isNotNull(), "term").when(C("anywhere").isNotNull(), "any").otherwise("none").alias("by"))


def coverage_pivot(spark, sf):
    d = table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), count_if(C("text").isNotNull()).alias("n_text"))
    return d.withColumn("pct", F.bround(safe_div(C("n_text") * 100, C("n")), 1))


def pie_slices(spark, sf):
    """Slices from three per cent, at most ten; the rest is one slice."""
    s = table(spark, sf, "dim_bills").groupBy(F.coalesce("committee_name", F.lit("")).alias("committee")).agg(F.count(F.lit(1)).alias("n"))
    total = s.agg(F.sum("n").alias("all"))
    own = s.crossJoin(F.broadcast(total)).where(C("n") * 100 >= 3 * C("all")).orderBy(*nulls_last("-n", "committee")).limit(10).select("committee")
    named = s.join(own.withColumn("own", F.lit(True)), "committee", "left")
    return named.groupBy(F.when(C("own"), C("committee").cast("string")).otherwise("other").alias("slice")).agg(F.sum("n").alias("n"))


def rising_fading(spark, sf):
    d = table(spark, sf, "orders").groupBy("o_orderpriority").agg((count_if(F.year("o_orderdate") == 1999) - count_if(F.year("o_orderdate") == 1998)).alias("delta"))
    up = d.where("delta > 0").orderBy(*nulls_last("-delta", "o_orderpriority")).limit(5).withColumn("side", F.lit("rising"))
    down = d.where("delta < 0").orderBy(*nulls_last("delta", "o_orderpriority")).limit(5).withColumn("side", F.lit("fading"))
    return up.unionByName(down)


def url_canonical(spark, sf):
    urls = table(spark, sf, "passed_bills_raw").where("payload is not null").select("raw_id", F.explode(F.regexp_extract_all("payload", F.lit(r'(https:[^"\s,}\]]+\.(?:pdf|PDF|docx?|rtf)(?:\?v=\d+)?)'), 1)).alias("url")).distinct()
    u = F.regexp_replace("url", r"\\\\", r"\\")
    return urls.select("raw_id", "url", T.url_canonical(u).alias("canonical"), T.document_format(F.lit(None).cast("string"), C("url")).alias("format"))


RECIPES = {f.__name__: f for f in (join_asof_left, join_array_member, list_contains, agg_arg_max, agg_any_value, agg_ratio_of_sums, agg_quantiles, agg_collect_sorted, agg_nested_json, win_topn_global, win_topn_labels, paged_total, sample_even, split_unnest, json_props, regex_script, script_ratio, name_key, title_tidy, content_key, fmt_ids, term_lookup, pivot_year_type, value_counts, coverage_pivot, pie_slices, rising_fading, url_canonical, win_lag_gap, reading_rule, lookup_term_name, starts_with)}

QUERIES = {**{name: _shared(text) for name, text in SHARED.items()}, **RECIPES}

_KEY = r"array_to_string(list_sort(list_filter(regexp_split_to_array(regexp_replace({c}, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+'), lambda w: w <> '')), ' ')"

ORACLE_SQL = {
    **{name: re.sub(r"{(\w+)}", r"\1", text) for name, text in SHARED.items()},
    "join_asof_left": "select e.event_id, c.click_id from (select * from events where event_type = 'purchase') e asof left join (select user_id, ts since, event_id click_id from events where event_type = 'click') c on e.user_id = c.user_id and e.ts >= c.since",
    "join_array_member": "select distinct b.bullet_row_id, t.bill_id, t.concept_id, b.bullet from (select distinct bill_id, concept_id, unnest(bullet_ids) id from bridge_bill_concepts) t join cluster_result b on b.bullet_row_id = t.id",
    "list_contains": "select source_endpoint, sum(list_contains(source_fields, source_fields[1])::int)::bigint n_has, count(*) n from bridge_vote_bills group by 1",
    "agg_arg_max": "select o_custkey, max_by(o_orderkey, (o_totalprice, o_orderkey)) largest from orders group by 1",
    "agg_any_value": "select o_custkey, any_value(if(o_orderkey % 3 = 0, null, c_name)) name from orders join customer on c_custkey = o_custkey group by 1",
    "agg_ratio_of_sums": "select l_returnflag, round(sum(l_quantity) filter (where l_linestatus = 'F') / sum(l_quantity), 6) ratio from lineitem group by 1",
    "agg_quantiles": "select p_brand, round(quantile_cont(p_retailprice, 0.25), 6) q25, round(quantile_cont(p_retailprice, 0.5), 6) q50, round(quantile_cont(p_retailprice, 0.75), 6) q75 from part group by 1",
    "agg_collect_sorted": "select n_regionkey, string_agg(n_name, ',' order by n_name) \"names\" from (select distinct n_regionkey, n_name from nation) group by 1",
    "agg_nested_json": """select n_regionkey, '[' || string_agg('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}', ',' order by n_nationkey) || ']' nations_json from nation group by 1""",
    "win_topn_global": "select c_custkey, row_number() over (order by c_acctbal desc, c_custkey) rn from customer qualify rn <= 5",
    "win_topn_labels": "select p_brand, p_partkey, p_retailprice, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) \"rank\" from part qualify \"rank\" <= 3",
    "paged_total": "select o_orderkey, o_totalprice, count(*) over () total from orders where o_orderstatus = 'P' order by o_totalprice desc, o_orderkey limit 50 offset 50",
    "sample_even": "select knesset_num from (select knesset_num, row_number() over (order by knesset_num) - 1 rn from knesset_terms) where rn % 2 = 0 and rn / 2 < 4",
    "split_unnest": "select p_partkey, generate_subscripts(w, 1)::int - 1 pos, unnest(w) word from (select p_partkey, string_split(p_name, ' ') w from part)",
    "json_props": "select event_id, (props->>'k')::bigint k from events",
    "regex_script": r"select doc_id, not regexp_matches(text, '\p{Hebrew}\p{Latin}|\p{Latin}\p{Hebrew}') unmixed from documents where text is not null",
    "script_ratio": "select doc_id, round(coalesce(len(regexp_replace(text, '[^\u0590-\u05FF]', '', 'g')) / nullif(len(regexp_replace(text, '[\\s\\p{Z}\\x{85}\\x{b}\\x{1c}-\\x{1f}]', '', 'g')), 0), 0.0), 6) ratio from documents where text is not null",
    "name_key": "select same_key, count(*) n from (select k1 = k2 same_key from (select distinct member_id, member_name_source from fact_ballots where member_id is not null) b join (select member_id, min(member_name) member_name from dim_members group by 1) m using (member_id), lateral (select array_to_string(list_sort(list_filter(regexp_split_to_array(regexp_replace(member_name_source, '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+'), lambda x: x <> '')), ' ') k1), lateral (select array_to_string(list_sort(list_filter(regexp_split_to_array(regexp_replace(member_name, '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+'), lambda x: x <> '')), ' ') k2)) group by 1",
    "title_tidy": "select distinct vote_id, regexp_replace(trim(regexp_replace(item_title, '[\\s\\p{Z}]+', ' ', 'g')), '\\.+$', '') title from fact_votes where item_title is not null",
    "term_lookup": "select d.day::varchar \"day\", knesset_num from (select distinct \"start\" \"day\" from coalition_membership where \"start\" is not null) d left join knesset_terms t on d.day >= term_start and (term_end is null or d.day < term_end)",
    "pivot_year_type": "select year(o_orderdate)::int \"year\", count(*) filter (where o_orderstatus = 'F') n_f, count(*) filter (where o_orderstatus = 'O') n_o, count(*) filter (where o_orderstatus = 'P') n_p from orders group by 1",
    "value_counts": "select detail_state, count(*) n from fact_votes group by 1",
    "win_lag_gap": "select user_id, max(gap)::int longest from (select user_id, day - lag(day) over (partition by user_id order by day) gap from (select distinct user_id, ts::date \"day\" from events)) group by 1",
    "starts_with": "select starts_with(item_title, 'הצעת חוק') is_bill, count(distinct vote_id) n from fact_votes where item_title is not null group by 1",
    "reading_rule": "select decision, reading recorded, case when contains(decision, 'להכנה לקריאה') then 1 when contains(decision, 'טרומית') then 0 when contains(decision, 'קריאה שלישית') then 3 when regexp_matches(decision, 'קריאה שני?יה') then 2 when contains(decision, 'קריאה ראשונה') then 1 end reading, count(*) n from fact_votes group by all",
    "lookup_term_name": f"with known as (select member_id, knesset_num, {_KEY.format(c='member_name')} key from bridge_member_factions where member_id is not null), n as (select distinct knesset_num, member_name_source, {_KEY.format(c='member_name_source')} key from fact_ballots join (select vote_id, min(knesset_num) knesset_num from fact_votes group by 1) using (vote_id)) select knesset_num, member_name_source, coalesce(a, b) member_id, case when a is not null then 'term' when b is not null then 'any' else 'none' end \"by\" from n left join (select knesset_num, key, min(member_id) a from known where key <> '' group by all) using (knesset_num, key) left join (select key, min(member_id) b from known where key <> '' group by all) using (key)",
    "url_canonical": r"""with u as (select distinct raw_id, unnest(regexp_extract_all(payload, '(https:[^"\s,}\]]+\.(?:pdf|PDF|docx?|rtf)(?:\?v=\d+)?)', 1)) url from passed_bills_raw where payload is not null),
        x as (select raw_id, url, trim(replace(replace(url, chr(92) || chr(92), chr(92)), chr(92), '/')) c from u), y as (select *, regexp_extract(c, '^[a-z]+://[^/?#]*') f from x), z as (select *, regexp_extract(substr(c, length(f) + 1), '^[^?#]*') p from y)
        select raw_id, url, f || regexp_replace(p, '/+', '/', 'g') || substr(c, length(f) + length(p) + 1) canonical, lower(nullif(regexp_extract(url, '\.([A-Za-z0-9]{2,5})(?:[?#].*)?$', 1), '')) format from z""",
    "content_key": "select distinct bill_id, left(sha256(to_json(struct_pack(name := name, status := status))), 24) key from dim_bills",
    "coverage_pivot": "select source, count(*) n, count(text) n_text, round_even(count(text) * 100.0::double / count(*), 1) pct from documents group by 1",
    "pie_slices": "with s as (select coalesce(committee_name, '') committee, count(*) n from dim_bills group by 1), own as (select committee from s where n * 100 >= 3 * (select sum(n) from s) order by n desc, committee limit 10) select coalesce(own.committee, 'other') slice, sum(n)::bigint n from s left join own using (committee) group by 1",
    "rising_fading": "with d as (select o_orderpriority, count(*) filter (where year(o_orderdate) = 1999) - count(*) filter (where year(o_orderdate) = 1998) delta from orders group by 1) (select *, 'rising' side from d where delta > 0 order by delta desc, 1 limit 5) union all (select *, 'fading' from d where delta < 0 order by delta, 1 limit 5)",
    "fmt_ids": "select o_custkey || ':' || lpad((row_number() over (partition by o_custkey order by o_orderkey) - 1)::varchar, 4, '0') id, o_custkey::varchar parent from orders",
}
