"""DuckDB SQL with the same results as the model and its queries.

``BASE`` declares the derived tables as common table expressions (materialised
once per statement); each query adds its own select. Parameters are picked by the
same rules as in the catalogue.
"""

from __future__ import annotations

from quorumlake.plans.problems import split_sql
from quorumlake.plans.quality import report_sql

_DATE = "coalesce(try_strptime(left({c}, 10), '%Y-%m-%d'), try_strptime(left({c}, 10), '%d/%m/%Y'), try_strptime(left({c}, 8), '%Y%m%d'))::date"
_TS = "coalesce(try_cast(replace({c}, 'T', ' ') as timestamp), try_cast(replace({c}, 'T', ' ') || ':00' as timestamp))"


def _once(name: str, key: str, may_lack: str = "") -> str:
    gaps = "".join(f", ({c} is null)::int" if n == 0 else f" + ({c} is null)::int" for n, c in enumerate(may_lack.split()))
    return f"(select * from {name} qualify row_number() over (partition by {key} order by loaded_at{gaps}) = 1)"


def _stage(linked: str, has_second: str) -> str:
    return f"""case when kind = 3 then 'no_confidence' when kind = 4 then 'motion' when kind = 6000 then 'regulation' when not ({linked}) then 'other'
        when reading = 3 then 'third' when reading = 2 then 'second' when contains(decision, 'להכנה לקריאה ראשונה') then 'preliminary' when contains(decision, 'להכנה לקריאה שני') then 'first'
        when decision = 'לקבל את ההסתייגות' then 'reservation' when decision = 'לדחות את ההצעה' then if({has_second}, 'reservation', 'preliminary') else 'other' end"""


_KEY = r"array_to_string(list_sort(list_filter(regexp_split_to_array(regexp_replace({c}, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+'), lambda w: w <> '')), ' ')"
_VOTE_GAPS = "source_knesset_num plenum_session_id item_id lu_item_type vote_datetime item_title decision reading accepted"


_CTES = {
    "ballot": f"select ballot_id, vote_id, member_id, nullif(trim(source_faction_name), '') own_faction, vote_result_id r from {_once('fact_ballots', 'ballot_id')}",
    "link": "select distinct vote_id, bill_id from bridge_vote_bills where vote_id is not null and bill_id is not null",
    "tally": "select vote_id, count(*) filter (where r = 7) f, count(*) filter (where r = 8) a, count(*) filter (where r = 9) ab from ballot group by vote_id",
    "plain_vote": f"""select v.vote_id, v.knesset_num, {_TS.format(c='v.vote_datetime')} ts, v.item_title, v.decision, v.reading, v.accepted, v.lu_item_type kind, v.vote_type,
        coalesce(f, 0) n_for, coalesce(a, 0) n_against, coalesce(ab, 0) n_abstain, tally.vote_id is not null has_ballots
        from {_once('fact_votes', 'vote_id', _VOTE_GAPS)} v left join tally using (vote_id)""",
    "second_day": "select distinct bill_id, ts::date d from plain_vote join link using (vote_id) where reading = 2 and ts is not null",
    # a link's stage looks at its own bill, a vote's stage at all bills linked to it
    "vote_bill": f"select p.*, bill_id, ts::date vote_date, {_stage('true', 'exists (from second_day s where s.bill_id = link.bill_id and s.d = p.ts::date)')} stage from plain_vote p join link using (vote_id)",
    "vote": f"select p.*, bill_id, ts::date vote_date, {_stage('bill_id is not null', 'exists (from second_day s join link k using (bill_id) where k.vote_id = p.vote_id and s.d = p.ts::date)')} stage from plain_vote p left join (select vote_id, min(bill_id) bill_id from link group by 1) using (vote_id)",
    "stint": f"select member_id, trim(faction_name) stint_faction, knesset_num, {_DATE.format(c='begin_date')} since from bridge_member_factions where member_id is not null qualify row_number() over (partition by member_id, since order by knesset_num desc nulls last, trim(faction_name) desc nulls last) = 1",
    "topic_of": "select committee_name, min(topic_id) topic_id from committee_topics group by 1",
    "bill": f"""select b.bill_id, b.name, b.status, b.proposal_type, b.knesset_num, trim(b.committee_name) committee, b.initiators, b.status = 'התקבלה בקריאה שלישית' passed, topic_id, first_vote_date, first_reading_date, final_date
        from {_once('dim_bills', 'bill_id')} b left join topic_of t on t.committee_name = trim(b.committee_name)
        left join (select bill_id, min(vote_date) first_vote_date, min(if(stage = 'first', vote_date, null)) first_reading_date, min(if(stage = 'third', vote_date, null)) final_date from vote_bill group by 1) d using (bill_id)""",
    "tag": f"select * exclude (concept_label, concept_criterion) from {_once('bridge_bill_concepts', 'bill_id, concept_id')}",
    "bullet_text": "select bullet_row_id, min(bill_id) bill_id, min(bullet) bullet from cluster_result group by 1",
    "concept": r"""select c.concept_id, c.concept_label, c.concept_criterion, n_bills, n_committees, k_from, k_to, n_committees >= greatest(3, ceil(n_all * 2 / 10)) is_generic
        from dim_concepts c join (select concept_id, count(distinct bill_id) n_bills, count(distinct if(committee <> 'טרם נקבעה', committee, null)) n_committees, min(knesset_num) k_from, max(knesset_num) k_to from tag join bill using (bill_id) group by 1) using (concept_id)
        cross join (select count(distinct if(committee <> 'טרם נקבעה', committee, null)) n_all from tag join bill using (bill_id))
        where not regexp_matches(concept_label, '[^\p{Hebrew}\p{Latin}\P{L}]|\p{Hebrew}\p{Latin}|\p{Latin}\p{Hebrew}')""",
    "side": "select distinct party_id, knesset_num, \"start\" s, \"end\" e from coalition_membership where \"start\" is not null and (\"end\" is null or \"end\" > \"start\")",
    "lineage": "select faction_name, knesset_num, min(party_id) party_id from faction_lineage group by all",
    "ballot_known": "select b.*, v.knesset_num, v.vote_date, v.bill_id, v.stage from ballot b join vote v using (vote_id)",
    "ballot_faction": "select k.*, coalesce(own_faction, stint_faction) faction from ballot_known k asof left join (select * from stint where since is not null) st on st.member_id = k.member_id and k.vote_date >= st.since",
    "bx": """select b.ballot_id, b.vote_id, b.member_id, b.knesset_num, b.vote_date, b.bill_id, b.stage, faction, party_id, case r when 7 then 'for' when 8 then 'against' when 9 then 'abstain' when 6 then 'present' else 'other' end choice,
        exists (from side where side.party_id = l.party_id and side.knesset_num = b.knesset_num and b.vote_date >= s and (e is null or b.vote_date < e)) is_coalition
        from ballot_faction b left join lineage l on l.faction_name = faction and l.knesset_num = b.knesset_num""",
    "pv": """select t.*, ['against', 'split', 'for'][2 + sign(n_for - n_against)::int] "position", abs(n_for - n_against)::double / nullif(n_for + n_against, 0) rice
        from (select vote_id, party_id, knesset_num, max(is_coalition) is_coalition, sum((choice = 'for')::int)::bigint n_for, sum((choice = 'against')::int)::bigint n_against, sum((choice = 'abstain')::int)::bigint n_abstain from bx where party_id is not null group by all) t""",
    # each side's margin and the positions its parties took
    "side_vote": "select vote_id, is_coalition, if(sum(n_for + n_against) > 0, if(sum(n_for - n_against) > 0, 'for', 'against'), null) went, list(distinct \"position\") took from pv group by all",
    "bloc": "select vote_id, c.went coalition_position, o.went opposition_position, coalesce(c.went <> o.went and c.took = [c.went] and o.took = [o.went], false) is_bloc_vote from (from side_vote where is_coalition) c full join (from side_vote where not is_coalition) o using (vote_id)",
    "svc": "select member_id, knesset_num, min(vote_date) first_date, max(vote_date) last_date, max_by(party_id, (vote_date, party_id)) filter (party_id is not null and vote_date is not null) last_party_id, count(*) n_ballots from bx where member_id is not null group by 1, 2",
    "could": "select s.*, (select count(*) from vote v where v.knesset_num = s.knesset_num and has_ballots and vote_date between first_date and last_date) eligible from svc s where first_date is not null",
    "member": "select member_id, min(member_name) member_name from dim_members group by 1",
    "named": rf"""select distinct bill_id, name, {_KEY.format(c="regexp_replace(regexp_replace(name, '" + chr(92) + "s*[(" + chr(92) + "[].*?[)" + chr(92) + "]]', '', 'g'), '^(ד\"ר|עו\"ד|ח\"כ|רו\"ח|פרופ'')" + chr(92) + "s+', '')")} key from (select bill_id, unnest({split_sql('initiators')}) name from bill where proposal_type = 'פרטית' and initiators is not null)""",
    "initiator": f"select bill_id, name, coalesce(by_name, by_key) member_id from named left join (select member_name name, min(member_id) by_name from member group by 1) using (name) left join (select {_KEY.format(c='member_name')} key, min(member_id) by_key from member group by 1) using (key)",
    "party": "select party_id, faction_name party_name, (length(party_id) % 5 + 1)::int color_index from (select party_id, faction_name, count(distinct knesset_num) n from faction_lineage group by all) qualify row_number() over (partition by party_id order by n desc, faction_name) = 1",
    "last_vote": "select bill_id, max_by(vote_id, (ts, vote_id)) last_vote_id from vote_bill where ts is not null group by 1",
    "counted_tag": "select distinct vote_id, concept_id from vote_bill join tag using (bill_id) where stage in ('preliminary', 'first', 'third')",
    "term_pick": "select knesset_num k from vote group by 1 order by count(*) desc, 1 desc limit 1",
    "member_pick": "select member_id m from bx join member using (member_id) group by 1 order by count(*) desc, 1 limit 1",
    "party_pick": "select party_id p from pv group by 1 order by count(*) desc, 1 limit 1",
    "concept_pick": "select concept_id c from concept order by n_bills desc, 1 limit 1",
    "vote_pick": "select vote_id v from vote where bill_id in (select bill_id from tag where primary_evidence_bullet_id in (select bullet_row_id from bullet_text)) order by n_for + n_against desc, 1 limit 1",
}

BASE = "with " + ",\n".join(f"{name} as materialized ({text})" for name, text in _CTES.items()) + "\n"

_K, _M, _P, _CO, _V = "(select k from term_pick)", "(select m from member_pick)", "(select p from party_pick)", "(select c from concept_pick)", "(select v from vote_pick)"
_MINISTER = "(select member_id from dim_governments where member_id is not null group by 1 order by count(*) desc, 1 limit 1)"
_COUNTED = "('preliminary', 'first', 'third')"
_FA = "choice in ('for', 'against')"
_MY = f"bx.member_id = {_M}"
_SPLIT = "n_for + n_against >= 3 and rice < 1"
_WITH_PARTY = "bx join (select vote_id, party_id, n_for pf, n_against pa, \"position\" from pv) using (vote_id, party_id)"
_AGAINST = "(choice in ('for', 'against') and \"position\" in ('for', 'against') and choice <> \"position\" and pf + pa >= 3)"
_SERVING = f"(select s.member_id, coalesce(c.party_id, s.last_party_id) party_id, c.choice from svc s join vote v on v.vote_id = {_V} and v.knesset_num = s.knesset_num and v.vote_date between first_date and last_date left join (select member_id, party_id, choice from bx where vote_id = {_V}) c using (member_id))"
_EVIDENCE = "(select t.bill_id, t.concept_id, t.bill_bullet_share, b.bullet_row_id, b.bullet, b.bullet_row_id = t.primary_evidence_bullet_id is_primary from (select *, unnest(list_distinct(bullet_ids)) id from tag) t join bullet_text b on b.bullet_row_id = t.id)"


def _paged(cols: str, source: str, order: str, number: int = 1) -> str:
    return f"select {cols}, count(*) over () total from {source} order by {order} limit 50 offset {50 * (number - 1)}"


_SELECTS = {
    "v01_votes": "select vote_id, knesset_num, ts::varchar ts, item_title, decision, reading, accepted, bill_id, n_for, n_against, n_abstain, has_ballots from vote",
    "v02_vote_stage": "select vote_id, stage from vote",
    "v03_stints": "select member_id, knesset_num, stint_faction faction_name, since::varchar start_date from stint where since is not null",
    "v04_bills": "select bill_id, name, status, proposal_type, knesset_num, committee committee_name, passed, topic_id, first_vote_date::varchar first_vote_date, first_reading_date::varchar first_reading_date, final_date::varchar final_date from bill",
    "v05_concepts": "select * from concept",
    "v06_ballots_x": "select ballot_id, vote_id, member_id, knesset_num, vote_date::varchar vote_date, bill_id, stage, choice, faction faction_name, party_id, is_coalition from bx",
    "v07_party_vote": "select vote_id, party_id, knesset_num, is_coalition, n_for, n_against, n_abstain, \"position\", round(rice, 6) rice from pv",
    "v08_vote_bloc": "select * from bloc",
    "v09_mk_service": "select member_id, knesset_num, first_date::varchar first_date, last_date::varchar last_date, last_party_id, n_ballots from svc",
    "v11_search_index": "select 'mk' kind, member_id::varchar id, member_name label from member where member_id in (select member_id from svc) union all select 'party', party_id, party_name from party union all select 'bill', last_vote_id::varchar, name from bill join last_vote using (bill_id) union all select 'concept', concept_id, concept_label from concept",
    "q01_search": "select * from (select 'mk' kind, member_id::varchar id, member_name label from member where member_id in (select member_id from svc) union all select 'party', party_id, party_name from party union all select 'bill', last_vote_id::varchar, name from bill join last_vote using (bill_id) union all select 'concept', concept_id, concept_label from concept) where label ilike '%ים%' order by kind, length(label), id limit 30",
    "q02_parties": "select * from party",
    "q03_topics": "select distinct topic_id, upper(topic_id[1]) || topic_id[2:] topic_name from committee_topics",
    "q04_home_counts": "select (select count(*) from vote) votes, (select count(*) from bx) ballots, (select count(*) filter (where passed) from bill) laws_passed, count(distinct member_id) mks, count(distinct last_party_id) parties, (select count(*) filter (where not is_generic) from concept) concepts, (select max(vote_date)::varchar from vote) last_date from svc",
    "q05_recent_laws": "select bill_id, name, final_date::varchar final_date, (select max_by(vote_id, (ts, vote_id)) from vote_bill v where v.bill_id = b.bill_id and stage = 'third' and ts is not null) final_vote_id from bill b where passed and final_date is not null order by b.final_date desc, bill_id desc limit 20",
    "q06_laws_by_year": "select year(first_vote_date)::int \"year\", proposal_type, passed, count(*) n from bill where first_vote_date is not null group by all",
    "q07_laws_funnel": f"select stage, count(distinct bill_id) bills from vote_bill where knesset_num = {_K} and stage in {_COUNTED} group by 1",
    "q08_laws_time": "select proposal_type, count(*) n, round(quantile_cont(d, 0.5), 6) median_days, round(quantile_cont(d, 0.25), 6) p25, round(quantile_cont(d, 0.75), 6) p75 from (select proposal_type, (final_date - first_reading_date)::double d from bill) where d is not null group by 1",
    "q09_laws_consensus": "select year(vote_date)::int \"year\", round(avg(if(n_against = 0, 1, 0)), 6) zero_against_share, count(*) filter (where n_against = 0) zero_against, count(*) finals from vote where stage = 'third' group by 1",
    "q10_members": f"select member_id, member_name, last_party_id party_id, party_name, color_index, n_ballots, round(n_ballots / eligible, 6) participation from could join member using (member_id) left join party on party_id = last_party_id where knesset_num = {_K} and eligible > 0",
    "q11_mk_service": f"select member_name, knesset_num, first_date::varchar first_date, last_date::varchar last_date, last_party_id, party_name, n_ballots from svc join member using (member_id) left join party on party_id = last_party_id where member_id = {_M}",
    "q12_mk_positions": f"select distinct government_id, position_name, ministry_name, left(start_date, 10) start_date, left(finish_date, 10) finish_date from dim_governments where member_id = (select member_id from dim_governments where member_id is not null group by 1 order by count(*) desc, 1 limit 1)",
    "q13_mk_kpi": f"""select n_ballots, round(n_ballots / eligible, 6) participation, r.n against_party, r.agreement agreement_with_party, i.initiated, i.passed, g.gap max_gap_days
        from (select sum(n_ballots)::bigint n_ballots, sum(eligible) eligible from could where member_id = {_M}) c,
        (select count(*) filter (where choice <> "position") n, round(avg(if(choice = "position", 1, 0)), 6) agreement from {_WITH_PARTY} where {_MY} and {_FA} and "position" in ('for', 'against') and pf + pa >= 3) r,
        (select count(distinct bill_id) initiated, count(distinct if(passed, bill_id, null)) passed from initiator n join bill using (bill_id) where n.member_id = {_M} and knesset_num in (select knesset_num from svc where member_id = {_M})) i, (select max(d - pd) gap from (select vote_date d, lag(vote_date) over (partition by knesset_num order by vote_date) pd from (select distinct knesset_num, vote_date from bx where {_MY}))) g""",
    "q14_mk_yearly": f"select year(vote_date)::int \"year\", count(*) filter (where choice = 'for') n_for, count(*) filter (where choice = 'against') n_against, count(*) filter (where choice = 'abstain') n_abstain, count(*) filter (where choice = 'present') n_present from bx where {_MY} and stage not in ('reservation', 'second') group by 1",
    "q15_mk_participation": f"""select "year", round(max(if(member_id = {_M}, x, null)), 6) mk, round(median(x), 6) party_median from (
        select member_id, "year", coalesce(cast_n, 0) / n x from (select member_id, year(vote_date)::int "year", count(*) n from peer p join vote v on v.knesset_num = p.knesset_num and has_ballots and v.vote_date between first_date and last_date group by all)
        left join (select member_id, year(vote_date)::int "year", count(*) cast_n from bx join peer using (member_id, knesset_num) group by all) using (member_id, "year")) group by 1""",
    "q16_mk_concepts": f"select concept_id, concept_label, count(*) n_votes, round(avg(if(choice = 'for', 1, 0)), 6) a_share, count(*) filter (where choice = 'for') a_for, count(*) filter (where choice = 'against') a_against, round(sum(pf) / sum(pf + pa), 6) b_share, sum(pf)::bigint b_for, sum(pa)::bigint b_against from {_WITH_PARTY} join counted_tag using (vote_id) join concept using (concept_id) where {_MY} and {_FA} and not is_generic group by 1, 2 having count(*) >= 5 order by n_votes desc, concept_label, concept_id limit 50",
    "q17_mk_concept_votes": f"select bx.vote_id, bx.vote_date::varchar vote_date, v.item_title, v.stage, choice, \"position\", bt.bullet from {_WITH_PARTY} join vote_bill v on v.vote_id = bx.vote_id join tag t on t.bill_id = v.bill_id and t.concept_id = {_CO} left join bullet_text bt on bt.bullet_row_id = t.primary_evidence_bullet_id where {_MY} and {_FA} and v.stage in {_COUNTED} order by v.ts desc, bx.vote_id desc limit 200",
    "q18_mk_votes": _paged("vote_id, bx.vote_date::varchar vote_date, v.item_title, bx.stage, choice, \"position\", " + _AGAINST + " against_party", f"{_WITH_PARTY} join (select vote_id, ts, item_title from vote) v using (vote_id) where {_MY}", "v.ts desc, vote_id desc, ballot_id"),
    "q19_mk_similar": f"""select z.member_id, member_name, z.party_id, party_name, color_index, n_common, agreement, z.party_id is distinct from (select max_by(last_party_id, knesset_num) filter (last_party_id is not null) from svc where member_id = {_M}) cross_party
        from (select o.member_id, max_by(party_id, (vote_date, party_id)) filter (party_id is not null and vote_date is not null) party_id, count(*) n_common, round(avg(if(o.choice = mine.choice, 1, 0)), 6) agreement from bx o join (select vote_id, choice from bx where {_MY} and {_FA}) mine using (vote_id)
        where o.member_id <> {_M} and o.choice in ('for', 'against') and o.vote_id in (select vote_id from bloc) group by 1 having count(*) >= 100) z join member using (member_id) left join party on party.party_id = z.party_id order by agreement desc, n_common desc, z.member_id limit 20""",
    "v10_bill_initiators": "select * from initiator",
    "q20_mk_bills": f"select bill_id, name, status, case when passed then 'passed' when first_reading_date is not null then 'first' else 'preliminary' end reached, last_vote_id from bill left join last_vote using (bill_id) where bill_id in (select bill_id from initiator where member_id = {_M})",
    "q42_party_bills": f"select bill_id, name, status, passed, last_vote_id from bill b left join last_vote using (bill_id) where exists (from initiator n join svc using (member_id) where n.bill_id = b.bill_id and svc.knesset_num = b.knesset_num and last_party_id = {_P})",
    "q21_mk_stints": f"select knesset_num, stint_faction faction_name, since::varchar start_date from stint where since is not null and member_id = {_M} and knesset_num >= 16",
    "q22_coverage": "select knesset_num, count(*) votes, count(distinct vote_date) \"days\", count(*) filter (where stage = 'third') finals, min(vote_date)::varchar first_date, max(vote_date)::varchar last_date from vote group by 1",
    "q23_concept": f"select *, (select count(distinct vote_id) from tag t join vote_bill using (bill_id) where t.concept_id = {_CO}) n_votes from concept where concept_id = {_CO}",
    "q24_concept_parties": f"select party_id, party_name, color_index, round(avg(if(choice = 'for', 1, 0)), 6) for_share, count(distinct vote_id) n_votes, count(*) filter (where choice = 'for') n_for, count(*) filter (where choice = 'against') n_against from bx join counted_tag using (vote_id) join party using (party_id) where concept_id = {_CO} and {_FA} group by 1, 2, 3 order by n_votes desc, party_id limit 12",
    "q25_concept_stages": f"select stage, coalesce(c, stage in {_COUNTED}) counted, count(distinct vote_id) n_votes, count(distinct if(n_against > 0, vote_id, null)) n_contested, count(distinct bill_id) n_bills from (select v.*, stage in {_COUNTED} c from vote_bill v join tag using (bill_id) where concept_id = {_CO}) group by grouping sets ((stage), (c))",
    "q26_concept_bills": f"select bill_id, name, b.knesset_num, proposal_type, passed, final_date::varchar final_date, last_vote_id from bill b join tag using (bill_id) left join last_vote using (bill_id) where concept_id = {_CO}",
    "q27_concept_evidence": f"select bill_id, bullet, is_primary from {_EVIDENCE} where concept_id = {_CO}",
    "q28_concept_contested": f"select vote_id, vote_date::varchar vote_date, item_title, stage, n_for, n_against, n_abstain, accepted from vote where vote_id in (select vote_id from vote_bill join tag using (bill_id) where concept_id = {_CO}) and n_against >= 10 order by ts desc nulls last, vote_id desc limit 50",
    "q29_concept_yearly": f"select year(first_vote_date)::int \"year\", count(distinct if(passed, bill_id, null)) n_passed, count(distinct if(not passed, bill_id, null)) n_other from bill join tag using (bill_id) where concept_id = {_CO} and first_vote_date is not null group by 1",
    "q30_concept_party_terms": f"select bx.knesset_num, party_id, party_name, color_index, round(avg(if(choice = 'for', 1, 0)), 6) for_share, count(distinct vote_id) n_votes from bx join counted_tag using (vote_id) join party using (party_id) where concept_id = {_CO} and {_FA} and party_id in (select party_id from bx join counted_tag using (vote_id) where concept_id = {_CO} and {_FA} and party_id is not null group by 1 order by count(distinct vote_id) desc, party_id limit 6) group by all",
    "q31_concepts_summary": "select count(*) filter (where not is_generic) n_concepts, count(*) filter (where is_generic) n_generic, (select count(distinct bill_id) from tag) n_bills, min(k_from) k_from, max(k_to) k_to from concept",
    "q32_concepts_list": "select c.concept_id, concept_label, n_bills, k_from, k_to, count(distinct vote_id) n_votes, count(distinct if(passed, bill_id, null)) n_passed from concept c join tag using (concept_id) join bill using (bill_id) left join vote_bill v using (bill_id) where not is_generic group by 1, 2, 3, 4, 5 order by n_bills desc, concept_label, concept_id limit 60",
    "q33_concepts_yearly": "select year(first_vote_date)::int \"year\", rn, concept_id, concept_label, count(distinct bill_id) n_bills from (select concept_id, concept_label, row_number() over (order by n_bills desc, concept_id) rn from concept where not is_generic order by rn limit 5) join tag using (concept_id) join bill using (bill_id) where first_vote_date is not null group by all",
    "q34_concepts_trend": """select concept_id, concept_label, k1, k2, n1, n2, round(n1 / a1, 6) share1, round(n2 / a2, 6) share2, round(n2 / a2 - n1 / a1, 6) delta from (
        select concept_id, concept_label, k1, k2, a1, a2, count(distinct if(b.knesset_num = k1, bill_id, null)) n1, count(distinct if(b.knesset_num = k2, bill_id, null)) n2 from concept join tag using (concept_id) join bill b using (bill_id) cross join two where not is_generic group by all) where n1 + n2 >= 3""",
    "q35_parties_list": f"select party_id, party_name, color_index, n_mks, participation, coalition_share from (select last_party_id party_id, count(*) n_mks, round(sum(n_ballots) / sum(eligible), 6) participation from could where knesset_num = {_K} and eligible > 0 group by 1) join party using (party_id) left join (select party_id, round(avg(is_coalition::int), 6) coalition_share from pv where knesset_num = {_K} group by 1) using (party_id)",
    "q36_parties_faces": f"select last_party_id party_id, member_id, member_name from svc join member using (member_id) where knesset_num = {_K} qualify row_number() over (partition by last_party_id order by n_ballots desc, member_id) <= 5",
    "q37_party": f"select distinct party_id, party_name, color_index, knesset_num from party join svc on last_party_id = party_id where party_id = {_P}",
    "q38_party_coalition": f"select distinct knesset_num, \"start\"::varchar \"start\", \"end\"::varchar \"end\", kind from coalition_membership where party_id = {_P}",
    "q39_party_kpi": f"""select n_mks, participation, cohesion, sided_with_coalition from (select count(distinct member_id) n_mks, round(sum(n_ballots) / sum(eligible), 6) participation from could where last_party_id = {_P} and eligible > 0),
        (select round(avg(rice), 6) cohesion, round(avg(if("position" in ('for', 'against') and coalition_position <> opposition_position, ("position" = coalition_position)::int, null)), 6) sided_with_coalition from pv join bloc using (vote_id) join vote using (vote_id) where party_id = {_P} and stage in {_COUNTED})""",
    "q40_party_concepts": f"select concept_id, concept_label, count(*) n_votes, round(sum(pv.n_for) / sum(pv.n_for + pv.n_against), 6) a_share, sum(pv.n_for)::bigint a_for, sum(pv.n_against)::bigint a_against, round(sum(hf) / sum(hf + ha), 6) b_share, sum(hf)::bigint b_for, sum(ha)::bigint b_against from pv join (select vote_id, sum(n_for) hf, sum(n_against) ha from pv group by 1) using (vote_id) join counted_tag using (vote_id) join concept using (concept_id) where party_id = {_P} and pv.n_for + pv.n_against > 0 and not is_generic group by 1, 2 having count(*) >= 5 order by n_votes desc, concept_label, concept_id limit 50",
    "q41_party_votes": _paged("vote_id, v.vote_date::varchar vote_date, v.item_title, v.stage, \"position\", pv.n_for, pv.n_against, pv.n_abstain, pv.n_for + pv.n_against >= 3 and rice < 1 split", f"pv join vote v using (vote_id) where party_id = {_P}", "rice nulls last, ts desc nulls last, vote_id desc"),
    "q43_party_members": f"select member_id, member_name, sum(n_ballots)::bigint n_ballots, round(sum(n_ballots) / sum(eligible), 6) participation from could join member using (member_id) where last_party_id = {_P} and eligible > 0 group by 1, 2",
    "q44_vote": f"select vote_id, knesset_num, vote_date::varchar vote_date, item_title, decision, reading, accepted, vote_type, bill_id, n_for, n_against, n_abstain, has_ballots, stage from vote where vote_id = {_V}",
    "q45_vote_by_party": f"select party_id, party_name, color_index, sum(if(choice = 'for', 1, 0))::bigint n_for, sum(if(choice = 'against', 1, 0))::bigint n_against, sum(if(choice = 'abstain', 1, 0))::bigint n_abstain, sum(if(choice is null, 1, 0))::bigint n_absent from {_SERVING} join party using (party_id) group by all",
    "q46_vote_mks": f"select member_id, member_name, party_name, coalesce(choice, 'absent') choice from {_SERVING} s join member using (member_id) left join party using (party_id)",
    "q47_bill_path": f"select vote_id, vote_date::varchar vote_date, stage, decision, accepted, n_for, n_against from vote where vote_id in (select vote_id from link where bill_id in (select bill_id from link where vote_id = {_V}))",
    "q48_vote_concepts": f"select distinct concept_id, concept_label, is_generic from tag join concept using (concept_id) where bill_id in (select bill_id from link where vote_id = {_V})",
    "q49_vote_evidence": f"select concept_id, concept_label, bullet, is_primary from {_EVIDENCE} join concept using (concept_id) where bill_id in (select bill_id from link where vote_id = {_V})",
    "q50_votes": _paged("vote_id, vote_date::varchar vote_date, item_title, stage, n_for, n_against, n_abstain, accepted", f"vote where knesset_num = {_K} and stage = 'first' and item_title ilike '%חוק%'", "ts desc nulls last, vote_id desc"),
    "q51_votes_summary": f"select count(*) n, round(avg(accepted::int), 6) accepted_share, count(*) filter (where n_against >= 10) contested from vote where knesset_num = {_K} and stage = 'first' and item_title ilike '%חוק%'",
    "c01_laws_wide": "select year(first_vote_date)::int \"year\", count(*) filter (where passed) n_passed, count(*) filter (where not passed) n_other from bill where first_vote_date is not null group by 1",
    "c02_concepts_wide": "select \"year\", " + ", ".join(f"count(distinct if(rn = {i}, bill_id, null)) c{i}" for i in range(1, 6)) + " from (select year(first_vote_date)::int \"year\", rn, bill_id from (select concept_id, row_number() over (order by n_bills desc, concept_id) rn from concept where not is_generic order by rn limit 5) join tag using (concept_id) join bill using (bill_id) where first_vote_date is not null) group by 1",
    "c05_evidence_by_bill": f"select bill_id, list(bullet order by not coalesce(is_primary, false), bullet) bullets from {_EVIDENCE} where concept_id = {_CO} group by 1",
    "c06_concept_uncounted": f"select coalesce(sum(n) filter (where stage in ('reservation', 'second')), 0)::bigint n_contested_uncounted, coalesce((select count(distinct vote_id) from vote_bill join tag using (bill_id) where concept_id = {_CO} and stage in {_COUNTED} and n_against > 0), 0) = 0 all_consensus from (select stage, count(distinct vote_id) n from vote_bill join tag using (bill_id) where concept_id = {_CO} and n_against > 0 group by 1)",
    "c07_position_titles": f"select title, max({_DATE.format(c='start_date')}) latest from (select *, concat_ws(' - ', position_name, nullif(trim(ministry_name), '')) title from dim_governments where member_id = {_MINISTER}) group by 1 order by latest desc nulls last, title limit 8",
    "c08_served_in_term": f"select knesset_num, exists (from dim_governments g where g.member_id = s.member_id and {_DATE.format(c='start_date')} <= last_date and ({_DATE.format(c='finish_date')} is null or {_DATE.format(c='finish_date')} >= first_date)) in_government from svc s where member_id = {_MINISTER}",
    "c04_member_median": f"select round(median(round(n_ballots / eligible, 6)), 6) median_participation from could join member using (member_id) where knesset_num = {_K} and eligible > 0",
    "c11_coalition_seats": f"select coalesce(sum(if(x >= 0.5, n, 0)), 0)::bigint seats from (select last_party_id party_id, count(*) n from could where knesset_num = {_K} and eligible > 0 group by 1) join (select party_id, avg(is_coalition::int) x from pv where knesset_num = {_K} group by 1) using (party_id)",
    "c12_funnel_filled": f"select stage, coalesce(bills, 0) bills from (select unnest(['preliminary', 'first', 'third']) stage) left join (select stage, count(distinct bill_id) bills from vote_bill where knesset_num = {_K} group by 1) using (stage)",
}

_EXTRA = {
    "q15_mk_participation": f"peer as (select s.* from svc s join svc me on me.member_id = {_M} and me.knesset_num = s.knesset_num and me.last_party_id = s.last_party_id)",
    "q34_concepts_trend": "two as (select min(k) k1, max(k) k2, min_by(n, k) a1, max_by(n, k) a2 from (select knesset_num k, count(distinct bill_id) n from tag join bill using (bill_id) group by 1 having n >= 50 order by 1 desc limit 2) having count(*) = 2)",
}

def sql(name: str) -> str:
    base = BASE.rstrip()
    if name in _EXTRA:
        base += ",\n" + _EXTRA[name]
    return base + "\n" + _SELECTS[name]


_IN_TERM = f"knesset_num = {_K}"
_T = "(select topic_id from bill where topic_id is not null group by 1 order by count(*) desc, 1 limit 1)"
_ON_TOPIC = f"vote_id in (select vote_id from link join bill using (bill_id) where topic_id = {_T}) and n_against >= 10"
_MK_VOTES = "vote_id, bx.vote_date::varchar vote_date, v.item_title, bx.stage, choice, \"position\", " + _AGAINST + " against_party"
_MK_FROM = f"{_WITH_PARTY} join (select vote_id, ts, item_title from vote) v using (vote_id) where {_MY}"
_PARTY_VOTES = "vote_id, v.vote_date::varchar vote_date, v.item_title, v.stage, \"position\", pv.n_for, pv.n_against, pv.n_abstain, pv.n_for + pv.n_against >= 3 and rice < 1 split"
_VOTES = "vote_id, vote_date::varchar vote_date, item_title, stage, n_for, n_against, n_abstain, accepted"
_SELECTS |= {
    "q10_members_of_party": _SELECTS["q10_members"] + f" and last_party_id = {_P} and member_name ilike '%א%'",
    "q13_mk_kpi_term": _SELECTS["q13_mk_kpi"].replace(f"from could where member_id = {_M}", f"from could where {_IN_TERM} and member_id = {_M}").replace(f"where {_MY}", f"where {_IN_TERM} and {_MY}").replace(f"from svc where member_id = {_M}", f"from svc where {_IN_TERM} and member_id = {_M}"),
    "q14_mk_yearly_term": _SELECTS["q14_mk_yearly"].replace(f"where {_MY}", f"where {_IN_TERM} and {_MY}"),
    "q18_mk_votes_against": _paged(_MK_VOTES, f"{_MK_FROM} and {_AGAINST}", "v.ts desc, vote_id desc, ballot_id"),
    "q18_mk_votes_page2": _paged(_MK_VOTES, f"{_MK_FROM} and bx.{_IN_TERM}", "v.ts desc, vote_id desc, ballot_id", 2),
    "q19_mk_similar_free": _SELECTS["q19_mk_similar"].replace("(select vote_id from bloc)", "(select vote_id from bloc where not is_bloc_vote)").replace("count(*) >= 100", "count(*) >= 10"),
    "q28_concept_contested_few": _SELECTS["q28_concept_contested"].replace("n_against >= 10", "n_against >= 3"),
    "q32_concepts_generic": _SELECTS["q32_concepts_list"].replace("where not is_generic", "where is_generic and concept_label ilike '%ה%'"),
    "q39_party_kpi_term": _SELECTS["q39_party_kpi"].replace(f"where last_party_id = {_P}", f"where {_IN_TERM} and last_party_id = {_P}").replace(f"where party_id = {_P}", f"where pv.{_IN_TERM} and party_id = {_P}"),
    "q41_party_votes_split": _paged(_PARTY_VOTES, f"pv join vote v using (vote_id) where party_id = {_P} and pv.{_IN_TERM} and pv.n_for + pv.n_against >= 3 and rice < 1", "ts desc nulls last, vote_id desc"),
    "q41_party_votes_page2": _paged(_PARTY_VOTES, f"pv join vote v using (vote_id) where party_id = {_P}", "rice nulls last, ts desc nulls last, vote_id desc", 2),
    "q50_votes_contested": _paged(_VOTES, f"vote where {_IN_TERM} and {_ON_TOPIC}", "ts desc nulls last, vote_id desc"),
    "q50_votes_page2": _paged(_VOTES, f"vote where {_IN_TERM}", "ts desc nulls last, vote_id desc", 2),
    "q51_votes_contested": f"select count(*) n, round(avg(accepted::int), 6) accepted_share, count(*) filter (where n_against >= 10) contested from vote where {_IN_TERM} and {_ON_TOPIC}",
}
_TERMS = _SELECTS["q30_concept_party_terms"]
_SELECTS["c03_concept_terms_wide"] = f"""select knesset_num, '{{' || string_agg('"' || party_id || '":' || for_share::varchar, ',' order by party_id) || '}}' shares from ({_TERMS}) where (select count(distinct knesset_num) from ({_TERMS})) >= 2 group by 1"""

_GAPS = {
    "fact_votes": _VOTE_GAPS + " counter_total",
    "fact_ballots": "member_id source_faction_name",
    "dim_bills": "name status initiators proposal_type committee_name commencement_date summary publication_date previous_names",
}

ORACLE_SQL = {name: sql(name) for name in _SELECTS}
ORACLE_SQL["dq_report"] = report_sql(lambda table, key: _once(table, key, _GAPS[table]), _TS, _KEY)
