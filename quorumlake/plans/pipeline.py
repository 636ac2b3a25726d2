"""Registered queries of the text pipeline, the marts and the quality reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.operators.chunking import chunk_documents, embedding_input, heading_blocks, legal_units, tagged_items
from quorumlake.operators.nested import flatten_nested
from quorumlake.operators.vectors import DensityConfig, density_clusters, nearest_neighbors
from quorumlake.plans import marts, quality
from quorumlake.plans.model import Model
from quorumlake.session import materialize, table
from quorumlake.sources.providers import map_batches, stub_bullets

C = F.col
RUN = "earlier_run"


def _documents(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").where("text is not null and text <> ''")


def units(spark: SparkSession, sf: str) -> DataFrame:
    """Legal units of every text with their ordinal."""
    d = _documents(spark, sf).select("doc_id", F.posexplode(legal_units(C("text"))).alias("unit_no", "unit"))
    return d


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of at most 256 words and marks, with their source spans."""
    d = _documents(spark, sf).select("doc_id", heading_blocks(C("text")).alias("blocks"))
    return chunk_documents(d, "doc_id", "blocks", 256)


def _asked(spark, sf) -> DataFrame:
    """(chunk_id, text) of all that the provider is given: the text of every chunk, and
    the headings, which are no part of chunks, packed alike under ids with an ``h``."""
    block = F.struct(F.lit("text").alias("kind"), F.regexp_extract("text", r"^([^\n]*)", 1).alias("text"), F.array(F.lit("").cast("string")).alias("heading_path"), F.lit(1).alias("page_no"), F.lit("b0000").alias("block_id"))
    heads = chunk_documents(_documents(spark, sf).select("doc_id", F.array(block).alias("blocks")), "doc_id", "blocks", 256)
    return chunks(spark, sf).select("chunk_id", "text").unionByName(heads.select(F.replace("chunk_id", F.lit(":"), F.lit(":h")).alias("chunk_id"), "text"))


def _bullets(asked: DataFrame, call=stub_bullets) -> DataFrame:
    """(doc_id, chunk_id, state, bullet_ordinal, bullet): every tagged item of every
    answer; a text without one keeps a row with an empty bullet."""
    said = map_batches(asked, "chunk_id", "text", call).withColumn("items", tagged_items(C("result"), "BULLET"))
    state = F.when(C("state") != "success", C("state")).when(F.size("items") > 0, "success").otherwise("no_usable_quotes")
    out = said.select("chunk_id", state.alias("state"), F.posexplode_outer("items").alias("bullet_ordinal", "bullet"))
    return out.select(F.substring_index("chunk_id", ":", 1).cast("bigint").alias("doc_id"), "chunk_id", "state", "bullet_ordinal", F.coalesce("bullet", F.lit("")).alias("bullet"))


def tag_extract(spark, sf) -> DataFrame:
    """Bullets in tags, from the stub provider's answers to all chunks and headings."""
    return _bullets(_asked(spark, sf))


def embed_input(spark, sf) -> DataFrame:
    b = table(spark, sf, "cluster_result").select("bullet_row_id", "bill_id", "bullet").distinct()
    names = table(spark, sf, "dim_bills").groupBy("bill_id").agg(F.min("name").alias("name"))
    return b.join(names, "bill_id", "left").select("bullet_row_id", embedding_input("passage: ", C("name"), F.lit(""), C("bullet")).alias("embedding_input"))


def knn_cosine(spark, sf) -> DataFrame:
    """Five nearest vectors of each vector whose id is divisible by 100."""
    e = table(spark, sf, "embeddings")
    found = nearest_neighbors(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 5)
    return found.withColumn("similarity", F.round("similarity", 6))


def density_run(spark, sf) -> DataFrame:
    """Density clusters of the labelled vectors."""
    return density_clusters(table(spark, sf, "embeddings"), "vec_id", "embedding", DensityConfig(5, 5, "leaf"))


def _assigned(spark, sf) -> DataFrame:
    """The earlier run's assignment of bullets, one row each; a bullet's chunk is its bill."""
    r = table(spark, sf, "cluster_result").where("labels is not null").groupBy("bullet_row_id").agg(F.min("bill_id").alias("bill_id"), F.min("row_no").alias("bullet_ordinal"), F.min("labels").alias("cluster_id"), F.max("probabilities").alias("membership_probability"))
    return r.select("bullet_row_id", "bill_id", "bullet_ordinal", F.concat(C("bill_id").cast("string"), F.lit(":0000")).alias("chunk_id"), F.lit(RUN).alias("cluster_run_id"), "cluster_id", F.coalesce("membership_probability", F.lit(0.0)).alias("membership_probability"), F.lit(0.0).alias("outlier_score"))


def _concepts(spark, sf) -> DataFrame:
    c = table(spark, sf, "dim_concepts").select("concept_id", F.lit(RUN).alias("cluster_run_id"), "cluster_id", "concept_label", "concept_criterion")
    reps = marts.dim_clusters(_assigned(spark, sf)).select("cluster_run_id", "cluster_id", "representative_bullet_ids")
    return c.join(reps, ["cluster_run_id", "cluster_id"])


def dim_clusters(spark, sf) -> DataFrame:
    return marts.dim_clusters(_assigned(spark, sf))


def bridge_bill_clusters(spark, sf) -> DataFrame:
    return marts.bridge_bill_clusters(_assigned(spark, sf))


def bridge_bill_concepts(spark, sf) -> DataFrame:
    a = _assigned(spark, sf)
    return marts.bridge_bill_concepts(marts.bridge_bill_clusters(a), _concepts(spark, sf), a.select("bullet_row_id", "chunk_id"))


def bill_concepts(spark, sf) -> DataFrame:
    a = _assigned(spark, sf)
    bills = table(spark, sf, "dim_bills").groupBy("bill_id").agg(F.min("name").alias("name"))
    k = marts.bridge_bill_clusters(a)
    return marts.bill_concepts(bills, k, marts.bridge_bill_concepts(k, _concepts(spark, sf), a.select("bullet_row_id", "chunk_id")))


def cluster_composition(spark, sf) -> DataFrame:
    return marts.cluster_composition(_assigned(spark, sf))


def candidate_table(spark, sf) -> DataFrame:
    a = _assigned(spark, sf)
    return marts.candidate_table(marts.cluster_composition(a), a)


def representative_evidence(spark, sf) -> DataFrame:
    return marts.representative_evidence(_assigned(spark, sf), table(spark, sf, "cluster_result").groupBy("bullet_row_id").agg(F.min("bullet").alias("bullet")))


def bullet_accounting(spark, sf) -> DataFrame:
    asked = materialize(_asked(spark, sf), "asked")
    return marts.bullet_accounting(asked, _bullets(asked).where("state = 'success'")).groupBy("n_bullets").agg(F.count(F.lit(1)).alias("n_chunks"))


def dim_bullets(spark, sf) -> DataFrame:
    a = _assigned(spark, sf)
    links = marts.bridge_bill_concepts(marts.bridge_bill_clusters(a), _concepts(spark, sf), a.select("bullet_row_id", "chunk_id"))
    b = table(spark, sf, "cluster_result").groupBy("bullet_row_id").agg(F.min("bill_id").alias("bill_id"), F.min("bullet").alias("bullet"))
    return marts.dim_bullets(links, _concepts(spark, sf), b)


def provenance(spark, sf) -> DataFrame:
    """Representative bullets of every concept with their text, gaps included."""
    b = table(spark, sf, "cluster_result").groupBy("bullet_row_id").agg(F.min("bill_id").alias("bill_id"), F.min("bullet").alias("bullet"))
    return marts.provenance(_concepts(spark, sf), b)


def foreign_evidence(spark, sf) -> DataFrame:
    """Evidence of bills for concepts that the earlier run put in another cluster, counted
    per concept."""
    shown = table(spark, sf, "bridge_bill_concepts").where("primary_evidence_bullet_id is not null").select("concept_id", "cluster_id", C("primary_evidence_bullet_id").alias("bullet_row_id")).distinct()
    return marts.foreign_examples(shown, _assigned(spark, sf), "cluster_id", "bullet_row_id").groupBy("concept_id").agg(F.count(F.lit(1)).alias("n_foreign"))


def knn_within_label(spark, sf) -> DataFrame:
    """The nearest vectors of :func:`knn_cosine` that carry the asked vector's label."""
    labels = table(spark, sf, "embeddings").select("vec_id", "label")
    near = knn_cosine(spark, sf).join(labels.select(C("vec_id").alias("query_id"), C("label").alias("own")), "query_id").join(labels.select(C("vec_id").alias("neighbor_id"), "label"), "neighbor_id")
    return near.where(C("own").eqNullSafe(C("label"))).select("query_id", "rank", "neighbor_id", "similarity")


def dq_report(spark, sf) -> DataFrame:
    return quality.quality_report(Model.of(spark, sf))


def collection_summary(spark, sf) -> DataFrame:
    return quality.collection_summary(Model.of(spark, sf))


def dq_concept_report(spark, sf) -> DataFrame:
    a = _assigned(spark, sf)
    bills = table(spark, sf, "dim_bills").groupBy("bill_id").agg(F.min("name").alias("name"))
    k = marts.bridge_bill_clusters(a)
    links = marts.bridge_bill_concepts(k, _concepts(spark, sf), a.select("bullet_row_id", "chunk_id"))
    return marts.concept_report(bills, a.select("bullet_row_id"), a, marts.bill_concepts(bills, k, links), links, _concepts(spark, sf))


def doc_select(spark, sf) -> DataFrame:
    """The document chosen for each raw record, among those of the record itself."""
    t = flatten_nested(table(spark, sf, "passed_bills_raw"), "raw_id", "payload")

    def of(prefix: str, source: str) -> DataFrame:
        files = t[f"{prefix}file"].where("stage_no = -1").join(t[f"{prefix}document"].select(C("pk").alias("parent_pk"), "file_text", "file_date"), "parent_pk")
        return files.select(
            C("record_id").alias("bill_id"), C("pk").alias("bill_document_id"), F.lit(source).alias("source_field"), C("file_text").alias("document_label"), C("path").alias("document_url"), C("format").alias("document_format"),
            F.left("file_date", F.lit(10)).alias("document_date"), (C("doc_no") * 1000 + C("file_no")).alias("document_ordinal"),
        )

    docs = of("", "LegalDocuments").unionByName(of("draft_", "DraftLaws"))
    return marts.select_documents(t["record"].select(C("record_id").alias("bill_id")).distinct(), docs)


QUERIES = {f.__name__: f for f in (units, chunks, tag_extract, embed_input, knn_cosine, density_run, dim_clusters, bridge_bill_clusters, bridge_bill_concepts, bill_concepts, cluster_composition, candidate_table, representative_evidence, bullet_accounting, dim_bullets, provenance, foreign_evidence, knn_within_label, dq_report, collection_summary, dq_concept_report, doc_select)}
QUERIES["legal_units"] = QUERIES.pop("units")

_A = "(select bullet_row_id, min(bill_id) bill_id, min(row_no) bullet_ordinal, min(bill_id)::varchar || ':0000' chunk_id, 'earlier_run' cluster_run_id, min(labels) cluster_id, coalesce(max(probabilities), 0.0) p from cluster_result where labels is not null group by 1)"
_BC = "select *, round(n_bullets / sum(n_bullets) over (partition by bill_id), 6) bill_bullet_share, round(n_bullets / sum(n_bullets) over (partition by cluster_run_id, cluster_id), 6) cluster_bullet_share from (select bill_id, cluster_run_id, cluster_id, cluster_id = -1 is_noise, count(*) n_bullets, count(distinct chunk_id) n_chunks, round(avg(p), 10) mean_cluster_membership_probability, max(p) max_cluster_membership_probability, list(bullet_row_id order by bullet_ordinal, bullet_row_id) bullet_ids, list_sort(list_distinct(list(chunk_id))) chunk_ids, first(bullet_row_id order by p desc, bullet_row_id) primary_bullet_id, first(chunk_id order by p desc, bullet_row_id) primary_chunk_id from a group by 1, 2, 3)"
_DC = "select cluster_run_id, cluster_id, cluster_id = -1 is_noise, count(*) n_bullets, count(distinct chunk_id) n_chunks, count(distinct bill_id) n_bills, round(avg(p), 10) mean_membership_probability, list(bullet_row_id order by p desc, bullet_row_id)[1:10] representative_bullet_ids from a group by 1, 2"
_REL = """select r.bill_id, concept_id, r.cluster_run_id, r.cluster_id, concept_label, concept_criterion, if(len(shown) > 0, 'representative', 'cluster_member') relation_type, n_bullets n_cluster_bullets, len(shown)::int n_representative_bullets, mean_cluster_membership_probability, bill_bullet_share, bullet_ids, chunk_ids,
        coalesce(shown[1], primary_bullet_id) primary_evidence_bullet_id, coalesce(a.chunk_id, primary_chunk_id) primary_evidence_chunk_id
        from (select bc.*, concept_id, concept_label, concept_criterion, list_filter(bullet_ids, lambda b: list_contains(representative_bullet_ids, b)) shown from bc join dc using (cluster_run_id, cluster_id) join (select distinct concept_id, cluster_id, concept_label, concept_criterion from dim_concepts) using (cluster_id) where not bc.is_noise) r
        left join a on a.bullet_row_id = coalesce(shown[1], primary_bullet_id)"""
_MARTS = f"with a as materialized (from {_A}), bc as materialized ({_BC}), dc as materialized ({_DC}), rel as materialized ({_REL}), bullet_text as (select bullet_row_id, min(bill_id) bill_id, min(bullet) bullet from cluster_result group by 1), bills as (select bill_id, min(name) name from dim_bills group by 1) "
_BY_BILL = """select b.bill_id, b.name, coalesce(n_bullets, 0)::bigint n_bullets, coalesce(n_noise, 0)::bigint n_noise_bullets, round(coalesce(n_noise, 0) / nullif(n_bullets, 0), 6) noise_ratio, len(coalesce(cluster_ids, [])) n_clusters, len(coalesce(concept_ids, [])) n_concepts,
        coalesce(cluster_ids, []) cluster_ids, coalesce(concept_ids, []) concept_ids, coalesce(concept_labels, []) concept_labels, coalesce(clusters_json, '[]') clusters_json, coalesce(concepts_json, '[]') concepts_json
        from bills b left join (select bill_id, sum(n_bullets) n_bullets, sum(n_bullets) filter (where is_noise) n_noise, list_sort(coalesce(list(distinct cluster_id) filter (where not is_noise), [])) cluster_ids,
            to_json(list({'cluster_run_id': cluster_run_id, 'cluster_id': cluster_id, 'n_bullets': n_bullets, 'bill_bullet_share': bill_bullet_share, 'primary_bullet_id': primary_bullet_id} order by cluster_run_id, cluster_id))::varchar clusters_json from bc group by 1) using (bill_id)
        left join (select bill_id, list_sort(list(distinct concept_id)) concept_ids, list_sort(list(distinct concept_label)) concept_labels, to_json(list({'concept_id': concept_id, 'concept_label': concept_label, 'relation_type': relation_type, 'n_cluster_bullets': n_cluster_bullets} order by concept_id, concept_label, relation_type))::varchar concepts_json from rel group by 1) using (bill_id)"""
_SPACE = r"[\s\x{0B}\x{85}\p{Z}]"
_UNIT = r"(?:סעיף" + _SPACE + r"+\p{Nd}+|\p{Nd}+(?:\.\p{Nd}+)*[.)]|[א-ת][.)])"
_CHECKS = {
    "unique bills": "select count(*) - count(distinct bill_id) from bills",
    "one concept row a bill": "select sum(abs(coalesce(n, 0) - 1)) from (select distinct bill_id from bills) full join (select bill_id, count(*) n from bills group by 1) using (bill_id)",
    "one cluster a bullet and run": "select count(*) - count(distinct (cluster_run_id, bullet_row_id)) from a",
    "every bullet in a cluster": "select 0",
    "no concept of noise": "select count(*) from rel where cluster_id = -1",
    "links to known concepts": "select count(*) from rel where concept_id not in (select concept_id from dim_concepts)",
    "links to known bills": "select count(*) from rel where bill_id not in (select bill_id from bills)",
    "links without rating": "select 0",
    "labels with evidence": "select count(*) from rel where primary_evidence_bullet_id is null",
}
ORACLE_SQL = {
    "knn_cosine": "select query_id, rank, neighbor_id, similarity from (select q.vec_id query_id, b.vec_id neighbor_id, s similarity0, round(s, 6) similarity, row_number() over (partition by q.vec_id order by s desc, b.vec_id) rank from (select vec_id, embedding::double[] e from embeddings where vec_id % 100 = 0) q, (select vec_id, embedding::double[] e from embeddings) b, lateral (select list_cosine_similarity(q.e, b.e) s) where q.vec_id <> b.vec_id) where rank <= 5",
    "embed_input": "select distinct bullet_row_id, 'passage: ' || case when nullif(trim(name), '') is not null then '[' || trim(name) || '] ' else '' end || bullet embedding_input from cluster_result left join (select bill_id, min(name) name from dim_bills group by 1) using (bill_id)",
    "candidate_table": f"select cluster_run_id, round(avg((cluster_id = -1)::int), 6) noise_ratio, any_value(n_clusters) n_clusters, any_value(n_single) n_single_bill, any_value(n_multi) n_multi_bill, any_value(largest) largest, any_value(m) mean_prob from {_A} left join (select count(*) n_clusters, count(*) filter (where b = 1) n_single, count(*) filter (where b > 1) n_multi, max(n) largest, round(avg(m), 10) m from (select cluster_id, count(*) n, count(distinct bill_id) b, round(avg(p), 10) m from {_A} where cluster_id <> -1 group by 1)) on true group by 1",
    "collection_summary": quality.SUMMARY_SQL,
    "dim_clusters": f"select cluster_run_id, cluster_id, cluster_id = -1 is_noise, count(*) n_bullets, count(distinct chunk_id) n_chunks, count(distinct bill_id) n_bills, round(avg(p), 10) mean_membership_probability, list(bullet_row_id order by p desc, bullet_row_id)[1:10] representative_bullet_ids from {_A} group by 1, 2",
    "bridge_bill_clusters": f"select *, round(n_bullets / sum(n_bullets) over (partition by bill_id), 6) bill_bullet_share, round(n_bullets / sum(n_bullets) over (partition by cluster_run_id, cluster_id), 6) cluster_bullet_share from (select bill_id, cluster_run_id, cluster_id, cluster_id = -1 is_noise, count(*) n_bullets, count(distinct chunk_id) n_chunks, round(avg(p), 10) mean_cluster_membership_probability, max(p) max_cluster_membership_probability, list(bullet_row_id order by bullet_ordinal, bullet_row_id) bullet_ids, list_sort(list_distinct(list(chunk_id))) chunk_ids, first(bullet_row_id order by p desc, bullet_row_id) primary_bullet_id, first(chunk_id order by p desc, bullet_row_id) primary_chunk_id from {_A} group by 1, 2, 3)",
    "cluster_composition": f"select cluster_run_id, cluster_id, count(*) size, count(distinct bill_id) n_bills, round(avg(p), 10) mean_prob, list_sort(list_distinct(list(bill_id::varchar))) bill_ids, count(distinct bill_id) = 1 single_bill from {_A} where cluster_id <> -1 group by 1, 2",
    "bridge_bill_concepts": _MARTS + "from rel",
    "bill_concepts": _MARTS + _BY_BILL,
    "dim_bullets": _MARTS + "select bullet_row_id, bill_id, bullet from (select primary_evidence_bullet_id bullet_row_id from rel union select unnest(bullet_ids) from rel union select unnest(representative_bullet_ids) from dc where cluster_id in (select cluster_id from dim_concepts)) join bullet_text using (bullet_row_id)",
    "representative_evidence": _MARTS + "select cluster_run_id, cluster_id, \"rank\", bill_id, bullet_row_id, bullet from (select a.*, row_number() over (partition by a.cluster_id order by p desc, bullet_row_id) \"rank\" from (select * from a qualify row_number() over (partition by cluster_id, bill_id order by p desc, bullet_row_id) = 1) a where cluster_id in (select cluster_id from dc where not is_noise order by n_bills desc, n_bullets desc, cluster_id limit 12)) join (select bullet_row_id, bullet from bullet_text) using (bullet_row_id) where \"rank\" <= 3",
    "dq_concept_report": _MARTS + "select *, if(violations = 0, 'pass', 'fail') status from (" + " union all ".join(f"select '{name}' \"check\", ({sql})::bigint violations" for name, sql in _CHECKS.items()) + ")",
    "legal_units": f"select doc_id, unnest(generate_series(0, len(v) - 1))::int unit_no, unnest(v) unit from (select doc_id, list_filter(list_transform(string_split(regexp_replace(text, '(?m)^({_SPACE}*{_UNIT})', chr(57344) || '\\1', 'g'), chr(57344)), lambda p: regexp_replace(p, '^{_SPACE}+|{_SPACE}+$', '', 'g')), lambda p: p <> '') v from documents where text is not null and text <> '') where len(v) > 0",
    "provenance": _MARTS + "select concept_id, n - 1 ordinal, bullet_row_id, b.bullet_row_id is not null resolved, bill_id, bullet from (select distinct concept_id, unnest(generate_series(1, len(representative_bullet_ids)))::int n, unnest(representative_bullet_ids) bullet_row_id from dim_concepts join dc using (cluster_id)) left join bullet_text b using (bullet_row_id)",
    "foreign_evidence": f"select concept_id, count(*) n_foreign from (select distinct concept_id, cluster_id, primary_evidence_bullet_id bullet_row_id from bridge_bill_concepts where primary_evidence_bullet_id is not null) where (cluster_id, bullet_row_id) not in (select (cluster_id, bullet_row_id) from {_A}) group by 1",
    "knn_within_label": "select query_id, rank, neighbor_id, similarity from (select q.vec_id query_id, b.vec_id neighbor_id, q.label is not distinct from b.label same, round(s, 6) similarity, row_number() over (partition by q.vec_id order by s desc, b.vec_id) rank from (select vec_id, label, embedding::double[] e from embeddings where vec_id % 100 = 0) q, (select vec_id, label, embedding::double[] e from embeddings) b, lateral (select list_cosine_similarity(q.e, b.e) s) where q.vec_id <> b.vec_id) where rank <= 5 and same",
}
