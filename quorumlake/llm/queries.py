"""The queries of problems 1, 4, 8, 9 and 10 over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.llm import canonical, clusters, lookalike, packing, tokens
from quorumlake.session import materialize, table

CONTAINER_TOKENS = 2048

# Keys of the Hebrew keyboard under the Latin ones, as they occur in the records
# (fixed values; some layouts exchange the letters of s and d, which the edit
# distance repairs).
HEBREW = canonical.Script(
    keys=("ertyuiopasdfghjklzxcvbnm,.;'/wq", "קראטוןםפשגדכעיחלךזסבהנמצתץף,.'/"),
    fold=("ךםןףץ", "כמנפצ"),
    doubled="ו",
    particles="והלב",
)
#: Hebrew words around committee names (fixed values).
COMMITTEES = canonical.ListProfile(
    generic=("ועדת", "ועדה", "הוועדה", "ועד'", "הועד'", "ו'", "הוו'", "וו'", "ו", "תת", "לעניין", "לענייני", "לענין", "בעניין", "לנושא", "בנושא", "נושא", "עניין", "מס'", "מס", "מספר", "של", "הכנסת"),
    marked=("המשותפת", "המיוחדת", "המשנה"),
    asides=(r"[(\[](לשעבר|ישיבה מיוחדת|זמנית)[)\]]", r",\s*מושב\s+\S+$", r"\s[-–]\s*בראשות\s.*$", r"\s(של|ב)\s*ה?כנסת$"),
)
#: Hebrew words around faction names (fixed values).
FACTIONS = canonical.ListProfile(
    generic=("סיעת", "סיעה", "הסיעה", "ס'", "מפלגת", "מפלגה", "תנועת", "תנועה", "התנועה", "רשימת", "רשימה", "הרשימה"),
    asides=(r"[(\[](סיעה|בפיצול|לשעבר)[)\]]", r",\s*(אופוזיציה|קואליציה)$", r"\s[-–]\s*רשימה$", r"\sב?כנסת$"),
)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Freely typed faction and committee names with the entry each means."""
    return canonical.map_records(
        canonical.Field("faction_name", table(spark, sf, "bridge_member_factions"), "member_id", "faction_name", table(spark, sf, "faction_lineage"), "faction_name", FACTIONS),
        canonical.Field("committee_name", table(spark, sf, "dim_bills"), "bill_id", "committee_name", table(spark, sf, "committee_topics"), "committee_name", COMMITTEES),
        script=HEBREW,
    )


def p1_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    """Report of values that mean no entry: (field_name, raw_value, n_records)."""
    return p1_found(spark, sf).where("canonical_value = ''").groupBy("field_name", "raw_value").agg(F.count(F.lit(1)).alias("n_records"))


def _clusters(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.similarity_clusters(table(spark, sf, "cluster_result"), "row_no", "embeddings", dims=48)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Members of each group of statements except the first."""
    return _clusters(spark, sf).where("id <> first_id").select(F.col("first_id").alias("first_row_no"), F.col("id").alias("row_no"))


def p4_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Each group's size and the members of its densest cell."""
    return clusters.describe_clusters(_clusters(spark, sf)).select(F.col("first_id").alias("first_row_no"), "size", "dense_cell_size", F.col("typical_ids").alias("typical_row_nos"))


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode_corpus(table(spark, sf, "documents"), "doc_id", "text")


def p9_containers(spark: SparkSession, sf: str) -> DataFrame:
    """Container and order of each document: (container, slot, doc_id, piece, first_token, n_tokens, container_tokens)."""
    sizes = materialize(tokens.count_tokens(table(spark, sf, "documents"), "doc_id", "text"), "sizes")
    return packing.pack_items(sizes, "doc_id", "n_tokens", CONTAINER_TOKENS).withColumnRenamed("item_id", "doc_id")


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of documents that look the same and are stored differently."""
    return lookalike.lookalike_pairs(table(spark, sf, "documents"), "doc_id", "text").select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p10_forms(spark: SparkSession, sf: str) -> DataFrame:
    """The consistent form of every text."""
    return lookalike.canonical_texts(table(spark, sf, "documents"), "doc_id", "text")


QUERIES = {
    "p1_found": p1_found,
    "p1_unmatched": p1_unmatched,
    "p4_found": p4_found,
    "p4_profile": p4_profile,
    "p8_ids": p8_ids,
    "p9_containers": p9_containers,
    "p10_found": p10_found,
    "p10_forms": p10_forms,
}

#: None of these has an SQL equivalent that would be the same computation; the tests
#: hold them against brute force, an exact round trip or another implementation.
ORACLE_SQL: dict[str, str] = {}
