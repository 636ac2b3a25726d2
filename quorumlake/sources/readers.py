"""Sources: lookups, shaped JSON, binaries by content, versions of inputs."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Schemas of the curated lookups (header row, empty text is null).
LOOKUPS = {
    "parties": "party_id string, party_name string, color_index int, note string",
    "faction_lineage": "faction_name string, knesset_num int, party_id string, note string",
    "coalition_membership": "party_id string, knesset_num int, start date, end date, kind string, note string",
    "committee_topics": "committee_name string, topic_id string, note string",
    "topics": "topic_id string, topic_name string",
    "member_name_aliases": "alias string, member_id bigint",
    "mk_photos": "member_id bigint, photo_url string",
}


def read_lookup(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A curated CSV under its declared schema; nothing is inferred."""
    return spark.read.schema(LOOKUPS[name]).option("header", True).option("nullValue", "").csv(f"{path}/{name}.csv")


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of DataSet-shaped JSON files: ``{"Tables": {name: [rows]}}``, the same with
    ``tables``, one such object without the outer name, or a plain list of rows."""
    text = spark.read.option("wholetext", True).text(path).select(F.col("value").alias("body"))
    return records_of(text, "body", schema)


def records_of(df: DataFrame, column: str, schema: str) -> DataFrame:
    """The rows in a column of DataSet-shaped JSON."""
    rows = f"array<struct<{', '.join(': '.join(x.split(' ', 1)) for x in map(str.strip, schema.split(',')))}>>"
    body = F.col(column)
    inner = F.coalesce(F.get_json_object(body, "$.Tables"), F.get_json_object(body, "$.tables"), body)
    tables = F.from_json(inner, f"map<string, {rows}>")
    many = F.flatten(F.filter(F.map_values(tables), lambda t: t.isNotNull()))
    plain = F.from_json(inner, rows)
    return df.select(F.inline(F.when(inner.rlike(r"^\s*\["), plain).otherwise(many)))


def first_match(items: Column, test: Callable[[Column], Column], field: str) -> Column:
    """``field`` of the first element that passes, null for none."""
    return F.get(F.filter(items, test), F.lit(0))[field]


def explode_allowed(df: DataFrame, keep: list[str], fields: list[str]) -> DataFrame:
    """Elements of several array fields in one table: source field, ordinal, the element
    as JSON and a hash that names it."""
    out = None
    for f in fields:
        part = df.select(*keep, F.lit(f).alias("source_field"), F.posexplode(f).alias("ordinal", "item")).select(*keep, "source_field", "ordinal", F.to_json("item").alias("raw_json"))
        out = part if out is None else out.unionByName(part)
    key = F.substring(F.sha2(F.concat_ws("|", *keep, "source_field", F.col("ordinal").cast("string"), "raw_json"), 256), 1, 24)
    return out.withColumn("item_id", key)


def content_kind(content: Column) -> Column:
    """Kind of a binary by its first bytes: pdf, zip, ole, rtf, or null."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head.startswith("25504446"), "pdf").when(head.startswith("504B0304"), "zip").when(head.startswith("D0CF11E0"), "ole").when(head.startswith("7B5C727466"), "rtf")


def is_word_archive(content: Column) -> Column:
    """Whether a zip archive holds a word-processor document (its entry name is in clear)."""
    return F.hex(content).contains("word/document.xml".encode().hex().upper())


def manifest(spark: SparkSession, paths: list[str], *texts: str) -> str:
    """Version of a set of input files and of the texts (SQL, say) that work on them: 16
    hexadecimal digits over names and contents. Files are hashed where they lie."""
    files = spark.read.format("binaryFile").load(paths).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("hash"))
    held = files.agg(F.to_json(F.array_sort(F.collect_list(F.struct("name", "hash")))).alias("x")).head()[0]
    return hashlib.sha256("\x1f".join([held, *texts]).encode()).hexdigest()[:16]


def hyperlink_of(formula: Column) -> Column:
    """Address in a spreadsheet hyperlink formula, null if there is none."""
    return F.nullif(F.regexp_extract(formula, r'(https?://[^"]+)', 1), F.lit(""))
