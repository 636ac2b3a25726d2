"""Deeply nested records to flat, linked tables in a single pass.

A depth-first visitor walks each payload once and emits (tag, key, parent key,
payload) for everything it meets. The emission is written partitioned by tag,
and each table is read from its partition under its own schema, so a reader of
one table touches no other.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.session import materialize

EMISSION = "tag string, record_id bigint, pk string, parent_pk string, payload string"

#: Schemas of the tables, by tag.
SCHEMAS = {
    "record": "bill_key string, name string, status string, knesset_num string, proposal_type string, committee_name string",
    "stage": "stage_no bigint, stage_id string, title string",
    "document": "stage_no bigint, doc_no bigint, n_files bigint, file_text string, file_date string",
    "file": "stage_no bigint, doc_no bigint, file_no bigint, path string, format string, bytes bigint",
}
SCHEMAS |= {f"draft_{tag}": SCHEMAS[tag] for tag in ("document", "file")}

_DOCUMENT_KEYS = {"FileText", "FileDate", "FilePath", "Extra"}
_STAGE_KEYS = {"StageId", "StepTitle", "LegalDocuments", "Sessions"}
_FILE_KEYS = {"Path", "Format", "Bytes", "Signatures"}

def parse_payload(text: str | None):
    """The JSON value in a payload, without stray characters or wrapping around it.

    A byte order mark, blanks, control characters or words before and after the
    value, a value that is held as text inside the value, and a list of one
    around the object are passed over, however often it is wrapped. Null and damaged
    payloads, and those nested beyond what the parser can hold, give None.
    """
    while text is not None:  # each turn takes a pair of quotes off
        text = text.strip("﻿​‎‏\x00 \t\r\n")
        try:
            value = json.loads(text, strict=False)
        except (ValueError, RecursionError):
            begin = re.search(r"[{\[]", text)
            if not begin:
                return None
            try:
                value, end = json.JSONDecoder(strict=False).raw_decode(text, begin.start())
            except (ValueError, RecursionError):
                return None
            if re.search(r"[{}\[\]]", text[end:]):
                return None
        if not isinstance(value, str):
            return value
        text = value
    return None


def _held(value, own: set[str]):
    """What a collection holds, whatever shape or wrapper it is kept in: a list."""
    while True:  # each turn takes a wrapper off
        if isinstance(value, str):
            inner = value.strip("﻿​\x00 \t\r\n")
            if inner[:1] not in ("[", "{", '"'):
                break
            try:
                value = json.loads(inner, strict=False)
            except (ValueError, RecursionError):
                return []
            continue
        if isinstance(value, dict) and len(value) == 1 and not own & value.keys():
            only = next(iter(value.values()))
            if isinstance(only, (list, dict, str)):
                value = only
                continue
        break
    if value is None:
        return []
    return value if isinstance(value, list) else [value]


def _object(value, own: set[str]):
    """A single object, out of text or a wrapper; anything else is None."""
    if isinstance(value, dict):
        return value
    if isinstance(value, (str, list)):
        held = _held(value, own)
        return next((x for x in held if isinstance(x, dict)), None)
    return None


def _text(value) -> str | None:
    return None if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def visit(record_id: int, payload: str | None) -> Iterator[tuple]:
    """Depth-first emission of one record: record, stages, documents, files; those of
    DraftLaws under tags of their own."""
    root = parse_payload(payload)
    if isinstance(root, list):
        root = next((x for x in root if isinstance(x, dict)), None)
    if not isinstance(root, dict):
        return
    if not {"general", "sessionAndDocs"} & root.keys() and len(root) == 1:
        root = _object(next(iter(root.values())), {"general", "sessionAndDocs"}) or {}
    general = _object(root.get("general"), {"Id"}) or {}
    pk = str(record_id)
    body = {"bill_key": _text(general.get("Id")), "name": _text(general.get("Name")), "status": _text(general.get("Status")), "knesset_num": _text(general.get("Knesset")), "proposal_type": _text(general.get("SubType")), "committee_name": _text(general.get("CommitteeName"))}
    yield "record", record_id, pk, None, json.dumps(body, ensure_ascii=False)
    docs = _object(root.get("sessionAndDocs"), {"LegalDocuments", "Stages", "DraftLaws"})
    if not docs:
        return
    yield from _documents(record_id, pk, -1, docs.get("LegalDocuments"))
    yield from _documents(record_id, pk, -1, docs.get("DraftLaws"), "draft_")
    for no, stage in enumerate(_held(docs.get("Stages"), _STAGE_KEYS)):
        stage = _object(stage, _STAGE_KEYS)
        if not stage:
            continue
        key = f"{pk}/s{no}"
        yield "stage", record_id, key, pk, json.dumps({"stage_no": no, "stage_id": _text(stage.get("StageId")), "title": _text(stage.get("StepTitle"))}, ensure_ascii=False)
        yield from _documents(record_id, key, no, stage.get("LegalDocuments"))


def _documents(record_id: int, parent: str, stage_no: int, held, prefix: str = "") -> Iterator[tuple]:
    for no, doc in enumerate(_held(held, _DOCUMENT_KEYS)):
        doc = _object(doc, _DOCUMENT_KEYS)
        if not doc:
            continue
        key = f"{parent}/{prefix}d{no}"
        files = []
        for file_no, file in enumerate(_held(doc.get("FilePath"), _FILE_KEYS)):
            if isinstance(file, dict):
                path, form, size = file.get("Path"), file.get("Format"), file.get("Bytes")
            else:
                path, form, size = file, None, None
            if isinstance(path, str) and path.strip():
                size = size if isinstance(size, int) and not isinstance(size, bool) and abs(size) < 2**63 else None
                files.append({"stage_no": stage_no, "doc_no": no, "file_no": file_no, "path": path, "format": _text(form), "bytes": size})
        yield f"{prefix}document", record_id, key, parent, json.dumps({"stage_no": stage_no, "doc_no": no, "n_files": len(files), "file_text": _text(doc.get("FileText")), "file_date": _text(doc.get("FileDate"))}, ensure_ascii=False)
        for f in files:
            yield f"{prefix}file", record_id, f"{key}/f{f['file_no']}", key, json.dumps(f, ensure_ascii=False)


def emit_tagged(df: DataFrame, id_column: str, payload_column: str) -> DataFrame:
    """The tagged emission of every distinct (id, payload); null ids take no part."""

    def run(batches):
        import pyarrow as pa

        def some():  # a few payloads at a time
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    ids, texts = (c.slice(at, 64).to_pylist() for c in batch.columns)
                    yield [row for rid, text in zip(ids, texts) for row in visit(rid, text)]

        for out in some():
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.string())], names=["tag", "record_id", "pk", "parent_pk", "payload"])

    rows = df.select(F.col(id_column).cast("bigint").alias("record_id"), F.col(payload_column).alias("payload")).where("record_id is not null and payload is not null")
    return rows.mapInArrow(run, EMISSION).distinct()


def flatten_nested(df: DataFrame, id_column: str, payload_column: str) -> dict[str, DataFrame]:
    """Related flat tables by tag, each with ``record_id``, ``pk`` and ``parent_pk``.

    The emission is written once, partitioned by tag. Payloads that are null,
    damaged or of another shape give no rows; a record that is delivered twice
    under one id gives its rows once; two different payloads under one id give
    the rows of both. Other columns of ``df`` are ignored.
    """
    emission = materialize(emit_tagged(df, id_column, payload_column), "nested", partition_by=["tag"])
    return {
        tag: emission.where(F.col("tag") == tag).select("record_id", "pk", "parent_pk", F.from_json("payload", schema).alias("x")).select("record_id", "pk", "parent_pk", "x.*")
        for tag, schema in SCHEMAS.items()
    }
