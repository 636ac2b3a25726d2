"""One consistent form for texts that look the same.

A quick check (a table by code point) finds the characters that may be
unstable: those that the canonical form changes, and marks that combine with what
stands before them. Only the segments around them, with their starter as boundary
context, are normalised; the canonical segments are spliced into the unchanged
text. A text without unstable characters is returned as it is.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters and signs of one shape, beyond what Unicode's own decompositions give.
# Each character on the left is drawn like the one at the same place
# on the right.
SAME_SHAPE = (
    # Cyrillic drawn like Latin
    ("АВЕКМНОРСТУХЅІЈԌԚԜ", "ABEKMHOPCTYXSIJGQW"),
    ("аеорсухѕіјԁԛԝһ", "aeopcyxsijdqwh"),
    # Greek drawn like Latin
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹ", "ABEZHIKMNOPTYXC"),
    ("οϲϳρν", "ocjpv"),
    # Armenian and the palochka
    ("օӀ", "oI"),
    # Arabic letters that differ only in their code
    ("یک", "يك"),
    # signs
    ("׳ʹ", "''"),
    ("״", '"'),
    ("‐‑", "--"),
)
#: Hebrew digraphs and the like that have no decomposition of their own.
WRITTEN_OUT = {"װ": "וו", "ױ": "וי", "ײ": "יי"}
#: Decompositions that keep the look: width, joined and positional letters.
_SAME_LOOK = {"<wide>", "<narrow>", "<noBreak>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>"}
#: Of the compatible ones, those that do not keep it.
_OTHER_LOOK = set("№ſŉ")
#: Hebrew letter variants: alternative ayin and the wide letters.
_HEBREW_VARIANTS = range(0xFB20, 0xFB29)
#: Invisible characters that are no format characters.
_BLANK_SIGNS = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}


@lru_cache(maxsize=1)
def _tables() -> tuple[dict[int, str], dict[int, str], np.ndarray]:
    """(first replacement, same-shape letters, quick check by code point), by rule."""
    first: dict[int, str] = {}
    for code in range(sys.maxunicode + 1):
        if 0xD800 <= code < 0xE000:
            continue
        char = chr(code)
        kind = unicodedata.category(char)
        if kind in ("Cn", "Co"):
            continue
        if kind == "Cf" or code in _BLANK_SIGNS or (kind == "Cc" and char not in "\t\n\r"):
            first[code] = ""
        elif kind == "Zs" or char == "\t":
            if char != " ":
                first[code] = " "
        elif kind in ("Zl", "Zp"):
            first[code] = "\n"
        elif (parts := unicodedata.decomposition(char)).startswith("<"):
            tag, _, rest = parts.partition(" ")
            if (tag in _SAME_LOOK and char not in _OTHER_LOOK and not rest.startswith("0020 ")) or code in _HEBREW_VARIANTS:
                full = unicodedata.normalize("NFKC", char)
                if not full.startswith(" "):
                    first[code] = full
    first |= {ord(c): s for c, s in WRITTEN_OUT.items()}
    shape = {ord(a): b for left, right in SAME_SHAPE for a, b in zip(left, right, strict=True)}
    # second halves of canonical compositions, spacing marks among them
    seconds = {int(d.split()[1], 16) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and (d := unicodedata.decomposition(chr(c))) and d[0] != "<" and " " in d}
    # a replacement may itself have a look-alike or stand for several signs
    unstable = []
    for code in range(sys.maxunicode + 1):
        if 0xD800 <= code < 0xE000:
            continue
        char = chr(code)
        if code in first or code in shape or code in seconds:
            unstable.append(code)
            continue
        if code < 0x300 and code < 0xC0:
            continue
        if unicodedata.combining(char) or unicodedata.category(char) == "Mn" or 0x1161 <= code <= 0x1175 or 0x11A8 <= code <= 0x11C2:
            unstable.append(code)
        elif unicodedata.decomposition(char) and not unicodedata.decomposition(char).startswith("<"):
            d = unicodedata.normalize("NFD", char)
            if not unicodedata.is_normalized("NFC", char) or any(ord(c) in shape or ord(c) in first for c in d):
                unstable.append(code)
    check = np.zeros(sys.maxunicode + 1, dtype=bool)
    check[[*unstable, ord("\r")]] = True
    return first, shape, check


@lru_cache(maxsize=100_000)
def _canonical_segment(segment: str) -> str:
    first, shape, _ = _tables()
    if "\r" in segment:
        segment = segment.replace("\r\n", "\n").replace("\r", "\n")
    letters = unicodedata.normalize("NFD", unicodedata.normalize("NFD", segment).translate(first))
    return unicodedata.normalize("NFC", letters.translate(shape))


def canonical(text: str | None) -> str | None:
    """The consistent form: equal for texts that look the same, null for null.

    Kept apart are other letters, digits, case, accents, points, dash lengths and
    raised digits. Width, kinds of space, line ends, invisible characters, ways of
    composing a letter and its marks and letters of one shape make no difference.
    """
    if not text:
        return text
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    at = np.flatnonzero(_tables()[2][codes])
    if not len(at):
        return text
    breaks = np.flatnonzero(np.diff(at) > 1)
    begins, ends = at[np.r_[0, breaks + 1]].tolist(), (at[np.r_[breaks, len(at) - 1]] + 1).tolist()
    out, done, n = [], 0, len(text)
    for begin, end in zip(begins, ends):
        if end <= done:
            continue
        # boundary context: the starter before; and a line feed after a carriage return
        begin -= begin > done
        if text[end - 1] == "\r" and end < n and text[end] == "\n":
            end += 1
        if begin > done:
            out.append(text[done:begin])
        segment = text[begin:end]
        out.append(_canonical_segment(segment) if end - begin <= 16 else _canonical_segment.__wrapped__(segment))
        done = end
    out.append(text[done:])
    return "".join(out)


def canonical_texts(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, form): the consistent form of every text."""

    def run(batches):
        import pyarrow as pa

        from quorumlake.llm.lookalike import canonical as form

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([form(t) for t in part.column(1).to_pylist()], pa.string())], names=[id_column, "form"])

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, form string")


def _digests(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, form, stored): 16-byte digests of the consistent form and the stored text;
    texts with nothing visible are left out."""

    def run(batches):
        from hashlib import blake2b

        import pyarrow as pa

        from quorumlake.llm.lookalike import canonical as form

        for batch in batches:
            ids, forms, stored = [], [], []
            rows = (pair for at in range(0, batch.num_rows, 256) for pair in zip(*(c.slice(at, 256).to_pylist() for c in batch.columns)))
            for i, text in rows:
                if i is None or not text:
                    continue
                shown = form(text)
                if not shown.strip():
                    continue
                ids.append(i)
                forms.append(blake2b(shown.encode("utf-8", "surrogatepass"), digest_size=16).digest())
                stored.append(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(forms, pa.binary()), pa.array(stored, pa.binary())], names=["id", "form", "stored"])

    return df.select(F.col(id_column).cast("bigint"), text_column).mapInArrow(run, "id bigint, form binary, stored binary")


def lookalike_pairs(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs whose texts look the same but are stored
    differently.

    Only digests travel. Forms with a single stored spelling are dropped by an
    aggregate that combines before the shuffle, so plain copies, however many,
    meet nobody; the rest are joined on the form. Null texts, and those with
    nothing visible, are in no pair; a repeated row counts once.
    """
    from quorumlake.session import materialize

    known = materialize(_digests(df, id_column, text_column), "forms").distinct()
    several = known.groupBy("form").agg(F.min("stored").alias("least"), F.max("stored").alias("most")).where("least <> most").select("form")
    left = known.join(several, "form", "left_semi")
    a, b = left.select("form", F.col("id").alias("id_a"), F.col("stored").alias("stored_a")), left.select("form", F.col("id").alias("id_b"), F.col("stored").alias("stored_b"))
    return a.join(b, "form").where("id_a < id_b and stored_a <> stored_b").select("id_a", "id_b").distinct()
