"""Text helpers as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters without any visible shape (fixed values).
INVISIBLE = r"[­؜᠎​-‏‪-‮⁠-⁤⁦-⁩﻿]"


def utrim(text: Column) -> Column:
    """Strip Unicode space separators at both ends (tabs and line ends stay)."""
    return F.regexp_replace(text, r"^\p{Zs}+|\p{Zs}+$", "")


def is_blank(text: Column) -> Column:
    """True for null and for texts of nothing but white space and invisible characters."""
    return text.isNull() | ~text.rlike(r"[^\s\p{Z}\p{Cf}]")


def name_key(text: Column) -> Column:
    """Order-insensitive key of a name: words without punctuation, sorted."""
    words = F.split(F.regexp_replace(text, r"[^\p{L}\p{N}_\s]", " "), r"\s+")
    return F.array_join(F.array_sort(F.filter(words, lambda w: w != "")), " ")


def title_tidy(text: Column) -> Column:
    """One space between words, none outside, no full stops at the end."""
    one = F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"^ | $", "")
    return F.regexp_replace(one, r"\.+$", "")


def url_canonical(url: Column) -> Column:
    """Backslashes become slashes, outer blanks go, and repeated slashes of the path
    become one; scheme, authority, query and fragment stay as they are."""
    x = F.translate(F.regexp_replace(url, r"(?U)^\s+|\s+$", ""), "\\", "/")
    front = F.regexp_extract(x, r"^((?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?)", 1)
    rest = F.substring(x, F.length(front) + 1, F.length(x))
    path = F.regexp_extract(rest, r"^([^?#]*)", 1)
    return F.concat(front, F.regexp_replace(path, "/{2,}", "/"), F.substring(rest, F.length(path) + 1, F.length(x)))


def document_format(declared: Column, url: Column) -> Column:
    """Declared format if it is one, else the suffix of the address; lower case."""
    named = F.lower(F.regexp_extract(declared, r"(?i)\b(pdf|docx|doc|rtf|html?)\b", 1))
    suffix = F.lower(F.regexp_extract(url, r"\.([A-Za-z0-9]{2,5})(?:[?#].*)?$", 1))
    return F.coalesce(F.nullif(named, F.lit("")), F.nullif(suffix, F.lit("")))


def script_ratio(text: Column, script: str = r"[֐-׿]") -> Column:
    """Share of the non-space characters that belong to a script; 0.0 when there are none."""
    total = F.expr("0") + F.regexp_count(text, F.lit(r"(?U)\S"))
    return F.coalesce(F.regexp_count(text, F.lit(script)) / F.nullif(total, F.lit(0)), F.lit(0.0))


def content_key(**parts: Column) -> Column:
    """Stable key of a content: sha-256 over its canonical JSON (names sorted, nulls
    written, no blanks)."""
    held = F.struct(*[c.alias(name) for name, c in sorted(parts.items())])
    return F.sha2(F.to_json(held, {"ignoreNullFields": "false"}), 256)


#: Phrases that tell the reading of a motion, in the order in which they are tried
#: (fixed values): sending a bill to committee for its next readings is the first.
READINGS = (("להכנה לקריאה", 1), ("טרומית", 0), ("קריאה שלישית", 3), ("קריאה שנייה", 2), ("קריאה שניה", 2), ("קריאה ראשונה", 1))


def reading_of(motion: Column) -> Column:
    """Reading that a motion's text tells of; null where it tells of none."""
    out = F.lit(None).cast("int")
    for phrase, reading in reversed(READINGS):
        out = F.when(F.contains(motion, F.lit(phrase)), reading).otherwise(out)
    return out
