"""Several values packed in one field, split by quotes first and delimiters second.

All of it is one Spark expression: the field is split on quote characters, odd
pieces are literals, even pieces are split on delimiters, and an array fold puts
the values together again. No row ever leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Separators between values (fixed values).
DELIMITERS = ",;/|\n\r\t،、，；•·"
#: Quote characters that can enclose a value (fixed values).
QUOTES = '"“”„«»'
#: Stand-ins, all from the private use area: around a list mark, for the brackets of a
#: mark, for quotes that enclose nothing.
_MARK, _MARK_END = "", ""
_HELD_BRACKETS = ""
_HELD_QUOTES = ""
_EDGE = r"^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$"


def _class(chars: str) -> str:
    return "[" + "".join("\\" + c if c in '|[]^-\\/"' else c for c in chars) + "]"


def _let(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use(x)``, with x evaluated once however often it is named."""
    return F.element_at(F.transform(F.array(x), use), 1)


def _marked(text: Column) -> Column:
    """One kind of quote, quotes that enclose nothing held, list marks wrapped."""
    x = text
    # a list in JSON spelling: the outer brackets go, the escapes become held quotes
    as_list = x.rlike(r'(?s)^\s*\[\s*(".*")?\s*\]\s*$')
    x = F.when(as_list, F.regexp_replace(F.regexp_replace(x, r"(?s)^\s*\[|\]\s*$", ""), r'\\"', _HELD_QUOTES[0])).otherwise(x)
    x = F.regexp_replace(x, r'\\(["\\/])', "$1")
    # quotes that enclose nothing: doubled or single ones inside a word
    x = F.regexp_replace(x, r'(?<=[\p{L}\p{M}])""(?=[\p{L}])', _HELD_QUOTES[0])
    for quote, held in zip(QUOTES, _HELD_QUOTES):
        x = F.regexp_replace(x, rf"(?<=[\p{{L}}\p{{M}}]){quote}(?=[\p{{L}}])", held)
    x = F.translate(x, QUOTES, '"' * len(QUOTES))
    # list marks stand where a value begins
    left, right = _HELD_BRACKETS
    x = F.regexp_replace(x, r"(^|[\s,;/|])\((\d+)\)(\s+)", f"$1{_MARK}{left}$2{right}$3{_MARK_END}")
    x = F.regexp_replace(x, r"(^|[\s,;/|])(\d+)\)(\s+)", f"$1{_MARK}$2{right}$3{_MARK_END}")
    x = F.regexp_replace(x, r"(^|[\s,;/|])(\d+\.\s+)", f"$1{_MARK}$2{_MARK_END}")
    return F.regexp_replace(x, r"(^|\n)([ \t]*[-–*][ \t]+)", f"$1{_MARK}$2{_MARK_END}")


def _pieces(marked: Column) -> Column:
    """Structs (text, whole): odd pieces between quotes are whole, even ones are cut at
    their brackets; each bracket is a piece of its own."""

    def of(pieces: Column) -> Column:
        cut = r"(?<=[()\[\]])|(?=[()\[\]])"
        literal = lambda i: (i % 2 == 1) & (i < F.size(pieces) - 1)
        return F.flatten(
            F.transform(
                pieces,
                lambda p, i: F.when(literal(i), F.array(F.struct(p.alias("text"), F.lit(True).alias("whole")))).otherwise(
                    F.transform(F.split(p, cut, -1), lambda t: F.struct(t.alias("text"), t.isin("(", ")", "[", "]").alias("whole")))
                ),
            )
        )

    return _let(F.split(marked, '"', -1), of)


def _closed(pieces: Column) -> Column:
    """For each piece, whether it stands inside a bracket that is closed later on.

    The depth after a piece counts all open brackets; the least depth from there to the
    end counts those that are never closed, which hold nothing together."""
    step = lambda t: F.when(t["whole"] & t["text"].isin("(", "["), 1).when(t["whole"] & t["text"].isin(")", "]"), -1).otherwise(0)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))

    def down(acc: Column, t: Column) -> Column:
        return _let(F.greatest(acc["at"] + step(t), F.lit(0)), lambda d: F.struct(d.alias("at"), F.concat(acc["all"], F.array(d)).alias("all")))

    def least(depths: Column) -> Column:
        start = F.struct(F.element_at(depths, -1).alias("at"), F.array().cast("array<int>").alias("all"))
        up = lambda acc, d: _let(F.least(acc["at"], d), lambda m: F.struct(m.alias("at"), F.concat(acc["all"], F.array(m)).alias("all")))
        return F.reverse(F.aggregate(F.reverse(depths), start, up, lambda acc: acc["all"]))

    return _let(F.aggregate(pieces, zero, down, lambda acc: acc["all"]), lambda depths: F.zip_with(depths, least(depths), lambda d, m: d > m))


def split_packed(text: Column) -> Column:
    """ARRAY<STRING> of the values in one field, in order, empty pieces left out.

    Enclosing quotes (straight, curved or angled), list marks (``1.``, ``1)``,
    ``(1)``, bullets, a leading dash), escapes (``\\"``, ``""``) and outer blanks
    are removed; separators inside quotes or brackets, however long or nested, belong
    to the value; a bracket that is never closed holds nothing together; a quote
    mark between two letters encloses nothing; a quote that is never closed is
    dropped. Null gives null, a blank text gives an empty array.
    """
    split_at = f"{_class(DELIMITERS)}|{_MARK}[^{_MARK_END}]*{_MARK_END}"
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(acc: Column, piece: Column) -> Column:
        def with_parts(parts: Column) -> Column:
            n = F.size(parts)
            joined = F.concat(acc["cur"], F.element_at(parts, 1))
            return F.when(n == 1, F.struct(acc["done"].alias("done"), joined.alias("cur"))).otherwise(
                F.struct(F.concat(acc["done"], F.array(joined), F.slice(parts, 2, F.greatest(n - 2, F.lit(0)))).alias("done"), F.element_at(parts, -1).alias("cur"))
            )

        return F.when(piece["kept"], F.struct(acc["done"].alias("done"), F.concat(acc["cur"], piece["text"]).alias("cur"))).otherwise(_let(F.split(piece["text"], split_at, -1), with_parts))

    def values(pieces: Column) -> Column:
        inside = F.when(F.exists(pieces, lambda t: t["whole"] & t["text"].isin("(", "[")), _closed(pieces)).otherwise(F.transform(pieces, lambda t: F.lit(False)))
        marked = F.zip_with(pieces, inside, lambda t, i: F.struct(t["text"].alias("text"), (t["whole"] | i).alias("kept")))
        return F.aggregate(marked, empty, step, lambda acc: F.concat(acc["done"], F.array(acc["cur"])))

    back = lambda v: F.regexp_replace(F.translate(v, _HELD_QUOTES + _HELD_BRACKETS + _MARK + _MARK_END, QUOTES + "()"), _EDGE, "")
    return F.filter(F.transform(_let(_pieces(_marked(text)), values), back), lambda v: v != "")


def explode_packed(df: DataFrame, column: str, keep: list[str], pos: str = "pos", value: str = "value", at_least: int = 1) -> DataFrame:
    """One row per value with its position from 1; fields with fewer than
    ``at_least`` values, null and blank fields give none. Rows are distinct."""
    kept = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keep)]
    packed = df.select(*kept, F.col(column).alias("__text")).where(F.col("__text").rlike(r"[^\s\p{Z}\p{Cf}]")).distinct()
    enough = _let(split_packed(F.col("__text")), lambda v: F.when(F.size(v) >= at_least, v))
    out = packed.select(*[f"__k{i}" for i in range(len(keep))], enough.alias("__values"))
    out = out.select(*[F.col(f"__k{i}").alias(k) for i, k in enumerate(keep)], F.posexplode_outer("__values").alias("__p", value))
    # an inner explode would have the whole split evaluated again as a filter on the scan
    return out.where(F.col(value).isNotNull()).select(*keep, (F.col("__p") + 1).cast("bigint").alias(pos), value).distinct()
