"""Overlapping and gapped intervals as compressed run bitmaps.

Every interval is written as bits of 64-day words: its first and last word as
partial words, everything between as ranges of *full* words inside shards of 64
words (4,096 days). Words and shards are united with ``bit_or``, an aggregate
that combines before the shuffle, so an entity that holds a third of all rows
costs no more than its calendar. Set runs come out of the united words and are
stitched over word and shard borders per entity; clear runs are the gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN_END = 2**31 - 1

# level 0: slot is a word of 64 days, bits are days.
# level 1: slot is a shard of 64 words, bits are full words.
# level 2: an open end; first is the earliest day from which everything is set.
# s: first day, e: day after the last; sw, ew: words of the first and last day;
# sb, eb: their bits; h: a shard that holds words between them.
_NO_DAY = "'first', cast(null as int)"
_PIECES = f"""
case when e is null then array(
    named_struct('level', 0, 'slot', sw, 'cover', shiftleft(1L, sb), 'starts', shiftleft(1L, sb), 'ends', 0L, {_NO_DAY}),
    named_struct('level', 2, 'slot', 0, 'cover', 0L, 'starts', 0L, 'ends', 0L, 'first', s))
when sw = ew then array(
    named_struct('level', 0, 'slot', sw, 'cover', shiftleft(-1L, sb) & shiftrightunsigned(-1L, 63 - eb),
                 'starts', shiftleft(1L, sb), 'ends', shiftleft(1L, eb), {_NO_DAY}))
else concat(array(
    named_struct('level', 0, 'slot', sw, 'cover', shiftleft(-1L, sb), 'starts', shiftleft(1L, sb), 'ends', 0L, {_NO_DAY}),
    named_struct('level', 0, 'slot', ew, 'cover', shiftrightunsigned(-1L, 63 - eb), 'starts', 0L, 'ends', shiftleft(1L, eb), {_NO_DAY})),
    transform(if(ew - sw < 2, array(), sequence(shiftright(sw + 1, 6), shiftright(ew - 1, 6))),
        h -> named_struct('level', 1, 'slot', h,
            'cover', shiftleft(-1L, greatest(sw + 1 - 64 * h, 0)) & shiftrightunsigned(-1L, 63 - least(ew - 1 - 64 * h, 63)),
            'starts', 0L, 'ends', 0L, {_NO_DAY})))
end
"""

# A run begins at a set bit after a clear one and ends at a set bit before a clear one.
_RUNS = f"""
case when level = 2 then array(named_struct('lo', first, 'hi', {OPEN_END}, 'n_starts', 0, 'n_ends', 1))
else zip_with(
    filter(sequence(0, 63), i -> getbit(cover & ~shiftleft(cover, 1), i) = 1),
    filter(sequence(0, 63), i -> getbit(cover & ~shiftrightunsigned(cover, 1), i) = 1),
    (a, b) -> if(level = 0,
        named_struct('lo', 64 * slot + a, 'hi', 64 * slot + b + 1,
            'n_starts', bit_count(starts & shiftleft(-1L, a) & shiftrightunsigned(-1L, 63 - b)),
            'n_ends', bit_count(ends & shiftleft(-1L, a) & shiftrightunsigned(-1L, 63 - b))),
        named_struct('lo', 64 * (64 * slot + a), 'hi', 64 * (64 * slot + b + 1), 'n_starts', 0, 'n_ends', 0)))
end
"""


def continuous_periods(df: DataFrame, keys: list[str], start: Column, end: Column) -> DataFrame:
    """Continuous periods of half-open day intervals.

    Rows: ``keys``, ``from_day``, ``to_day`` (dates; null = open), ``n_starts``
    and ``n_ends`` (distinct first and last days), ``is_merged`` (at least two
    different intervals), ``next_from`` (the next period's start, null for the
    last). Overlapping and touching intervals form one period.

    ``end`` null means open. Rows with a null start, or with an end that is not
    after the start, take no part; repeated rows change nothing; a null key is a
    key of its own. Other columns are ignored, whatever their names.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    bits = (
        df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.unix_date(start).alias("s"), F.unix_date(end).alias("e"))
        .where("s is not null and (e is null or e > s)")
        .selectExpr("*", "shiftright(s, 6) as sw", "s & 63 as sb", "shiftright(e - 1, 6) as ew", "(e - 1) & 63 as eb")
        .select(*names, F.inline(F.expr(_PIECES)))
        .groupBy(*names, "level", "slot")
        .agg(
            F.bit_or("cover").alias("cover"),
            F.bit_or("starts").alias("starts"),
            F.bit_or("ends").alias("ends"),
            F.min("first").alias("first"),
        )
    )
    runs = bits.select(*names, F.inline(F.expr(_RUNS)))
    by_time = Window.partitionBy(*names).orderBy("lo", "hi")
    reached = F.max("hi").over(by_time.rowsBetween(Window.unboundedPreceding, -1))
    numbered = runs.withColumn("fresh", F.when(F.col("lo") <= reached, 0).otherwise(1)).withColumn("period", F.sum("fresh").over(by_time.rowsBetween(Window.unboundedPreceding, 0)))
    periods = numbered.groupBy(*names, "period").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n_starts").alias("n_starts"), F.sum("n_ends").alias("n_ends"))
    following = F.lead("lo").over(Window.partitionBy(*names).orderBy("lo"))
    return periods.withColumn("next_lo", following).select(
        *[F.col(n).alias(k) for k, n in zip(keys, names)],
        F.date_from_unix_date("lo").alias("from_day"),
        F.when(F.col("hi") < OPEN_END, F.date_from_unix_date("hi")).alias("to_day"),
        "n_starts",
        "n_ends",
        ((F.col("n_starts") > 1) | (F.col("n_ends") > 1)).alias("is_merged"),
        F.date_from_unix_date("next_lo").alias("next_from"),
    )


def merged_and_gaps(periods: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, kind, from_date, to_date): periods of several intervals, and gaps."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    cases = F.array(
        F.when(F.col("is_merged"), F.struct(F.lit("merged").alias("kind"), text("from_day").alias("from_date"), text("to_day").alias("to_date"))),
        F.when(F.col("next_from").isNotNull(), F.struct(F.lit("gap").alias("kind"), text("to_day").alias("from_date"), text("next_from").alias("to_date"))),
    )
    return periods.select(*keys, F.inline(F.filter(cases, lambda c: c.isNotNull())))
