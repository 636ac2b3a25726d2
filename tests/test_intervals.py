"""Run bitmaps against a plain sweep over sorted intervals."""

import datetime as dt
import random

from pyspark.sql import functions as F

from quorumlake.operators.intervals import continuous_periods, merged_and_gaps

DAY0 = dt.date(1999, 12, 20)
SCHEMA = "k string, s date, e date"


def day(n):
    return DAY0 + dt.timedelta(days=n)


def sweep(rows):
    """(key, from, to or None, merged) by sorting."""
    by = {}
    for k, s, e in rows:
        if s is not None and (e is None or e > s):
            by.setdefault(k, set()).add((s, e))
    far, out = dt.date.max, set()
    for k, spans in by.items():
        periods = []
        for s, e in sorted(spans, key=lambda x: (x[0], x[1] or far)):
            e = e or far
            if periods and s <= periods[-1][1]:
                periods[-1] = [periods[-1][0], max(periods[-1][1], e), periods[-1][2] + 1]
            else:
                periods.append([s, e, 1])
        out |= {(k, a, None if b == far else b, n > 1) for a, b, n in periods}
    return out


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return {(r["k"], r["from_day"], r["to_day"], r["is_merged"]) for r in continuous_periods(df, ["k"], F.col("s"), F.col("e")).collect()}


def test_matches_sweep_on_random_intervals(spark):
    rng = random.Random(5)
    rows = []
    for k in range(60):
        for _ in range(rng.randint(1, 12)):
            s = rng.randint(-200, 9000)
            length = rng.choice([1, 2, 63, 64, 65, 128, 700, 4096, 5000, rng.randint(1, 300)])
            rows.append((f"k{k}", day(s), None if rng.random() < 0.07 else day(s + length)))
    rows += rows[:50]
    assert run(spark, rows) == sweep(rows)


def test_word_and_shard_borders(spark):
    rows = [("a", dt.date(1970, 1, 1), dt.date(1970, 3, 6)), ("a", dt.date(1970, 3, 6), dt.date(1981, 3, 20)), ("b", dt.date(1969, 12, 1), dt.date(1970, 1, 1)), ("b", dt.date(1970, 1, 2), dt.date(1970, 1, 3)), ("c", dt.date(1960, 1, 1), dt.date(2020, 1, 1))]
    assert run(spark, rows) == sweep(rows)


def test_nulls_empty_reversed_and_repeated(spark):
    rows = [(None, day(1), day(3)), (None, day(2), day(4)), ("a", None, day(3)), ("b", day(3), day(3)), ("c", day(5), day(4)), ("d", day(1), day(2)), ("d", day(1), day(2)), ("e", day(1), None), ("e", day(9), None)]
    assert run(spark, rows) == sweep(rows)
    assert run(spark, []) == set()


def test_cases_and_clashing_columns(spark):
    df = spark.createDataFrame([("x", day(0), day(10), 1, "y"), ("x", day(20), day(30), 2, "y"), ("x", day(25), None, 3, "z")], "k string, s date, e date, cover int, level string")
    got = {tuple(r) for r in merged_and_gaps(continuous_periods(df, ["k"], F.col("s"), F.col("e")), ["k"]).collect()}
    assert got == {("x", "gap", str(day(10)), str(day(20))), ("x", "merged", str(day(20)), "")}
