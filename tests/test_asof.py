import bisect
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quorumlake.operators.asof import asof_left, asof_left_bucketed, asof_left_history, current_versions

T = dt.datetime(2020, 1, 1)


def at(n):
    return T + dt.timedelta(seconds=n)


def data(spark, n=3000):
    rng = random.Random(3)
    events = [(i, rng.choice([1, 1, 1, rng.randint(2, 40), None]), at(rng.randint(0, 1000)) if rng.random() > 0.02 else None) for i in range(n)]
    versions = list({(k, at(rng.randint(0, 1000))) for k in range(1, 35) for _ in range(8)})
    versions = [(k, t, f"v{i}" if i % 7 else None) for i, (k, t) in enumerate(versions)]
    by = {}
    for k, t, v in sorted(versions, key=lambda x: (x[0], x[1])):
        by.setdefault(k, []).append((t, v))
    want = {}
    for i, k, t in events:
        held = by.get(k, [])
        n = bisect.bisect_right([x for x, _ in held], t) if t else 0
        want[i] = held[n - 1] if n else (None, None)
    e = spark.createDataFrame(events, "id int, k int, at timestamp_ntz")
    v = spark.createDataFrame(versions, "k int, since timestamp_ntz, label string")
    return e, v, want


def test_bucketed_with_a_hot_key(spark):
    e, v, want = data(spark)
    for buckets in (None, 3, 16):
        got = asof_left_bucketed(e, v, "k", "at", "since", buckets).collect()
        assert len(got) == len(want) and {r["id"]: (r["since"], r["label"]) for r in got} == want


def test_history_form(spark):
    e, v, want = data(spark)
    got = asof_left_history(e, v.withColumn("t", F.col("since")), "k", "at", "since", ["t", "label"]).collect()
    assert len(got) == len(want) and {r["id"]: (r["t"], r["label"]) for r in got} == want
    with pytest.raises(Exception, match="too long"):
        asof_left_history(e, v, "k", "at", "since", ["label"], longest=3).collect()


def test_window_form(spark):
    e, v, want = data(spark)
    got = asof_left(e, v.withColumn("t", F.col("since")), "k", "at", "since", ["t", "label"]).collect()
    assert len(got) == len(want) and {r["id"]: (r["t"], r["label"]) for r in got} == want


def test_empty_sides(spark):
    e, v, want = data(spark, 50)
    assert asof_left_bucketed(e.limit(0), v, "k", "at", "since").count() == 0
    got = asof_left_bucketed(e, v.limit(0), "k", "at", "since").collect()
    assert len(got) == 50 and all(r["label"] is None for r in got)


def test_ties_are_resolved_first(spark):
    v = spark.createDataFrame([(1, T, "a", 2), (1, T, "b", 3), (1, None, "c", 1), (None, T, "d", 1)], "k int, since timestamp_ntz, label string, n int")
    assert [r["label"] for r in current_versions(v, "k", "since", [F.col("n").desc()]).collect()] == ["b"]
