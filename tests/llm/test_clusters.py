import numpy as np
import pytest

from quorumlake.llm.clusters import describe_clusters, propagate_minimum, similarity_clusters


def planted(seed=4):
    """Groups of any size around directions, near misses, lone records, unusable ones."""
    rng = np.random.default_rng(seed)
    rows, want, n = [], {}, 0
    unit = lambda v: v / np.linalg.norm(v)
    for size in [3, 4, 4, 5, 9, 30, 400, 2, 1, 1, 1]:
        center = unit(rng.normal(size=48))
        near = unit(center + unit(rng.normal(size=48)) * 0.75)  # cosine about 0.8
        ids = []
        for _ in range(size):
            ids.append(n)
            rows.append((n, (unit(center + rng.normal(size=48) * 0.02) * rng.choice([0.2, 1, 17])).tolist()))
            n += 1
        rows.append((n, near.tolist()))
        n += 1
        if size >= 4:
            want |= {i: min(ids) for i in ids}
    bad = [None, [0.0] * 48, [1.0] * 17, [float("nan")] + [1.0] * 47, [None] + [1.0] * 47, [float("inf")] + [1.0] * 47, []]
    rows += [(n + i, v) for i, v in enumerate(bad)]
    order = rng.permutation(len(rows))
    return [rows[i] for i in order] + rows[:40], want


@pytest.fixture(scope="module")
def found(spark):
    rows, want = planted()
    df = spark.createDataFrame(rows, "row bigint, vec array<float>").repartition(5)
    return similarity_clusters(df, "row", "vec", 48).persist(), want


def test_groups_are_whole_and_apart(found):
    out, want = found
    assert {r["id"]: r["first_id"] for r in out.collect()} == want


def test_description(found):
    out, want = found
    sizes = {f: sum(v == f for v in want.values()) for f in want.values()}
    rows = describe_clusters(out).collect()
    assert {r["first_id"]: r["size"] for r in rows} == sizes
    assert all(1 <= len(r["typical_ids"]) <= 3 and all(want[i] == r["first_id"] for i in r["typical_ids"]) for r in rows)


def test_empty(spark):
    df = spark.createDataFrame([], "row bigint, vec array<float>")
    assert similarity_clusters(df, "row", "vec", 48).count() == 0


def test_labels_travel_along_chains(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    got = {r["id"]: r["label"] for r in propagate_minimum(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_unfinished_labels_are_an_error(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a bigint, b bigint")
    with pytest.raises(RuntimeError):
        propagate_minimum(chain, rounds=2)
    assert {r["label"] for r in propagate_minimum(chain).collect()} == {0}


def test_vectors_of_another_length(spark):
    same = [(i, [0.0] * i + [1.0] + [0.0] * (63 - i)) for i in range(3)] + [(i, [0.0] * 10 + [2.0] * 54) for i in range(10, 18)]
    df = spark.createDataFrame(same, "row bigint, vec array<double>")
    assert {(r["id"], r["first_id"], r["size"]) for r in similarity_clusters(df, "row", "vec", 64).collect()} == {(i, 10, 8) for i in range(10, 18)}


def test_agrees_with_brute_force(spark):
    """Every pair of a random set at the same cut: nothing is lost, whatever the partitions."""
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(60, 48))
    x = np.vstack([c / np.linalg.norm(c) + rng.normal(size=(int(rng.integers(1, 30)), 48)) * 0.025 for c in centers])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    label = np.arange(len(u))
    near = u @ u.T >= 0.86
    while True:
        lower = np.array([label[row].min() for row in near])
        if (lower == label).all():
            break
        label = lower
    want = {i: int(v) for i, v in enumerate(label) if (label == v).sum() >= 4}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row bigint, vec array<double>")
    for parts in (1, 7):
        assert {r["id"]: r["first_id"] for r in similarity_clusters(df.repartition(parts), "row", "vec", 48).collect()} == want
