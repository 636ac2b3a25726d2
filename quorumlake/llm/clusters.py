"""Similarity clusters by density on grids of the sphere.

Features are a record's direction in several rotated frames, quantised to the axis it
lies nearest to, with its sign; three frames make a grid of (2 dims) ** 3 cells, and
several triples of frames make several grids. Cells are counted in SQL, and only dense
ones, with two records or more, go on. Two dense cells are adjacent when they share
records, and a record counts for a cell only if it points nearly the same way as one of
the cell's leaders, which is an exact check on the vectors as they are. Minimum labels
travel over the joined cells until nothing changes; what they join is then counted and
joined once more by its centers, on grids of its own, as a center lies nearer to a stray
member than its neighbours do. A cluster is described by its size and the members of its
densest cell.

Large groups never meet in one place: each input partition first collapses records of
one cell that point nearly the same way onto one representative, so what is shuffled of
a group is bounded by the partitions and cells it touches, and not by its size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.session import materialize


@dataclass(frozen=True)
class Grids:
    """Parameters of the grids.

    ``near``: cosine from which two records point nearly the same way. A grid is a triple
    of rotated frames: in 48 dimensions two records at cosine 0.92 share a cell of one grid
    with about 0.16, at 0.97 with 0.39, and records in general position with 1e-6, so that
    a cell seldom holds strangers, however many records there are. Records are joined on
    ``grids`` grids of ``frames`` frames, centers on ``center_grids`` of ``center_frames``
    others; ``probes`` grids serve to collapse a partition.
    """

    near: float = 0.86
    frames: int = 24
    grids: int = 16
    center_frames: int = 48
    center_grids: int = 32
    probes: int = 6
    seed: int = 20240501


DEFAULT = Grids()
_EMIT = "id bigint, rep bigint, fine bigint, vec binary, cells array<bigint>"
_CENTER = "id bigint, vec binary, cells array<bigint>"
_LINK = "a bigint, b bigint"


def _frames(seed: int, frames: int, grids: int, dims: int):
    """(axes of all frames side by side, a triple of frames for each grid), from the seed."""
    from itertools import combinations

    import numpy as np

    rng = np.random.default_rng(seed)
    axes = np.hstack([np.linalg.qr(rng.standard_normal((dims, dims)))[0] for _ in range(frames)])
    triples = np.array(list(combinations(range(frames), 3)))
    return axes.astype(np.float32), triples[rng.permutation(len(triples))[:grids]]


def _usable(table, dims: int):
    """(ids, unit vectors) of the usable rows of an Arrow batch of (id, vector)."""
    import numpy as np
    import pyarrow.compute as pc

    ids, vectors = table.column(0), table.column(1)
    keep = pc.and_(pc.is_valid(ids), pc.fill_null(pc.equal(pc.list_value_length(vectors), dims), False))
    ids, vectors = ids.filter(keep), vectors.filter(keep)
    if not len(ids):
        return np.empty(0, np.int64), np.empty((0, dims), np.float32)
    flat = np.asarray(pc.list_flatten(vectors).cast("double").to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dims)
    size = np.abs(flat).max(axis=1)
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        unit = flat / size[:, None]
        unit /= np.linalg.norm(unit, axis=1)[:, None]
    good = np.isfinite(unit).all(axis=1) & np.isfinite(size) & (size > 0)
    return ids.to_numpy(zero_copy_only=False)[good].astype(np.int64), unit[good].astype(np.float32)


def _cells(unit, frames, triples):
    """The cell of each grid for unit vectors, as exact numbers (grid and three axes)."""
    import numpy as np

    n, dims = unit.shape
    turned = (unit @ frames).reshape(n, -1, dims)
    axis = np.abs(turned).argmax(axis=2)
    sign = np.take_along_axis(turned, axis[:, :, None], axis=2)[:, :, 0] > 0
    code = axis.astype(np.int64) * 2 + sign
    side = 2 * dims
    return ((np.arange(len(triples)) * side + code[:, triples[:, 0]]) * side + code[:, triples[:, 1]]) * side + code[:, triples[:, 2]]


def _collapse(g: Grids, dims: int):
    """Map side: quantise, and collapse records of the partition that share one of the
    first cells and point nearly the same way. What is held is one vector for each
    representative of a partition, so no more than the partition itself."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        frames, triples = _frames(g.seed, g.frames, g.grids, dims)
        held: dict[int, list] = {}
        for batch in batches:
            ids, unit = _usable(batch, dims)
            if not len(ids):
                continue
            cells = _cells(unit, frames, triples)
            reps, kept = [], np.zeros(len(ids), bool)
            for k, (i, probes) in enumerate(zip(ids.tolist(), cells[:, : g.probes].tolist())):
                near = next(((r, v) for c in probes for r, v in held.get(c, ()) if float(v @ unit[k]) >= g.near), None)
                if near is None:
                    near, kept[k] = (i, unit[k].copy()), True
                    for c in probes:
                        held.setdefault(c, []).append(near)
                reps.append(near[0])
            own = [v.tobytes() if k else None for v, k in zip(unit, kept)]
            grid = [c if k else None for c, k in zip(cells.tolist(), kept.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(reps, pa.int64()), pa.array(cells[:, 0], pa.int64()), pa.array(own, pa.binary()), pa.array(grid, pa.list_(pa.int64()))], names=["id", "rep", "fine", "vec", "cells"])

    return run


def _centers(g: Grids, dims: int):
    """Label by label, in sorted partitions: the direction of the sum of its
    representatives, and its cells of the further grids."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        frames, triples = _frames(g.seed + 1, g.center_frames, g.center_grids, dims)
        held, total = None, None

        def emit(labels, sums):
            unit = np.array(sums)
            unit = (unit / np.linalg.norm(unit, axis=1)[:, None]).astype(np.float32)
            cells = _cells(unit, frames, triples)
            return pa.RecordBatch.from_arrays([pa.array(labels, pa.int64()), pa.array([v.tobytes() for v in unit], pa.binary()), pa.array(cells.tolist(), pa.list_(pa.int64()))], names=["id", "vec", "cells"])

        for batch in batches:
            if not batch.num_rows:
                continue
            labels = batch.column(0).to_numpy(zero_copy_only=False)
            vec = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.float32).reshape(-1, dims).astype(np.float64)
            begins = np.r_[0, np.nonzero(np.diff(labels))[0] + 1]
            done = ([], [])
            for label, part in zip(labels[begins].tolist(), np.add.reduceat(vec, begins, axis=0)):
                if held == label:
                    total = total + part
                    continue
                if held is not None:
                    done[0].append(held)
                    done[1].append(total)
                held, total = label, part
            if done[0]:
                yield emit(*done)
        if held is not None:
            yield emit([held], [total])

    return run


def _lead(g: Grids, dims: int):
    """Cell by cell, in sorted partitions: each record of a dense cell is linked to the
    first leader of the cell that it points along with, or leads itself."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        here, leaders, matrix = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = batch.column(0).to_numpy(zero_copy_only=False)
            ids = batch.column(1).to_numpy(zero_copy_only=False)
            vec = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.float32).reshape(-1, dims)
            begins = np.r_[0, np.nonzero(np.diff(cells))[0] + 1, len(cells)]
            a, b = [], []
            for lo, hi in zip(begins[:-1].tolist(), begins[1:].tolist()):
                if here != cells[lo]:
                    here, leaders, matrix = cells[lo], [], None
                todo = np.arange(lo, hi)
                if matrix is not None:
                    cos = vec[todo] @ matrix.T
                    best = cos.argmax(axis=1)
                    hit = cos[np.arange(len(todo)), best] >= g.near
                    a += ids[todo[hit]].tolist()
                    b += [leaders[x] for x in best[hit].tolist()]
                    todo = todo[~hit]
                while len(todo):
                    lead = todo[0]
                    leaders.append(int(ids[lead]))
                    matrix = vec[lead : lead + 1] if matrix is None else np.vstack([matrix, vec[lead]])
                    todo = todo[1:]
                    hit = vec[todo] @ vec[lead] >= g.near
                    a += ids[todo[hit]].tolist()
                    b += [leaders[-1]] * int(hit.sum())
                    todo = todo[~hit]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def propagate_minimum(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """(id, label): the smallest id of each connected component of ``links`` (a, b).

    Each round every id takes the smallest label among its neighbours and then its
    label's label, and is written to the shared folder, until nothing changes. Labels only
    fall, so that comes; more than ``rounds`` rounds, if given, are an error, never an
    unfinished result.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = materialize(both, "links")
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    done = 0
    while rounds is None or done < rounds:
        done += 1
        seen = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = labels.join(seen, "id").select("id", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("further"))
        step = step.join(jump, "label", "left").select("id", F.least("label", F.coalesce("further", "label")).alias("label"), "old")
        step = materialize(step, "labels")
        changed = not step.where("label <> old").isEmpty()
        labels = step.select("id", "label")
        if not changed:
            return labels
    raise RuntimeError(f"labels still change after {rounds} rounds")


def similarity_clusters(df: DataFrame, id_column: str, vector_column: str, dims: int, at_least: int = 4, grids: Grids = DEFAULT) -> DataFrame:
    """(id, first_id, size, fine): the members of every cluster of ``at_least`` records
    or more; ``first_id`` is the cluster's smallest id, ``fine`` its cell of the first grid.

    Vectors that are null, all zero, not of ``dims`` numbers or with a NaN, null or
    infinite number are unusable and take no part; length plays no part. A record
    that is repeated counts once. Other columns are ignored.
    """
    rows = df.select(F.col(id_column).cast("bigint").alias("id"), F.col(vector_column).alias("vector")).where("id is not null and vector is not null").dropDuplicates(["id"])
    emitted = materialize(rows.mapInArrow(_collapse(grids, dims), _EMIT), "cells")
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)

    def joined(points: DataFrame) -> DataFrame:
        """(id, label) of points (id, vec, cells) joined through the dense cells."""
        cells = points.select(F.explode("cells").alias("cell"), "id")
        dense = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("cell")
        # vectors go along only from here on, for dense cells only
        inside = cells.join(materialize(dense, "dense"), "cell", "left_semi").join(points.select("id", "vec"), "id")
        inside = inside.repartition(n, "cell").sortWithinPartitions("cell", "id").select("cell", "id", "vec")
        return propagate_minimum(inside.mapInArrow(_lead(grids, dims), _LINK).distinct())

    reps = emitted.where("vec is not null").select("id", "vec", "cells")
    first = joined(reps)
    labelled = reps.join(first, "id", "left").select(F.coalesce("label", "id").alias("label"), "vec")
    centers = materialize(labelled.repartition(n, "label").sortWithinPartitions("label").mapInArrow(_centers(grids, dims), _CENTER), "centers")
    second = joined(centers).select(F.col("id").alias("label"), F.col("label").alias("whole"))
    members = emitted.select("id", "rep", "fine").join(first.withColumnRenamed("id", "rep"), "rep", "left").select("id", F.coalesce("label", "rep").alias("label"), "fine")
    members = members.join(second, "label", "left").select("id", F.coalesce("whole", "label").alias("label"), "fine")
    sizes = members.groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("first_id")).where(F.col("size") >= at_least)
    return members.join(sizes, "label").select("id", "first_id", "size", "fine")


def describe_clusters(clusters: DataFrame, typical: int = 3) -> DataFrame:
    """(first_id, size, dense_cell_size, typical_ids): each cluster's size and the
    ``typical`` smallest ids of its densest cell (ties: the cell with the smallest id)."""
    from pyspark.sql import Window

    cells = clusters.groupBy("first_id", "size", "fine").agg(F.count(F.lit(1)).alias("dense_cell_size"), F.min("id").alias("least"))
    by_density = Window.partitionBy("first_id").orderBy(F.col("dense_cell_size").desc(), "least")
    densest = cells.withColumn("rank", F.row_number().over(by_density)).where("rank = 1").select("first_id", "fine", "dense_cell_size")
    inside = clusters.join(densest, ["first_id", "fine"]).withColumn("rank", F.row_number().over(Window.partitionBy("first_id").orderBy("id"))).where(F.col("rank") <= typical)
    return inside.groupBy("first_id", "size", "dense_cell_size").agg(F.array_sort(F.collect_list("id")).alias("typical_ids"))
