"""Exact nearest neighbours by cosine, and exact density clusters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.session import materialize

_PACK = "block long, ids binary, vectors binary"
_TOP = "query_id bigint, neighbor_id bigint, similarity double"


def _packed(df: DataFrame, id_column: str, vector_column: str, rows: int) -> DataFrame:
    """Rows packed into matrices of at most ``rows`` unit vectors (zero vectors stay zero)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            pairs = [(i, v) for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if i is not None and v and None not in v]
            for at in range(0, len(pairs), rows):
                part = pairs[at : at + rows]
                m = np.array([v for _, v in part], dtype=np.float64)
                norm = np.linalg.norm(m, axis=1)
                m /= np.where(norm == 0, 1, norm)[:, None]
                yield pa.RecordBatch.from_arrays([pa.array([part[0][0]], pa.int64()), pa.array([np.array([i for i, _ in part], dtype=np.int64).tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary())], names=["block", "ids", "vectors"])

    return df.select(F.col(id_column).cast("bigint"), vector_column).mapInArrow(run, _PACK)


def nearest_neighbors(queries: DataFrame, base: DataFrame, id_column: str, vector_column: str, k: int = 5, block_rows: int = 4096) -> DataFrame:
    """(query_id, rank, neighbor_id, similarity): the k most similar rows of ``base``
    for each row of ``queries``, itself left out; fewer where there are fewer.

    The stated queries meet all rows in blocks: both sides are packed into matrices,
    every pair of blocks is one product that keeps its best k, and those are merged.
    Null vectors take no part. Ties go to the smaller id.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    q = _packed(queries, id_column, vector_column, block_rows).select(F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    b = _packed(base, id_column, vector_column, block_rows).select("ids", "vectors")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for qi, qv, bi, bv in zip(*(batch.column(c).to_pylist() for c in range(4))):
                q_ids, b_ids = np.frombuffer(qi, np.int64), np.frombuffer(bi, np.int64)
                sim = np.frombuffer(qv).reshape(len(q_ids), -1) @ np.frombuffer(bv).reshape(len(b_ids), -1).T
                sim[q_ids[:, None] == b_ids[None, :]] = -np.inf
                out = ([], [], [])
                for row, query in enumerate(q_ids.tolist()):
                    s = sim[row]
                    limit = np.partition(s, -k)[-k] if len(s) > k else -np.inf
                    near = np.nonzero((s >= limit) & (s > -np.inf))[0]
                    near = near[np.lexsort((b_ids[near], -s[near]))][:k]
                    out[0].extend([query] * len(near))
                    out[1].extend(b_ids[near].tolist())
                    out[2].extend(s[near].tolist())
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "neighbor_id", "similarity"])

    n = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = q.crossJoin(b).repartition(n).mapInArrow(run, _TOP)
    best = met.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("similarity")).alias("d"), "neighbor_id"))), 1, k).alias("x"))
    out = best.select("query_id", F.posexplode("x").alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).cast("bigint").alias("rank"), F.col("x.neighbor_id").alias("neighbor_id"), (-F.col("x.d")).alias("similarity"))


@dataclass(frozen=True)
class DensityConfig:
    """Density clustering of unit vectors; ``method`` is 'leaf' or 'eom'. Up to
    ``max_rows`` rows are clustered in one task, more in blocks across tasks."""

    min_cluster_size: int = 4
    min_samples: int = 4
    method: str = "leaf"
    max_rows: int = 20_000

    def __post_init__(self):
        if self.min_cluster_size < 2 or self.min_samples < 1:
            raise ValueError("min_cluster_size must be at least 2 and min_samples at least 1")
        if self.method not in ("leaf", "eom"):
            raise ValueError("method must be 'leaf' or 'eom'")

    def run_id(self, data_key: str = "") -> str:
        return f"unit_mcs{self.min_cluster_size}_{self.method}" + (f"_{data_key}" if data_key else "")


def density_labels(vectors, config: DensityConfig):
    """(labels, probabilities) of hierarchical density clustering: mutual reachability,
    minimum spanning tree, condensed tree, leaf or excess-of-mass selection; -1 is noise."""
    import numpy as np

    x = np.asarray(vectors, dtype=np.float64)
    n = len(x)
    if n < 3:
        raise ValueError("at least three rows are needed")
    norm = np.linalg.norm(x, axis=1)
    x = x / np.where(norm == 0, 1, norm)[:, None]
    k = min(config.min_samples, n - 1)
    row = lambda i: np.sqrt(np.maximum(0, 2 - 2 * (x @ x[i])))
    core = np.array([np.partition(row(i), k)[k] for i in range(n)])
    # Prim's tree over mutual reachability, one row at a time
    inside = np.zeros(n, bool)
    best, link = np.full(n, np.inf), np.zeros(n, int)
    at, edges = 0, []
    for _ in range(n - 1):
        inside[at] = True
        d = np.maximum(np.maximum(row(at), core), core[at])
        closer = ~inside & (d < best)
        best[closer], link[closer] = d[closer], at
        at = int(np.argmin(np.where(inside, np.inf, best)))
        edges.append((best[at], int(link[at]), at))
    return _tree_labels(edges, n, config)


def _tree_labels(edges: list[tuple[float, int, int]], n: int, config: DensityConfig):
    """(labels, probabilities) from the edges (distance, row, row) of a spanning tree."""
    import numpy as np

    edges.sort()
    # single linkage, then the condensed tree from the top
    parent, kids, size, height = list(range(2 * n - 1)), {}, [1] * n, {}

    def root(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for step, (d, a, b) in enumerate(edges):
        a, b, new = root(a), root(b), n + step
        kids[new], height[new] = (a, b), d
        parent[a] = parent[b] = new
        size.append(size[a] + size[b])
    members, birth, tree, points = {}, {}, {}, {}

    def leaves(node: int) -> list[int]:
        stack, out = [node], []
        while stack:
            v = stack.pop()
            stack.extend(kids[v]) if v >= n else out.append(v)
        return out

    todo = [(2 * n - 2, 0)]
    birth[0], tree[0], points[0] = 0.0, [], []
    fresh = 1
    while todo:
        node, cluster = todo.pop()
        if node < n:
            points[cluster].append((node, np.inf))
            continue
        lam = 1 / height[node] if height[node] > 0 else np.inf
        big = [c for c in kids[node] if size[c] >= config.min_cluster_size]
        if len(big) == 2:
            for c in big:
                birth[fresh], tree[fresh], points[fresh] = lam, [], []
                tree[cluster].append(fresh)
                todo.append((c, fresh))
                fresh += 1
            points[cluster] += [(p, lam) for c in kids[node] for p in ()]
            members.setdefault(cluster, lam)
        else:
            for c in kids[node]:
                if c in big:
                    todo.append((c, cluster))
                else:
                    points[cluster] += [(p, lam) for p in leaves(c)]
    below: dict[int, tuple[int, int]] = {}  # rows and smallest row of each cluster
    for c in sorted(tree, reverse=True):
        inner = [below[child] for child in tree[c]]
        below[c] = (len(points[c]) + sum(k for k, _ in inner), min([p for p, _ in points[c]] + [p for _, p in inner], default=n))
    stable = {}
    for c in tree:
        own = sum(min(lam, 1e12) - birth[c] for _, lam in points[c])
        stable[c] = own + sum((birth[child] - birth[c]) * below[child][0] for child in tree[c])
    if config.method == "leaf":
        chosen = [c for c in tree if not tree[c] and c]
    else:
        keep = {}
        for c in sorted(tree, reverse=True):
            inner = sum(stable[child] for child in tree[c])
            if c and (not tree[c] or stable[c] >= inner):
                keep[c] = True
            else:
                keep[c], stable[c] = False, max(inner, 0)
        chosen, stack = [], [0]
        while stack:
            c = stack.pop()
            if keep[c]:
                chosen.append(c)
            else:
                stack.extend(tree[c])
    labels, probability = np.full(n, -1), np.zeros(n)
    for label, c in enumerate(sorted(chosen, key=lambda c: below[c][1])):
        lam = {}
        stack = [c]
        while stack:
            v = stack.pop()
            lam |= {p: min(x_, 1e12) for p, x_ in points[v]}
            stack.extend(tree[v])
        top = max(lam.values())
        for p, v in lam.items():
            labels[p], probability[p] = label, v / top if top > 0 else 1.0
    return labels, probability


def _pairs(blocks: DataFrame) -> DataFrame:
    """Every unordered pair of blocks once, columns prefixed ``a_`` and ``b_``."""
    n = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    side = lambda p: blocks.select(*[F.col(c).alias(f"{p}_{c}") for c in blocks.columns])
    return side("a").repartition(n, "a_block").join(side("b"), F.col("a_block") <= F.col("b_block"))


def _distances(a: bytes, b: bytes, n_a: int, n_b: int):
    import numpy as np

    return np.sqrt(np.maximum(0, 2 - 2 * (np.frombuffer(a).reshape(n_a, -1) @ np.frombuffer(b).reshape(n_b, -1).T)))


def _core_distances(blocks: DataFrame, k: int) -> DataFrame:
    """(block, core): distance of each row to its k-th neighbour, rows in block order."""

    def near(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                d = _distances(r["a_vectors"], r["b_vectors"], len(r["a_ids"]) // 8, len(r["b_ids"]) // 8)
                for block, m in [(r["a_block"], d)] + ([(r["b_block"], d.T)] if r["a_block"] != r["b_block"] else []):
                    least = np.partition(m, k, axis=1)[:, : k + 1] if m.shape[1] > k + 1 else m
                    least = np.pad(least, ((0, 0), (0, k + 1 - least.shape[1])), constant_values=np.inf)
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([np.ascontiguousarray(least).tobytes()], pa.binary())], names=["block", "least"])

    def merge(table):
        import numpy as np
        import pyarrow as pa

        m = np.concatenate([np.frombuffer(x).reshape(-1, k + 1) for x in table.column("least").to_pylist()], axis=1)
        return pa.table({"block": table.column("block")[:1], "core": pa.array([np.partition(m, k, axis=1)[:, k].tobytes()], pa.binary())})

    return _pairs(blocks).mapInArrow(near, "block long, least binary").groupBy("block").applyInArrow(merge, "block long, core binary")


def _nearest_outside(blocks: DataFrame) -> DataFrame:
    """(comp, e): the least edge out of each component by mutual reachability, ties by ids."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                (ai, ac, ak), (bi, bc, bk) = [(np.frombuffer(r[f"{s}_ids"], np.int64), np.frombuffer(r[f"{s}_core"]), np.array(r[f"{s}_comp"], np.int64)) for s in "ab"]
                d = np.maximum(np.maximum(_distances(r["a_vectors"], r["b_vectors"], len(ai), len(bi)), ac[:, None]), bc[None, :])
                d[ak[:, None] == bk[None, :]] = np.inf
                out = []
                for m, ids, comp, o_ids, o_comp in [(d, ai, ak, bi, bk), (d.T, bi, bk, ai, ak)]:
                    at = np.argmin(m, axis=1)  # rows of a block are in the order of ids
                    w = m[np.arange(len(ids)), at]
                    lo, hi = np.minimum(ids, o_ids[at]), np.maximum(ids, o_ids[at])
                    order = np.lexsort((hi, lo, w, comp))
                    first = order[np.r_[True, comp[order][1:] != comp[order][:-1]]]
                    first = first[np.isfinite(w[first])]
                    out.append((comp[first], w[first], lo[first], hi[first], o_comp[at][first]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["comp", "w", "lo", "hi", "other"])

    met = _pairs(blocks).mapInArrow(run, "comp long, w double, lo long, hi long, other long")
    return met.groupBy("comp").agg(F.min(F.struct("w", "lo", "hi", "other")).alias("e"))


def _contract(table):
    """One round's edges united: the new component of each, and whether its edge was new."""
    import pyarrow as pa

    rows = sorted(table.to_pylist(), key=lambda r: (r["w"], r["lo"], r["hi"]))
    parent = {r["comp"]: r["comp"] for r in rows}

    def root(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    used = []
    for r in rows:
        a, b = root(r["comp"]), root(r["other"])
        used.append(a != b)
        parent[max(a, b)] = min(a, b)
    col = lambda c, t: pa.array([r[c] for r in rows], t)
    return pa.table({"comp": col("comp", pa.int64()), "root": pa.array([root(r["comp"]) for r in rows], pa.int64()), "w": col("w", pa.float64()), "lo": col("lo", pa.int64()), "hi": col("hi", pa.int64()), "used": pa.array(used, pa.bool_())})


def spanning_tree(rows: DataFrame, n: int, config: DensityConfig, block_rows: int = 2048) -> DataFrame:
    """(w, lo, hi): edges of a minimum spanning tree of mutual reachability over the ``n``
    rows (id, v), by rounds in which every component takes its least edge outward. All
    pairs meet in blocks across tasks; one task holds one edge a component, no vectors."""
    blocks = materialize(_packed(rows.orderBy("id"), "id", "v", block_rows), "density-blocks")
    if blocks.agg(F.sum(F.length("ids") / 8)).head()[0] != n:
        raise ValueError("vectors must not be empty or hold nulls")
    blocks = materialize(blocks.join(_core_distances(blocks, min(config.min_samples, n - 1)), "block"), "density-core")
    unpack = "block long, id long"

    def ids_of(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for block, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = np.frombuffer(ids, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), block)), pa.array(found)], names=["block", "id"])

    comps = blocks.select("block", "ids").mapInArrow(ids_of, unpack).withColumn("comp", F.col("id"))
    edges = None
    while True:
        packed = comps.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "comp"))), lambda x: x["comp"]).alias("comp"))
        least = _nearest_outside(blocks.join(packed, "block")).select("comp", "e.*", F.lit(0).alias("one"))
        step = materialize(least.groupBy("one").applyInArrow(_contract, "comp long, root long, w double, lo long, hi long, used boolean"), "density-step")
        found = step.where("used").select("w", "lo", "hi")
        edges = found if edges is None else edges.unionByName(found)
        if step.select("root").distinct().count() == 1:
            return edges
        comps = materialize(comps.join(step.select("comp", "root"), "comp").select("block", "id", F.col("root").alias("comp")), "density-comps")


def density_clusters(df: DataFrame, id_column: str, vector_column: str, config: DensityConfig = DensityConfig()) -> DataFrame:
    """(id, cluster_id, is_noise, membership_probability) of all vectors, one row per id.

    Up to ``max_rows`` rows meet in one task; of more, the spanning tree is found in
    blocks across tasks, and one task cuts the tree, holding its edges and no vectors.
    Where distances tie, the two ways may take different edges of the same length.
    """
    rows = df.select(F.col(id_column).cast("bigint").alias("id"), F.col(vector_column).alias("v")).where("id is not null and v is not null").dropDuplicates(["id"])
    shape = "id bigint, cluster_id int, is_noise boolean, membership_probability double"

    def result(ids, labels, probability):
        import pyarrow as pa

        return pa.table({"id": ids, "cluster_id": pa.array(labels, pa.int32()), "is_noise": pa.array(labels == -1), "membership_probability": pa.array(probability, pa.float64())})

    def run(table):
        import numpy as np
        import pyarrow as pa

        order = np.argsort(table.column("id").to_numpy())
        table = table.take(pa.array(order))
        return result(table.column("id"), *density_labels(table.column("v").to_pylist(), config))

    def cut(table):
        import numpy as np
        import pyarrow as pa

        w, lo, hi = (table.column(c).to_numpy() for c in ("w", "lo", "hi"))
        ids = np.unique(np.concatenate([lo, hi]))
        edges = list(zip(w.tolist(), np.searchsorted(ids, lo).tolist(), np.searchsorted(ids, hi).tolist()))
        return result(pa.array(ids), *_tree_labels(edges, len(ids), config))

    if rows.select("id").limit(config.max_rows + 1).count() <= config.max_rows:
        return rows.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(run, shape)
    rows = materialize(rows, "density-rows")
    n = rows.count()
    if n < 3:
        raise ValueError("at least three rows are needed")
    return spanning_tree(rows, n, config).withColumn("one", F.lit(0)).groupBy("one").applyInArrow(cut, shape)
