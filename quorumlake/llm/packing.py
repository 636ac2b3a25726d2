"""Packing items of varying length into containers of fixed capacity.

Items longer than a container are cut into full containers and a rest; full
pieces are containers of their own and never leave the JVM. The others are dealt
to shards of a bounded number of tokens. In a shard the cost of an item is
estimated as a linear plus a quadratic (attention) term; items are taken in
descending order and each goes to the sequence of the lowest cost so far that has
room for it. So the containers fill evenly in cost and tightly in tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKED = "container string, slot bigint, item_id bigint, piece bigint, first_token bigint, n_tokens bigint, container_tokens bigint"


def assign(sizes: list[int], capacity: int, linear: float = 1.0, quadratic: float = 1e-3, start: int | None = None) -> list[int]:
    """Container index of each item of ``sizes`` (which must be descending).

    ``start`` sequences are open from the beginning: by default as many as the
    tokens need at least. An item goes to the sequence of the lowest cost with
    room; a new one is opened when none has room. Among sequences with the same
    room only the cheapest matters, so they are kept in heaps by room, and a tree
    over the rooms finds the cheapest room that suffices in O(log capacity).
    """
    from heapq import heappop, heappush

    n = max(1, -(-sum(sizes) // capacity)) if start is None else max(start, 0)
    top = 1 << capacity.bit_length()
    inf = (float("inf"), -1)
    heaps: list[list] = [[] for _ in range(capacity + 1)]
    tree = [inf] * (2 * top)

    def put(room: int) -> None:
        i = top + room
        tree[i] = heaps[room][0] if heaps[room] else inf
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a <= b else b
            i >>= 1

    rooms = [capacity] * n
    heaps[capacity] = [(0.0, k) for k in range(n)]
    put(capacity)
    out = []
    for size in sizes:
        best, lo, hi = inf, top + size, top + capacity + 1
        while lo < hi:
            if lo & 1:
                best = min(best, tree[lo])
                lo += 1
            if hi & 1:
                hi -= 1
                best = min(best, tree[hi])
            lo >>= 1
            hi >>= 1
        if best[1] < 0:
            k, cost = len(rooms), 0.0
            rooms.append(capacity)
        else:
            cost, k = best
            heappop(heaps[rooms[k]])
            put(rooms[k])
        rooms[k] -= size
        heappush(heaps[rooms[k]], (cost + linear * size + quadratic * size * size, k))
        put(rooms[k])
        out.append(k)
    return out


def best_assignment(sizes: list[int], capacity: int) -> list[int]:
    """The cost-balanced assignment with the fewest containers over a few numbers of
    sequences to start with: fewer open sequences leave less room unused at the end."""
    need = max(1, -(-sum(sizes) // capacity))
    best = None
    for start in (need, need - max(1, need // 50), need - max(1, need // 10), need // 2, 0):
        got = assign(sizes, capacity, start=max(start, 0))
        used = len(set(got))
        if best is None or used < best[0]:
            best = (used, got)
        if used <= need:
            break
    return best[1]


def pack_items(items: DataFrame, id_column: str, size_column: str, capacity: int, shard_tokens: int = 2_000_000) -> DataFrame:
    """Containers and order of all items: rows (container, slot, item_id, piece,
    first_token, n_tokens, container_tokens).

    Items of no tokens (null, 0 or less) need no room and are slots of length 0 in a
    container of their shard; repeated rows are items of their own only if their ids
    differ (an id is packed once, with its largest size). Shards are formed by hash, so
    every shard sees the same mix of sizes, and hold about ``shard_tokens``: by default
    about a thousand containers, packed by one task. A shard may need a container more
    than its tokens, one in a thousand; a larger shard loses less and takes longer.
    """
    sized = items.where(F.col(id_column).isNotNull()).groupBy(F.col(id_column).cast("bigint").alias("item_id")).agg(F.greatest(F.max(F.col(size_column).cast("bigint")), F.lit(0)).cast("bigint").alias("size")).fillna(0, ["size"])
    total = sized.agg(F.sum("size")).head()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    pieces = sized.select("item_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.floor((F.col("size") - 1) / capacity), F.lit(0)))).alias("piece"), "size")
    pieces = pieces.select("item_id", "piece", (F.col("piece") * capacity).alias("first_token"), F.least(F.lit(capacity), F.col("size") - F.col("piece") * capacity).cast("bigint").alias("n_tokens"))
    full = pieces.where(F.col("n_tokens") == capacity).select(
        F.concat(F.lit("f"), "item_id", F.lit("/"), "piece").alias("container"), F.lit(0).cast("bigint").alias("slot"), "item_id", "piece", "first_token", "n_tokens", F.lit(capacity).cast("bigint").alias("container_tokens")
    )
    rest = pieces.where(F.col("n_tokens") < capacity).withColumn("shard", F.pmod(F.xxhash64("item_id", "piece"), F.lit(shards)).cast("int"))

    def pack(table):
        import numpy as np
        import pyarrow as pa

        from quorumlake.llm.packing import best_assignment as place

        size = table.column("n_tokens").to_numpy()
        ids, piece = table.column("item_id").to_numpy(), table.column("piece").to_numpy()
        order = np.lexsort((piece, ids, -size))
        where = np.array(place(size[order].tolist(), capacity), dtype=np.int64)
        by = np.argsort(where, kind="stable")
        where, order = where[by], order[by]
        begins = np.r_[0, np.nonzero(np.diff(where))[0] + 1]
        counts = np.diff(np.r_[begins, len(where)])
        slot = np.arange(len(where)) - np.repeat(begins, counts)
        filled = np.repeat(np.add.reduceat(size[order], begins), counts)
        shard = table.column("shard")[0].as_py()
        return pa.table(
            {
                "container": pa.array([f"s{shard}/{k}" for k in where.tolist()], pa.string()),
                "slot": pa.array(slot, pa.int64()),
                "item_id": pa.array(ids[order], pa.int64()),
                "piece": pa.array(piece[order], pa.int64()),
                "first_token": pa.array(table.column("first_token").to_numpy()[order], pa.int64()),
                "n_tokens": pa.array(size[order], pa.int64()),
                "container_tokens": pa.array(filled, pa.int64()),
            }
        )

    return full.unionByName(rest.repartition(shards, "shard").groupBy("shard").applyInArrow(pack, PACKED))
