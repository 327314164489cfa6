"""Problem 8: filling containers of fixed capacity, by optimal length buckets.

Sizes are reduced to one global histogram (a row per distinct size, at most the capacity). Dynamic programming over it
chooses the bucket boundaries that minimise padding, that is the sum over all items of bucket boundary minus size. Inside
each bucket token-budget batches form: a container takes as many items of its bucket as the capacity holds, and the room
that is left takes items of the lower buckets by the same rule, largest first. All containers of one composition form
together, so the plan has a few rows a bucket however many items there are; items find their container by their rank
in their bucket.

An item above the capacity is cut into full containers and one rest, which is packed like an item; no other item is ever
cut. Defined cases: items of size 0 (null and empty texts) take no room and go to container 0 of their capacity. An
empty table gives an empty result. Repeated rows are packed as often as they occur. Null capacities are ignored.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.operators.skew import balanced_rank
from quillstone.session import cut

#: Buckets of one capacity; more buckets mean less padding and a longer plan.
BUCKETS = 128
#: Items one ranking task sees at most, about: the number of slices grows with the items.
SLICE_ROWS = 1_000_000


def bucket_bounds(sizes: np.ndarray, counts: np.ndarray, k: int) -> list[int]:
    """Upper bounds of at most ``k`` buckets with least total padding, by dynamic programming over the histogram.

    Best beginnings of last buckets rise with their ends (the cost satisfies the quadrangle inequality), so each layer halves
    the range of ends and of beginnings level by level: k * m * log(m) steps for m sizes, vectorised by level.
    """
    m = len(sizes)
    if m <= k:
        return sizes.tolist()
    size = sizes.astype(np.float64)
    n = np.concatenate([[0], np.cumsum(counts)]).astype(np.float64)
    w = np.concatenate([[0], np.cumsum(counts * size)])
    # cost of the bucket of sizes i..j with bound sizes[j]
    best = size * n[1:] - w[1:]
    choice = np.tile(np.arange(m, dtype=np.int32), (k, 1))
    choice[0] = 0
    for b in range(1, k):
        new = best.copy()
        # ends from..to whose best beginnings lie within low..high
        start, stop, low, high = (np.array([x]) for x in (b, m - 1, b, m - 1))
        while len(start):
            j = (start + stop) // 2
            top = np.minimum(high, j)
            length = top - low + 1
            first = np.concatenate([[0], np.cumsum(length)[:-1]])
            part = np.repeat(np.arange(len(j)), length)
            i = np.arange(len(part)) - first[part] + low[part]
            cost = best[i - 1] + size[j[part]] * (n[j[part] + 1] - n[i]) - (w[j[part] + 1] - w[i])
            least = np.minimum.reduceat(cost, first)
            at = np.flatnonzero(cost == least[part])
            at = i[at[np.unique(part[at], return_index=True)[1]]]
            new[j], choice[b, j] = least, at
            start, stop, low, high = (np.concatenate(x) for x in ((start, j + 1), (j - 1, stop), (low, at), (at, high)))
            keep = start <= stop
            start, stop, low, high = start[keep], stop[keep], low[keep], high[keep]
        best = new
    out, j = [], m - 1
    for b in range(k - 1, -1, -1):
        out.append(int(sizes[j]))
        j = int(choice[b, j]) - 1
        if j < 0:
            break
    return sorted(set(out))


def container_plan(bounds: list[int], counts: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (bucket, from rank, to rank, first container, items of the bucket a container) that pack all items."""
    left = list(counts)
    used = [0] * len(bounds)
    plan, container = [], 0
    for top in range(len(bounds) - 1, -1, -1):
        while left[top]:
            room, parts, times = capacity, [], None
            b = top
            while b >= 0:
                take = min(room // bounds[b], left[b])
                if take:
                    parts.append((b, take))
                    room -= take * bounds[b]
                b = min(b - 1, bisect_left(bounds, room + 1) - 1)
            times = max(1, min(left[b] // take for b, take in parts))
            for b, take in parts:
                plan.append((b, used[b], used[b] + take * times, container, take))
                used[b] += take * times
                left[b] -= take * times
            container += times
    return plan


def pack(items: DataFrame, id_col: str, size_col: str, capacity: int, buckets: int = BUCKETS) -> DataFrame:
    """(id, part, size, container) of all items for one capacity; ``part`` numbers the pieces of cut items."""
    spark = items.sparkSession
    rows = items.select(F.col(id_col).alias("id"), F.coalesce(F.col(size_col).cast("long"), F.lit(0)).alias("size"))
    cap = F.lit(capacity).cast("long")
    whole = rows.where(F.col("size") > capacity).select(
        "id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / cap).cast("long"))).alias("part"), "size"
    )
    whole = whole.select("id", "part", F.least(cap, F.col("size") - F.col("part") * cap).alias("size"))
    pieces = rows.where(F.col("size") <= capacity).select("id", F.lit(0).cast("long").alias("part"), "size").unionByName(whole)
    hist = pieces.where("size > 0").groupBy("size").agg(F.count("*").alias("n")).orderBy("size").collect()  # <= capacity rows
    empty = pieces.where("size = 0").select("id", "part", "size", F.lit(0).cast("long").alias("container"))
    if not hist:
        return empty
    sizes, counts = np.array([r["size"] for r in hist]), np.array([r["n"] for r in hist])
    bounds = bucket_bounds(sizes, counts, buckets)
    where = np.searchsorted(bounds, sizes)
    per = np.bincount(where, weights=counts, minlength=len(bounds)).astype(np.int64).tolist()
    plan = container_plan(bounds, per, capacity)
    table = spark.createDataFrame(plan, "bucket int, lo long, hi long, first long, take long")
    # bounded by the capacity: one entry a distinct size
    of_size = spark.createDataFrame(
        list(zip(sizes.tolist(), where.tolist(), strict=True)), "size long, bucket int"
    )
    placed = pieces.where("size > 0").join(F.broadcast(of_size), "size")
    slices = max(64, -(-int(counts.sum()) // SLICE_ROWS))
    ranked = balanced_rank(placed, ["bucket"], ["id", "part"], "rk", slices)
    by_bucket = table.groupBy("bucket").agg(
        F.array_sort(F.collect_list(F.struct("lo", "hi", "first", "take"))).alias("spans")
    )
    joined = ranked.join(F.broadcast(by_bucket), "bucket")
    span = F.filter("spans", lambda x: (x["lo"] <= F.col("rk")) & (F.col("rk") < x["hi"]))[0]
    joined = joined.select("id", "part", "size", "rk", span.alias("s"))
    container = F.col("s.first") + F.floor((F.col("rk") - F.col("s.lo")) / F.col("s.take"))
    return joined.select("id", "part", "size", container.cast("long").alias("container")).unionByName(empty)


def pack_all(items: DataFrame, id_col: str, size_col: str, capacities: list[int], **kw) -> DataFrame:
    """(capacity, id, part, size, container) for each capacity; the table of items is materialised once."""
    items = cut(items.select(id_col, size_col), "sizes")
    out = None
    for c in sorted({c for c in capacities if c is not None}):
        one = pack(items, id_col, size_col, c, **kw).select(F.lit(c).cast("long").alias("capacity"), F.col("id").alias(id_col), "part", "size", "container")
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = items.select(F.lit(0).cast("long").alias("capacity"), id_col, F.lit(0).cast("long").alias("part"), F.col(size_col).alias("size"), F.lit(0).cast("long").alias("container")).where(F.lit(False))
    return out
