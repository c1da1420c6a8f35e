"""Filling fixed-capacity containers with items of varying length.

Lengths are at most the capacity, so their histogram is small whatever the
number of items. Dynamic programming over it chooses the bucket boundaries
with the least padding. Batches form inside each bucket: as many items at the
bucket's upper bound as the capacity allows, and what room that leaves is
offered to the smaller buckets. An item then finds its container from its rank
in its bucket, by arithmetic; items never meet in one place.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

#: Buckets at most, and sub-buckets in which ranks are counted in parallel.
BUCKETS, SUB_BUCKETS = 128, 256


def items(sizes: DataFrame, capacity: int, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """``key, piece_no, first, n``: items no larger than a container.

    Only an item above the capacity is split, into full pieces and a rest.
    Items of size 0 or null take no room and are left out.
    """
    pieces = F.sequence(F.lit(0), F.floor((F.col(size) - 1) / capacity).cast("int"))
    return (
        sizes.where(F.col(size) > 0)
        .select(key, size, F.explode(pieces).alias("piece_no"))
        .select(key, "piece_no", (F.col("piece_no") * capacity).alias("first"), F.least(F.lit(capacity), F.col(size) - F.col("piece_no") * capacity).alias("n"))
    )


def _layer(best: np.ndarray, s: np.ndarray, count: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every j the least of ``best[i]`` and the padding of the sizes i..j-1, and that i.

    The best i never falls as j grows, so each j halves the choice of those beside it: all j of
    one depth are looked at together, over as many i as there are sizes.
    """
    n = len(s)
    least, arg = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
    lo, hi, first, last = (np.array([x]) for x in (1, n, 0, n - 1))
    while len(lo):
        mid = (lo + hi) // 2
        length = np.minimum(last, mid - 1) - first + 1
        at = np.cumsum(length) - length
        i = np.arange(length.sum()) - np.repeat(at - first, length)
        j = np.repeat(mid, length)
        value = best[i] + s[j - 1] * (count[j] - count[i]) - (total[j] - total[i])
        low = np.minimum.reduceat(value, at)
        hit = np.flatnonzero(value == np.repeat(low, length))
        chosen = i[hit[np.searchsorted(hit, at)]]
        least[mid], arg[mid] = low, chosen
        lo, hi, first, last = np.concatenate([lo, mid + 1]), np.concatenate([mid - 1, hi]), np.concatenate([first, chosen]), np.concatenate([chosen, last])
        some = lo <= hi
        lo, hi, first, last = lo[some], hi[some], first[some], last[some]
    return least, arg


def bucket_bounds(histogram: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of the buckets that pad all items with the fewest tokens in total.

    Takes ``buckets`` integers of memory per distinct size, and time in proportion to that and a logarithm.
    """
    s = np.array(sorted(histogram), dtype=np.int64)
    if not len(s):
        return []
    each = np.array([histogram[x] for x in s.tolist()], dtype=np.float64)
    count, total = (np.concatenate([[0.0], np.cumsum(x)]) for x in (each, each * s))
    best = np.concatenate([[np.inf], s * count[1:] - total[1:]])
    back: list[np.ndarray] = []
    for _ in range(min(buckets, len(s)) - 1):
        least, arg = _layer(best, s, count, total)
        better = least < best
        if not better.any():
            break
        back.append(np.where(better, arg, -1).astype(np.int32))
        best = np.where(better, least, best)
    out, j = [], len(s)
    for b in [*reversed(back), None]:
        if b is not None and b[j] < 0:
            continue
        out.append(int(s[j - 1]))
        j = int(b[j]) if b is not None else 0
        if j == 0:
            break
    return out[::-1]


def container_plan(bounds: list[int], counts: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Per bucket the steps ``(rank from which it holds, items per container, first container)``.

    A pattern takes a batch of the largest bucket that has items left and fills
    its remaining room from smaller buckets; it repeats while its items last.
    """
    left, used = list(counts), [0] * len(counts)
    steps: list[list[tuple[int, int, int]]] = [[] for _ in counts]
    container = 0
    for b in reversed(range(len(bounds))):
        while left[b]:
            room, take = capacity, {}
            for k in range(b, -1, -1):
                n = min(left[k], room // bounds[k])
                if n:
                    take[k], room = n, room - n * bounds[k]
            times = min(left[k] // n for k, n in take.items())
            for k, n in take.items():
                steps[k].append((used[k], n, container))
                used[k] += n * times
                left[k] -= n * times
            container += times
    return steps


def pack(sizes: DataFrame, capacity: int, key: str = "doc_id", size: str = "n_tokens", buckets: int = BUCKETS) -> DataFrame:
    """``container_id, bucket, key, piece_no, first, n`` of every item.

    No container holds more than ``capacity``. Ties are ordered by key. No items
    give no containers. ``sizes`` is read three times; hand over a saved table.
    """
    spark = sizes.sparkSession
    it = items(sizes, capacity, key, size)
    histogram = {r["n"]: r["count"] for r in it.groupBy("n").count().collect()}  # capacity rows at most
    bounds = bucket_bounds(histogram, buckets)
    at = np.searchsorted(bounds, sorted(histogram)) if bounds else []
    counts = [0] * len(bounds)
    for b, s in zip(at, sorted(histogram)):
        counts[b] += histogram[s]
    steps = container_plan(bounds, counts, capacity)
    plan = spark.createDataFrame(
        [(b, *(list(x) for x in zip(*s))) for b, s in enumerate(steps) if s],
        "bucket int, starts array<long>, per array<long>, firsts array<long>",
    )
    bucket_of = spark.createDataFrame([(s, int(b)) for s, b in zip(sorted(histogram), at)], "n int, bucket int")
    it = it.join(F.broadcast(bucket_of), "n").withColumn("sub", F.pmod(F.xxhash64(key, "piece_no"), F.lit(SUB_BUCKETS)))
    cells = it.groupBy("bucket", "sub").count()  # BUCKETS * SUB_BUCKETS rows at most
    before = F.sum("count").over(W.partitionBy("bucket").orderBy("sub").rowsBetween(W.unboundedPreceding, -1))
    cells = cells.select("bucket", "sub", F.coalesce(before, F.lit(0)).alias("before"))
    in_cell = F.row_number().over(W.partitionBy("bucket", "sub").orderBy(key, "piece_no"))
    ranked = it.withColumn("in_cell", in_cell).join(F.broadcast(cells), ["bucket", "sub"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("in_cell") - 1).join(F.broadcast(plan), "bucket")
    step = F.size(F.filter("starts", lambda x: x <= F.col("rank")))
    pick = lambda c: F.element_at(c, F.col("step"))
    return ranked.withColumn("step", step).select(
        (pick("firsts") + F.floor((F.col("rank") - pick("starts")) / pick("per"))).alias("container_id"),
        "bucket", key, "piece_no", "first", "n",
    )
