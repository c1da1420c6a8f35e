"""Most similar vectors by a permutation index.

A vector is represented by its nearest pivots in order of nearness. It is posted
in the inverted files of its first pivots, and asks in the file of its nearest
one (of its nearest few, for the nearest neighbours). Who asks in a file and who
is posted there are ranked by the footrule distance of their pivot orders; only
what is near by that is ranked again by cosine similarity.

A posting carries the pivot order and a short code of the unit vector, so a file
is worked through where it lies and no vector is fetched pair by pair. Files
longer than ``BLOCK`` are cut into blocks and every pair of blocks is a task of
its own, so no file is gathered.

Equal vectors are indexed once and their keys joined back at the end, and no
pivot is much like another, so that copies of a vector, or a dense cluster,
cannot fill the pivot orders around it with ties.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from loamdex.session import Stages

#: Length of the pivot order that is kept; the footrule sums stay below 256 up to 22.
ORDER = 20
#: Pivots per dimension: four times the square root of the number of vectors, within these bounds. The
#: upper one bounds what is broadcast; it is reached at 16.8 million vectors, beyond which files grow.
LEAST_PIVOTS, MOST_PIVOTS = 64, 16384
#: A pivot has a lower cosine than this to every other; so many vectors are looked at per pivot wanted.
ALIKE, CANDIDATES = 0.9, 4
#: Postings of a file that one task compares with so many askers, and askers that are compared at a time.
BLOCK, STRIP = 4096, 256
#: Keys of one vector in a list, and parts that such lists are made into pairs in.
KEYS, SPREAD = 1024, 64


def usable(vectors: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``key, dim, embedding`` whose array has dim elements, none null or NaN, and not all zero."""
    e = F.col("embedding")
    fit = (F.size(e) == F.col("dim")) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x)) & F.exists(e, lambda x: x != 0)
    return vectors.where(F.col(key).isNotNull() & (F.col("dim") > 0) & F.coalesce(fit, F.lit(False))).select(key, "dim", "embedding")


def _named(vectors: DataFrame, key: str) -> DataFrame:
    """``rid, key, dim, embedding``: ``rid`` is a hash of 64 bits of the vector, so that copies need no join to be numbered."""
    return usable(vectors, key).withColumn("rid", F.xxhash64("dim", "embedding"))


def choose_pivots(named: DataFrame, members: DataFrame) -> dict[int, np.ndarray]:
    """Per dim, which ``members`` counts, a sample of the distinct vectors, ``MOST_PIVOTS`` at most, as unit rows.

    The sample is what hashes below a share, so nothing is sorted and the driver gets
    ``CANDIDATES`` vectors for each pivot wanted.
    """
    counted = members.groupBy("dim").agg(F.approx_count_distinct("rid", 0.02).alias("n")).collect()  # a row per dim
    most = {r["dim"]: min(MOST_PIVOTS, max(LEAST_PIVOTS, math.ceil(4 * math.sqrt(r["n"])))) for r in counted}
    if not most:
        return {}
    share = F.lit(0.0)
    for r in counted:
        share = F.when(F.col("dim") == r["dim"], min(1.0, CANDIDATES * most[r["dim"]] / r["n"])).otherwise(share)
    h = F.xxhash64("rid", F.lit("pivot"))
    sample = named.where(F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53)) <= share).select("dim", "rid", h.alias("h"), "embedding")
    rows = sample.dropDuplicates(["rid"]).toPandas().sort_values(["dim", "h", "rid"])
    return {int(d): _apart(_unit(np.stack(g["embedding"].to_numpy())), most[d]) for d, g in rows.groupby("dim")}


def _apart(x: np.ndarray, most: int) -> np.ndarray:
    """The first ``most`` rows that are not ``ALIKE`` to an earlier one; with less than ``ORDER`` of these, further rows.

    So few pivots are no loss: of ``ORDER`` pivots any two vectors share enough to meet.
    """
    kept: list[int] = []
    for s in range(0, len(x), 256):
        part = x[s : s + 256]
        free = (part @ x[kept].T < ALIKE).all(axis=1) if kept else np.ones(len(part), dtype=bool)
        own = part @ part.T
        for i in range(len(part)):
            if free[i] and len(kept) < most:
                kept.append(s + i)
                free &= own[i] < ALIKE
    if len(kept) < ORDER:
        kept += [i for i in range(len(x)) if i not in set(kept)][: ORDER - len(kept)]
    return x[kept]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _as_bytes(x: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Unit vectors in a byte per number: codes, scale, and how far what they stand for is from the vector."""
    scale = (np.abs(x).max(axis=1) / 127).astype(np.float32)
    code = np.rint(x / scale[:, None]).astype(np.int8)
    return [r.tobytes() for r in code], scale, np.linalg.norm(x - code * scale[:, None], axis=1).astype(np.float32) + np.float32(1e-6)


def _as_halves(x: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The same in half precision."""
    code = x.astype(np.float16)
    return [r.tobytes() for r in code], np.ones(len(x), np.float32), np.linalg.norm(x - code, axis=1).astype(np.float32)


def build_index(vectors: DataFrame, st: Stages, key: str, posted: int, encode: Callable, reach: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Saved tables ``rid, files, pivots, code, scale, err`` of every distinct usable vector, and ``rid, key`` of who has it.

    ``files`` are those of the first ``posted`` pivots, nearest first; with ``reach`` those of all
    pivots whose angle is at most ``reach`` above that of the nearest.
    """
    named = _named(vectors, key)
    members = st.save(named.select("rid", key, "dim").distinct())
    pivots = vectors.sparkSession.sparkContext.broadcast(choose_pivots(named, members))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, g in b.groupby("dim"):
                x = _unit(np.stack(g["embedding"].to_numpy()))
                p = pivots.value[int(dim)]
                near, n = x @ p.T, min(ORDER, len(p))
                first = np.argpartition(-near, n - 1, axis=1)[:, :n]
                order = np.argsort(-np.take_along_axis(near, first, 1), axis=1, kind="stable")
                order = np.take_along_axis(first, order, 1).astype(np.int16)
                base = int(dim) << 32
                if reach is None:
                    files = list(base + order[:, :posted].astype(np.int64))
                else:
                    angle = np.arccos(np.clip(near, -1, 1))
                    ok = angle <= angle.min(axis=1, keepdims=True) + reach + 1e-3
                    ok[np.arange(len(x)), order[:, 0]] = False  # goes first
                    files = [base + np.concatenate([o[:1].astype(np.int64), np.flatnonzero(k)]) for o, k in zip(order, ok)]
                code, scale, err = encode(x)
                yield pd.DataFrame({"rid": g["rid"].to_numpy(), "files": files, "pivots": [o.tobytes() for o in order], "code": code, "scale": scale, "err": err})

    rows = named.select("rid", "dim", "embedding").mapInPandas(run, "rid long, files array<long>, pivots binary, code binary, scale float, err float")
    return st.save(rows.dropDuplicates(["rid"])), members.drop("dim")


def _blocks(members: DataFrame, key: str) -> DataFrame:
    """``rid, blocks, block, keys``: who has a vector, in lists of about ``KEYS`` keys."""
    long_lists = members.groupBy("rid").count().where(F.col("count") > KEYS).select("rid", F.ceil(F.col("count") / KEYS).cast("int").alias("blocks"))
    m = members.join(long_lists, "rid", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    return m.groupBy("rid", "blocks", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int").alias("block")).agg(F.collect_list(key).alias("keys"))


def tiles(index: DataFrame, asked: int) -> DataFrame:
    """``file, i, j, role`` and the columns of the index: each posting in each tile it takes part in.

    A vector asks in its first ``asked`` files (role 1) and is posted in all (role 2; 3 is both).
    Tile (i, j) of a file holds block i of who asks and block j of who is posted.
    """
    p = index.select(F.posexplode("files").alias("at", "file"), "rid", "pivots", "code", "scale", "err").withColumn("asks", F.col("at") < asked)
    sizes = p.groupBy("file").agg(F.ceil(F.count(F.when(F.col("asks"), 1)) / BLOCK).cast("int").alias("bi"), F.ceil(F.count("*") / BLOCK).cast("int").alias("bj"))
    long_files = sizes.where("bj > 1")  # no more rows than there are pivots
    p = p.join(F.broadcast(long_files), "file", "left")
    mine = lambda n, seed: F.pmod(F.xxhash64("rid", F.lit(seed)), F.greatest(n, F.lit(1))).cast("int")
    tile = lambda i, j, role: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), role.alias("role"))
    zero, bi, bj = F.lit(0), F.col("bi"), F.col("bj")
    posted = F.transform(F.sequence(zero, F.greatest(bi - 1, zero)), lambda i: tile(i, mine(bj, 2), F.lit(2)))
    asking = F.transform(F.sequence(zero, bj - 1), lambda j: tile(mine(bi, 1), j, F.lit(1)))
    whole = F.array(tile(zero, zero, F.when(F.col("asks"), 3).otherwise(2)))
    every = F.when(bj.isNull(), whole).when(F.col("asks"), F.concat(posted, asking)).otherwise(posted)
    return p.select("file", F.explode(every).alias("t"), "rid", "pivots", "code", "scale", "err").select("file", "t.*", "rid", "pivots", "code", "scale", "err")


class _Side:
    """Rows of a tile as arrays: ids, pivot orders, what the codes stand for, and how far that is from the unit vectors."""

    def __init__(self, b: pd.DataFrame, halves: bool):
        self.rid = b["rid"].to_numpy()
        self.order = np.frombuffer(b"".join(b["pivots"]), np.int16).reshape(len(b), -1)
        code = np.frombuffer(b"".join(b["code"]), np.float16 if halves else np.int8).reshape(len(b), -1)
        self.x = code.astype(np.float32) * b["scale"].to_numpy()[:, None]
        self.err = b["err"].to_numpy()


def _per_tile(tiled: DataFrame, work: Callable[[int, _Side, _Side], pd.DataFrame | None], halves: bool, schema: str) -> DataFrame:
    """``work`` on who asks and who is posted in each tile; many small tiles share an Arrow batch."""
    by = ["file", "i", "j"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []

        def cut(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
            k, role = b[by].to_numpy(), b["role"].to_numpy()
            at = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
            ends = [0, *at.tolist(), len(b)]
            found = []
            for s, e in zip(ends, ends[1:]):
                asks, posted = (role[s:e] & 1) > 0, (role[s:e] & 2) > 0
                if asks.any() and posted.any() and e - s > 1:
                    t = b.iloc[s:e]
                    got = work(int(k[s, 0]), _Side(t[asks], halves), _Side(t[posted], halves))
                    if got is not None:
                        found.append(got)
            if found:
                yield pd.concat(found, ignore_index=True)

        last = None
        for b in batches:
            if not len(b):
                continue
            k = b[by].to_numpy()
            same = (k == k[-1]).all(axis=1)
            start = len(b) - int(np.argmin(same[::-1])) if not same.all() else 0
            if rest and last is not None and tuple(k[0]) != last:
                yield from cut(pd.concat(rest, ignore_index=True))
                rest = []
            if start:
                yield from cut(pd.concat([*rest, b.iloc[:start]], ignore_index=True))
                rest = []
            rest.append(b.iloc[start:])
            last = tuple(k[-1])
        if rest:
            yield from cut(pd.concat(rest, ignore_index=True))

    return tiled.repartition(*by).sortWithinPartitions(*by).mapInPandas(run, schema)


class Footrule:
    """Footrule distances of pivot orders to those of some askers, as a part of the largest possible.

    An absent pivot has the rank after the last. The distance is the largest possible without, for
    each shared pivot, twice what its lower rank leaves of the order; so a row per shared pivot is
    looked up and added.
    """

    def __init__(self, asking: np.ndarray):
        n = asking.shape[1]
        self.n, self.names = n, np.unique(asking)
        self.left = np.zeros((len(self.names) + 1, len(asking)), np.uint8)
        for j in range(n):
            self.left[np.searchsorted(self.names, asking[:, j]), np.arange(len(asking))] = n - j

    def __call__(self, posted: np.ndarray) -> np.ndarray:
        """A row per posted order, a column per asker."""
        at = np.searchsorted(self.names, posted)
        at[self.names[np.minimum(at, len(self.names) - 1)] != posted] = len(self.names)
        shared = np.zeros((len(posted), self.left.shape[1]), np.uint8)
        for j in range(self.n):
            shared += np.minimum(self.left[at[:, j]], np.uint8(self.n - j))
        return shared

    def least(self, cut: float) -> int:
        """The sum of the shared pivots that a distance of ``cut`` of the largest possible comes from."""
        return math.ceil(self.n * (self.n + 1) * (1 - cut) / 2 - 1e-9)


def similar_pairs(vectors: DataFrame, least: float, key: str = "chunk_id", posted: int = 5, cut: float = 0.37, exact: bool = False) -> DataFrame:
    """``key_a, key_b, cosine`` (a < b by bytes) of the pairs of one dim with a cosine of at least ``least``.

    Made for high thresholds (0.9 and more): the nearest pivot of one vector must be among the
    first ``posted`` of the other, and their footrule distance at most ``cut`` of the largest
    possible. ``exact`` finds every pair: vectors are posted in all files that the triangle
    inequality of angles cannot rule out, and none is left out by its footrule. Any number of
    partners is returned. Unusable vectors have none; a key with several vectors is paired by its
    best one, never with itself.
    """
    st = Stages(vectors.sparkSession, "pairs")
    index, members = build_index(vectors, st, key, posted, _as_bytes, 2 * math.acos(max(-1.0, min(1.0, least))) if exact else None)

    def work(file: int, a: _Side, b: _Side) -> pd.DataFrame | None:
        here, found = file & 0xFFFFFFFF, []
        for s in range(0, len(a.rid), STRIP):
            part = slice(s, s + STRIP)
            if exact:
                y, x = np.indices((len(b.rid), len(a.rid[part]))).reshape(2, -1)
            else:
                far = Footrule(a.order[part])
                y, x = np.nonzero(far(b.order) >= far.least(cut))
            x += s
            # A pair that meets in the files of both is reported by the smaller one.
            home = b.order[y, 0]
            both = np.ones(len(x), bool) if exact else (a.order[x, :posted] == home[:, None]).any(axis=1)
            mine = ~both | (here < home) | (here == home) & (a.rid[x] < b.rid[y])
            x, y = x[mine], y[mine]
            for t in range(0, len(x), 1 << 16):
                i, j = x[t : t + (1 << 16)], y[t : t + (1 << 16)]
                near = np.einsum("ij,ij->i", a.x[i], b.x[j]) + a.err[i] + b.err[j] + a.err[i] * b.err[j] + 1e-5 >= least
                if near.any():
                    found.append((a.rid[i[near]], b.rid[j[near]]))
        if not found:
            return None
        ra, rb = (np.concatenate(c) for c in zip(*found))
        return pd.DataFrame({"ra": ra, "rb": rb})

    pairs = st.save(_per_tile(tiles(index, 1), work, False, "ra long, rb long").where("ra <> rb"))
    # The vectors of those that are in some pair, for the exact cosine.
    needed = pairs.select(F.explode(F.array("ra", "rb")).alias("rid")).distinct()
    whole = st.save(_named(vectors, key).select("rid", "embedding").join(needed, "rid", "left_semi").dropDuplicates(["rid"]))
    for r in ("ra", "rb"):
        pairs = pairs.join(whole.select(F.col("rid").alias(r), F.transform("embedding", lambda v: v.cast("double")).alias(f"e_{r}")), r)
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    cosine = dot("e_ra", "e_rb") / F.sqrt(dot("e_ra", "e_ra") * dot("e_rb", "e_rb"))
    pairs = pairs.select("ra", "rb", cosine.alias("cosine")).where(F.col("cosine") >= least)
    lists = st.save(_blocks(members, key))
    # Keys of one vector are pairs as well; of two blocks of one list only one order is taken.
    a = lists.select(F.col("rid").alias("ra"), F.col("block").alias("i"), F.col("keys").alias("ka"))
    b = lists.select(F.col("rid").alias("rb"), F.col("block").alias("j"), F.col("keys").alias("kb"))
    copies = lists.where((F.col("blocks") > 1) | (F.size("keys") > 1)).select(F.col("rid").alias("ra"), F.col("block").alias("i"), F.col("keys").alias("ka"), "blocks", F.lit(1.0).alias("cosine"))
    copies = copies.withColumn("j", F.explode(F.sequence("i", F.col("blocks") - 1))).drop("blocks").join(b.withColumnRenamed("rb", "ra"), ["ra", "j"])
    copies = copies.where(F.lit(least <= 1)).repartition(SPREAD).select("cosine", F.explode("ka").alias("x"), "kb", "i", "j").select("cosine", "x", F.explode("kb").alias("y"), "i", "j").where("i <> j or x < y")
    others = pairs.join(a, "ra").join(b, "rb").repartition(SPREAD).select("cosine", F.explode("ka").alias("x"), "kb").select("cosine", "x", F.explode("kb").alias("y")).where("x <> y")
    every = others.unionByName(copies.select("cosine", "x", "y"))
    return every.groupBy(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b")).agg(F.max("cosine").alias("cosine"))


def nearest(vectors: DataFrame, k: int = 10, key: str = "chunk_id", asked: int = 6, posted: int = 14, cut: float = 0.85) -> DataFrame:
    """``key, rank, neighbour, cosine``: the k most similar other vectors of the same dim for every usable vector.

    Approximate: one of the first ``asked`` pivots of a vector must be among the first ``posted`` of
    its neighbour, and their footrule distance at most ``cut`` of the largest possible; these are
    ranked by cosine. Ties go to the smaller key. Fewer than k rows where fewer are met.
    """
    st = Stages(vectors.sparkSession, "nearest")
    index, members = build_index(vectors, st, key, posted, _as_halves)

    def work(file: int, a: _Side, b: _Side) -> pd.DataFrame | None:
        here, found, m = file & 0xFFFFFFFF, [], min(k + 1, len(b.rid))
        for s in range(0, len(a.rid), STRIP):
            part = slice(s, s + STRIP)
            far = Footrule(a.order[part])
            near = far(b.order) >= far.least(cut)
            rows = np.flatnonzero(near.any(axis=1))
            sim = a.x[part] @ b.x[rows].T
            sim[~near[rows].T] = -2
            n = min(m, len(rows))
            if not n:
                continue
            at = np.argpartition(-sim, n - 1, axis=1)[:, :n]
            v = np.take_along_axis(sim, at, 1).ravel()
            x, y = np.repeat(np.arange(len(sim)), n) + s, rows[at.ravel()]
            # What meets in several files is reported by the first that the asker asks in.
            shared = (a.order[x, :asked, None] == b.order[y, None, :posted]).any(axis=2)
            ok = (v > -2) & (a.rid[x] != b.rid[y]) & (a.order[x, shared.argmax(axis=1)] == here)
            found.append((a.rid[x[ok]], b.rid[y[ok]], v[ok]))
        if not found:
            return None
        q, c, v = (np.concatenate(f) for f in zip(*found))
        return pd.DataFrame({"q": q, "c": c, "s": v.astype(np.float32)})

    met = _per_tile(tiles(index, asked), work, True, "q long, c long, s float")
    top = met.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("s"), "c"))).where(F.col("rank") <= k).drop("rank")
    # Of the keys of one vector no more than the first k + 1 can be among anyone's nearest, its own included.
    heads = members.withColumn("n", F.row_number().over(W.partitionBy("rid").orderBy(key))).where(F.col("n") <= k + 1)
    heads = st.save(heads.select(F.col("rid").alias("c"), F.col(key).alias("neighbour")))
    near = top.join(heads, "c").unionByName(heads.select("c", F.col("c").alias("q"), F.lit(1.0).cast("float").alias("s"), "neighbour"))
    own = F.col("q") == F.col("c")
    first_ones = F.row_number().over(W.partitionBy("q").orderBy(F.desc(own), F.desc("s"), "neighbour"))
    near = near.withColumn("n", first_ones).where(F.col("n") <= 2 * k + 1)
    lists = near.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("n", "neighbour", F.col("s").cast("double").alias("cosine"), own.alias("own")))).alias("near"))
    rest = F.slice(F.filter("near", lambda x: ~(x["own"] & (x["neighbour"] == F.col(key)))), 1, k)
    out = members.join(lists, members["rid"] == lists["q"]).select(key, F.posexplode(rest).alias("pos", "x"))
    return out.select(key, (F.col("pos") + 1).alias("rank"), F.col("x.neighbour").alias("neighbour"), F.col("x.cosine").alias("cosine"))


def brute_force(vectors: DataFrame, k: int = 10, key: str = "chunk_id", every: int = 20) -> DataFrame:
    """``key, kth``: cosine of the k-th most similar other row, for the keys whose hash is divisible by ``every``, against all rows.

    A stated query set against all rows, in blocks; made to measure the recall of ``nearest``.
    Keys with fewer than k others have the last one's.
    """
    asks = F.pmod(F.xxhash64(key), F.lit(every)) == 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, g in b.groupby("dim"):
                code, scale, err = _as_halves(_unit(np.stack(g["embedding"].to_numpy())))
                yield pd.DataFrame({"rid": g["rid"].to_numpy(), "file": g["dim"].to_numpy(np.int64), "asks": g["asks"].to_numpy(), "pivots": b"00", "code": code, "scale": scale, "err": err})

    rows = usable(vectors, key).distinct().select(F.xxhash64(key, "embedding").alias("rid"), "dim", "embedding", asks.alias("asks"), key)
    st = Stages(vectors.sparkSession, "brute")
    names = st.save(rows.where("asks").select("rid", key))
    coded = st.save(rows.drop(key).mapInPandas(run, "rid long, file long, asks boolean, pivots binary, code binary, scale float, err float"))
    size = coded.groupBy("file").agg(F.ceil(F.count(F.when(F.col("asks"), 1)) / BLOCK).cast("int").alias("bi"), F.ceil(F.count("*") / BLOCK).cast("int").alias("bj"))
    c = coded.join(F.broadcast(size), "file")  # a row per dim
    part = lambda n, seed: F.pmod(F.xxhash64("rid", F.lit(seed)), F.greatest(n, F.lit(1))).cast("int")
    cols = ["rid", "pivots", "code", "scale", "err"]
    posted = c.select("file", F.explode(F.sequence(F.lit(0), F.greatest(F.col("bi") - 1, F.lit(0)))).alias("i"), part(F.col("bj"), 2).alias("j"), F.lit(2).alias("role"), *cols)
    asking = c.where("asks").select("file", part(F.col("bi"), 1).alias("i"), F.explode(F.sequence(F.lit(0), F.col("bj") - 1)).alias("j"), F.lit(1).alias("role"), *cols)

    def work(_: int, a: _Side, b: _Side) -> pd.DataFrame:
        found = []
        for s in range(0, len(a.rid), STRIP):
            sim = a.x[s : s + STRIP] @ b.x.T
            sim[a.rid[s : s + STRIP, None] == b.rid] = -2
            best = -np.partition(-sim, min(k, sim.shape[1]) - 1, axis=1)[:, :k]
            found.append(pd.DataFrame({"rid": np.repeat(a.rid[s : s + STRIP], best.shape[1]), "s": best.ravel()}))
        return pd.concat(found)

    met = _per_tile(posted.unionByName(asking), work, True, "rid long, s float").where("s > -2")
    best = met.withColumn("n", F.row_number().over(W.partitionBy("rid").orderBy(F.desc("s")))).where(F.col("n") <= k)
    return names.join(best, "rid").groupBy(key).agg(F.min("s").alias("kth"))
