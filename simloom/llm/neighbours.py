"""Problem 5: most similar vectors by cross-polytope hashing.

A fast pseudo-rotation (three rounds of signs and Hadamard transform) turns each vector; its hash is the nearest signed
axis.  A key is two such hashes by different rotations, the first over ``AXES[0]`` axes and the second over ``AXES[1]``;
every vector is put under its nearest few axes of either (multiprobe, on both sides), and vectors that share a key are
ranked by their exact cosine.  Of several pairs of rotations the one that keeps most true neighbours of a bounded sample
is used.

Vectors travel by the first hash and are told apart by the second where they arrive, which saves copies; where a first
hash has more than ``hot`` vectors they travel by both, and a key that is still larger is compared in tiles.  What meets
is the same in all three cases, so recall doesn't depend on the table's size.

Recall against brute force on the test tables is above 0.95; see the README for figures.

Cases: missing, zero, short and non-finite vectors are left out; equal vectors are one class in the index and ranked
as themselves afterwards; ties go to the smaller number; repeated rows are one row; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import stage
from .vectors import PseudoRotation, dimension, equal_classes, stack, unit

K, LEAST, AXES = 10, 0.85, (64, 32)
#: Tiles along either side of a key: so many times ``hot`` vectors may share one.
TILES = 1023


def _best(p, q, cosine, ids, others, k: int):
    """Of (row, other, cosine) each row's k best, ties to the smaller id."""
    order = np.lexsort((others[q], -cosine, p))
    p, q, cosine = p[order], q[order], cosine[order]
    start = np.flatnonzero(np.append(True, p[1:] != p[:-1])) if len(p) else np.zeros(0, np.int64)
    rank = np.arange(len(p)) - np.repeat(start, np.diff(np.append(start, len(p))))
    keep = rank < k
    return ids[p[keep]], others[q[keep]], cosine[keep]


def neighbour_rows(x: np.ndarray, ids: np.ndarray, k: int, least: float, y: np.ndarray | None = None, others: np.ndarray | None = None, rows: int = 512):
    """For every row its k best of cosine >= least, exactly, among the others or the rows of y: (row's id, other's id, cosine to 6 decimals)."""
    x64 = unit(x)
    x32 = x64.astype(np.float32)
    y64, y32, others = (x64, x32, ids) if y is None else (unit(y), unit(y).astype(np.float32), others)
    for s in range(0, len(x), rows):
        c = x32[s : s + rows] @ y32.T
        if y is None:
            c[np.arange(len(c)), np.arange(s, s + len(c))] = -2
        bar = np.full(len(c), least - 1e-5, np.float32)
        full = np.flatnonzero((c >= bar[:, None]).sum(1) > k)
        if len(full):
            bar[full] = np.maximum(bar[full], np.partition(c[full], -k, axis=1)[:, -k] - 3e-6)
        p, q = np.nonzero(c >= bar[:, None])
        exact = np.round((x64[p + s] * y64[q]).sum(1), 6)
        good = exact >= least
        yield _best(p[good] + s, q[good], exact[good], ids, others, k)


def rotations(dim: int, seeds: tuple[int, int]) -> list[PseudoRotation]:
    return [PseudoRotation(dim, s, n) for s, n in zip(seeds, AXES)]


def best_rotations(x: np.ndarray, tries: int, probes: int, k: int, least: float) -> tuple[int, int]:
    """The seeds under whose keys most of the sample's true neighbours meet."""
    ids = np.arange(len(x))
    found = [np.concatenate(z) for z in zip(*neighbour_rows(x, ids, k, least))] if len(x) else []
    if not found or not len(found[0]):
        return 1, 1001
    met = []
    for place in (0, 1):
        each = {}
        for seed in range(1, tries + 1):
            axes = PseudoRotation(x.shape[1], seed + 1000 * place, AXES[place]).axes(x, probes)
            each[seed + 1000 * place] = (axes[found[0]][:, :, None] == axes[found[1]][:, None, :]).any((1, 2))
        met.append(each)
    score = {(a, b): (m & n).mean() for a, m in met[0].items() for b, n in met[1].items()}
    return max(score, key=lambda s: (score[s], -s[0], -s[1]))


def _spread(batches, dim: int, seeds: tuple[int, int], probes: int, hot: set[int], tiles: dict[int, int], ship: bool):
    """Copies under keys (bucket, side), or their numbers. A bucket is a first hash, or for hot ones both and a tile."""
    first, second = rotations(dim, seeds)
    for batch in batches:
        if not batch.num_rows:
            continue
        u = unit(stack(batch, dim)).astype(np.float32)
        axes = first.axes(u, probes)
        rows, buckets = np.repeat(np.arange(len(u)), axes.shape[1]), axes.ravel().astype(np.int64) << 40
        side = np.full(len(rows), 2)
        if hot:
            more = np.isin(buckets, list(hot))
            again = second.axes(u, probes)
            deep_rows = np.repeat(rows[more], again.shape[1])
            deep = np.repeat(buckets[more], again.shape[1]) + (again[rows[more]].ravel().astype(np.int64) + 1 << 20)
            if ship and tiles:
                ids = batch.column("id").to_numpy()
                cut = np.array([tiles.get(b, 1) for b in deep.tolist()])
                mine = ((ids[deep_rows].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % cut.astype(np.uint64)).astype(np.int64)
                parts = []
                for c in range(int(cut.max(initial=1))):  # tile (i, j), i <= j, of a key gets chunks i and j
                    has = cut > c
                    i, j = np.minimum(mine[has], c), np.maximum(mine[has], c)
                    parts.append((deep_rows[has], deep[has] + (i << 10) + j, np.where(i == j, 2, mine[has] == j)))
                deep_rows, deep, deep_side = (np.concatenate(z) for z in zip(*parts))
            else:
                deep_side = np.full(len(deep), 2)
            rows, buckets, side = np.concatenate([rows[~more], deep_rows]), np.concatenate([buckets[~more], deep]), np.concatenate([side[~more], deep_side])
        if not ship:
            values, n = np.unique(buckets, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n.astype(np.int64))], ["bucket", "n"])
            continue
        pick = pa.array(rows)
        yield pa.RecordBatch.from_arrays([pa.array(buckets), pa.array(side.astype(np.int32)), batch.column("id").take(pick), batch.column("v").take(pick)], ["bucket", "side", "id", "v"])


def runs(batches, key: str):
    """Whole groups of a stream that is sorted by key, as tables."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]
        for s, e in zip(cuts[:-1], cuts[1:]):
            if kept and kept[-1].column(key)[0].as_py() != values[s]:
                yield pa.Table.from_batches(kept)
                kept = []
            kept.append(batch.slice(s, e - s))
    if kept:
        yield pa.Table.from_batches(kept)


def _in_bucket(x: np.ndarray, ids: np.ndarray, second: PseudoRotation, probes: int, k: int, least: float):
    """neighbour_rows among those of a first hash that share a second one as well."""
    axes = second.axes(unit(x).astype(np.float32), probes)
    rows, keys = np.repeat(np.arange(len(x)), axes.shape[1]), axes.ravel()
    order = np.argsort(keys, kind="stable")
    rows, keys = rows[order], keys[order]
    cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
    place = np.arange(len(x))
    found = [z for s, e in zip(cuts[:-1], cuts[1:]) if e - s > 1 for z in neighbour_rows(x[rows[s:e]], place[rows[s:e]], k, least)]
    if not found:
        return
    p, q, cosine = (np.concatenate(z) for z in zip(*found))
    _, once = np.unique(p * len(x) + q, return_index=True)
    yield _best(p[once], q[once], cosine[once], ids, ids, k)


def _ranked(batches, dim: int, seeds: tuple[int, int], probes: int, k: int, least: float):
    second = rotations(dim, seeds)[1]
    for t in runs(batches, "bucket"):
        ids, side = t.column("id").to_numpy(), t.column("side").to_numpy()
        _, once = np.unique(ids, return_index=True)
        if len(once) < 2:
            continue
        x = np.frombuffer(b"".join(t.column("v").take(pa.array(once)).to_pylist()), np.float32).reshape(-1, dim)
        ids, side = ids[once], side[once]
        if not t.column("bucket")[0].as_py() & (1 << 40) - 1:
            found = _in_bucket(x, ids, second, probes, k, least)
        elif side[0] == 2:
            found = neighbour_rows(x, ids, k, least)
        else:
            a, b = side == 0, side == 1
            found = (z for m, n in ((a, b), (b, a)) for z in neighbour_rows(x[m], ids[m], k, least, x[n], ids[n]))
        for a, b, c in found:
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c)], ["q", "c", "cosine"])


def nearest(df: DataFrame, id_col: str, col: str, k: int = K, least: float = LEAST, probes: int = 4, tries: int = 16, sample: int = 4096, hot: int = 60_000) -> DataFrame:
    """(id, other, cosine, rank): for every usable vector its up to k nearest others of cosine >= least.

    sample bounds the rows on which the rotations are chosen; hot is the number of vectors of one first hash, or one
    key, that a task holds.
    """
    dim = dimension(df, col)
    if not dim:
        return df.sparkSession.createDataFrame([], "id long, other long, cosine double, rank int")
    vectors, members = equal_classes(df, id_col, col, dim)
    some = vectors.orderBy(F.xxhash64("id")).limit(sample).toArrow()
    x = np.frombuffer(b"".join(some.column("v").to_pylist()), np.float32).reshape(-1, dim)
    seeds = best_rotations(x, tries, probes, k, least)

    def large(which: set[int]) -> dict[int, int]:  # of at most 128, or 128 x 64 keys
        sizes = vectors.mapInArrow(lambda it: _spread(it, dim, seeds, probes, which, {}, False), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
        return {r[0]: -(-r[1] // hot) for r in sizes.where(F.col("n") > hot).collect()}

    heavy = set(large(set()))
    tiles = {b: n for b, n in large(heavy).items() if b not in heavy} if heavy else {}
    if max(tiles.values(), default=1) > TILES:
        raise ValueError(f"more than {TILES * hot} vectors share a key: raise hot")
    shipped = vectors.mapInArrow(lambda it: _spread(it, dim, seeds, probes, heavy, tiles, True), "bucket long, side int, id long, v binary")
    found = shipped.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda it: _ranked(it, dim, seeds, probes, k, least), "q long, c long, cosine double")
    met = found.repartition("q").groupBy("q", "c").agg(F.max("cosine").alias("cosine"))
    order = Window.partitionBy("q").orderBy(F.desc("cosine"), "c")
    met = stage(met.select("*", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k).drop("rank"), "met")
    # classes of equal vectors: each class's list of its own and the others' smallest members
    members = stage(members, "members")
    low = Window.partitionBy("rep").orderBy("id")
    few = members.distinct().select("*", F.row_number().over(low).alias("n")).where(F.col("n") <= k + 1).select("rep", F.col("id").alias("m"))
    reached = met.join(few, F.col("c") == F.col("rep"), "left").select("q", F.coalesce("m", "c").alias("c"), "cosine")
    own = few.select(F.col("rep").alias("q"), F.col("m").alias("c"), F.lit(1.0).alias("cosine"))
    lists = reached.unionByName(own).select("*", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k + 1)
    owner = members.distinct().select(F.col("rep").alias("q"), "id")
    each = lists.join(owner, "q", "left").select(F.coalesce("id", "q").alias("id"), "c", "cosine", "rank", (F.col("id").isNotNull()).alias("shared"))
    plain = each.where("not shared and rank <= %d" % k)
    mine = each.where("shared")
    place = mine.where("id = c").select("id", F.col("rank").alias("own_rank"))
    rest = mine.where("id <> c").join(place, "id", "left")
    moved = F.col("rank") - F.when(F.col("own_rank") < F.col("rank"), 1).otherwise(0)
    shared = rest.select("id", "c", "cosine", moved.alias("rank")).where(F.col("rank") <= k)
    return plain.select("id", "c", "cosine", "rank").unionByName(shared).withColumnRenamed("c", "other")
