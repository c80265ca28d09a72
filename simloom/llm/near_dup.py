"""Problem 7: groups of near-duplicate rows by a count-vector R-tree.

Tokens are hashed into 128 groups; a text is the point of its group counts.  The overlap of two texts is bounded by
the summed minima of their coordinates: the groups both have, plus what either has beyond one token in a group.
Points that share one of their first tokens (a threshold on the overlap leaves no other way to be close) are packed,
ordered by length and coordinates, into the leaves of an R-tree; pairs of leaves whose bounding boxes can't reach the
threshold are passed over, pairs of points are bounded next, and what survives is verified on the token sets.

Both scripts of a row are one point if one is the other's transliteration, else two; only points of the same
script meet.  Equal contents are one class before the search, so copies, however many, never meet pairwise.

Cases: null, empty and placeholder texts take no part; a row without either text is in no group; equal contents are
close; ties don't arise (the smallest row number names a group); repeated rows have the same number and are one row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .frames import drop, stage
from .text import CommonOneToOne, Elements, real_tokens

GROUPS = 128
LEAF = 128
#: A token in more than one of so many texts is frequent: it comes last in the order, whatever its hash.
RARE = 200
#: Points that share one key: keys have as many tokens as bring the usual key below it, and a key beyond it is cut into tiles.
BLOCK = 20_000


def _tokenised(batches, text_a: str, text_b: str):
    common, elements = CommonOneToOne(), Elements()
    for batch in batches:
        ids, flags, flat, ends = [], [], [], [0]
        for i, a, b in zip(batch.column("id").to_pylist(), batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            if i is None:
                continue
            ta, tb = common(real_tokens(a)), common(real_tokens(b))
            for flag, t in ((3, ta),) if ta == tb else ((1, ta), (2, tb)):
                if t:
                    flat.extend(sorted(elements(t)))
                    ends.append(len(flat))
                    ids.append(i)
                    flags.append(flag)
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(flat, np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(flags, pa.int32()), lists], ["id", "flag", "elems"])


def needed(n):
    """Least overlap with which texts of which the longer has n tokens are close, at four fifths."""
    return (4 * n + 4) // 5


def prefix_order(elems: np.ndarray, rank: dict[int, int]) -> list[int]:
    """Rare tokens first, by hash; frequent ones last, by frequency."""
    return sorted(elems.tolist(), key=lambda x: (rank.get(x, -1), x))


def _entries(batches, rank: dict[int, int], levels: int):
    import itertools

    for batch in batches:
        ids, flags, lists = batch.column("id").to_numpy(), batch.column("flag").to_numpy(), batch.column("elems")
        values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
        keys, rows, info, low, high = [], [], [], [], []
        group = (values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(57)
        for k in range(len(ids)):
            e = values[offsets[k] : offsets[k + 1]]
            bits = 0
            for g in group[offsets[k] : offsets[k + 1]].tolist():
                bits |= 1 << g
            n = len(e)
            first = prefix_order(e, rank)[: n - needed(n) + levels]
            depth = min(levels, needed(n))  # the same for any two short texts that can be close
            found = first if depth == 1 else [hash(c) for c in itertools.combinations(first[: n - needed(n) + depth], depth)]
            keys.extend(found)
            rows.extend([k] * len(found))
            low.append(bits & 0xFFFFFFFFFFFFFFFF)
            high.append(bits >> 64)
            info.append(int(flags[k]) | n << 2 | (n - bits.bit_count()) << 32)
        at = np.array(rows, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array(keys, np.int64)), pa.array(ids[at]), pa.array(np.array(info, np.int64)[at]), pa.array(np.array(low, np.uint64).view(np.int64)[at]), pa.array(np.array(high, np.uint64).view(np.int64)[at])],
            ["key", "id", "info", "low", "high"],
        )


class CountTree:
    """R-tree over group counts, packed bottom-up; all pairs of points whose bound reaches the threshold."""

    def __init__(self, ids, info, low, high, side):
        n, extra = (info >> 2) & 0x3FFFFFFF, info >> 32
        order = np.lexsort((high, low, n))
        self.ids, self.flag, self.n, self.extra = ids[order], (info & 3)[order], n[order].astype(np.int32), extra[order].astype(np.int32)
        self.side = side[order]
        self.low, self.high = low.view(np.uint64)[order], high.view(np.uint64)[order]
        starts = np.arange(0, len(ids), LEAF)
        self.starts, self.ends = starts, np.minimum(starts + LEAF, len(ids))
        self.few = self.extra.max(initial=0) < 128  # then bounds fit a byte
        # a leaf's box: the largest coordinates, the shortest and the longest text
        self.box_low, self.box_high = np.bitwise_or.reduceat(self.low, starts), np.bitwise_or.reduceat(self.high, starts)
        self.box_extra = np.maximum.reduceat(self.extra, starts)
        self.shortest, self.longest = self.n[starts], self.n[self.ends - 1]

    def pairs(self):
        for i, (s, e) in enumerate(zip(self.starts, self.ends)):
            last = np.searchsorted(self.shortest, self.longest[i] * 5 // 4, side="right")
            js = np.arange(i, last)
            bound = np.bitwise_count(self.box_low[js] & self.box_low[i]).astype(np.int32) + np.bitwise_count(self.box_high[js] & self.box_high[i]) + np.minimum(self.box_extra[js], self.box_extra[i])
            js = js[bound >= needed(np.maximum(self.shortest[js], self.shortest[i]))]
            if not len(js):
                continue
            # neighbouring leaves are one run of points
            cuts = np.flatnonzero(np.diff(js) > 1) + 1
            for run in np.split(js, cuts):
                a, b = self.starts[run[0]], self.ends[run[-1]]
                for x in range(a, b, 4096):
                    y = min(x + 4096, b)
                    over = np.bitwise_count(self.low[s:e, None] & self.low[None, x:y])
                    over += np.bitwise_count(self.high[s:e, None] & self.high[None, x:y])
                    both = np.minimum(self.extra[s:e, None], self.extra[None, x:y])
                    over = over + (both.astype(np.uint8) if self.few else both)
                    most = np.maximum(self.n[s:e, None], self.n[None, x:y])
                    p, q = np.nonzero(over >= needed(most).astype(np.int32))
                    p, q = p + s, q + x
                    keep = (p < q) & ((self.flag[p] & self.flag[q]) > 0) & (self.ids[p] != self.ids[q]) & ((self.side[p] == 2) | (self.side[p] != self.side[q]))
                    if keep.any():
                        yield self.ids[p[keep]], self.flag[p[keep]], self.ids[q[keep]], self.flag[q[keep]]


def _blocks(batches):
    """Runs of equal keys in a partition that is sorted by key."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("key").to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
        for s, e in zip(cuts[:-1], cuts[1:]):
            piece = batch.slice(s, e - s)
            if kept and kept[-1].column("key")[0].as_py() != key[s]:
                yield kept
                kept = []
            kept.append(piece)
    if kept:
        yield kept


def _search(batches):
    names = ["id_a", "flag_a", "id_b", "flag_b"]
    for block in _blocks(batches):
        if sum(p.num_rows for p in block) < 2:
            continue
        t = pa.Table.from_batches(block)
        tree = CountTree(*(t.column(c).to_numpy() for c in ("id", "info", "low", "high", "side")))
        for found in tree.pairs():
            a, fa, b, fb = found
            swap = (a > b) | ((a == b) & (fa > fb))
            a, b, fa, fb = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, fb, fa), np.where(swap, fa, fb)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(fa.astype(np.int32)), pa.array(b), pa.array(fb.astype(np.int32))], names)


def tiled(entries: DataFrame, block: int) -> DataFrame:
    """The entries with a side. A key of more than block points is cut into chunks by a hash of the row; every two chunks
    make a tile with a key of its own (sides 0 and 1), and every chunk with itself (side 2). No other key is touched.

    Keys of more than block points are fewer than the entries over block; they are joined, not collected.
    """
    hot = entries.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block).select(F.col("key").alias("hot"), F.ceil(F.col("n") / block).cast("int").alias("chunks"))
    named = entries.join(hot, F.col("key") == F.col("hot"), "left").drop("hot")
    plain = named.where("chunks is null").drop("chunks").withColumn("side", F.lit(2))
    cut = named.where("chunks is not null").withColumn("mine", F.pmod(F.xxhash64("id", F.lit(5)), F.col("chunks")).cast("int"))
    cut = cut.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    side = F.when(F.col("mine") == F.col("with"), 2).otherwise((F.col("mine") > F.col("with")).cast("int"))
    tile = F.xxhash64("key", F.least("mine", "with"), F.greatest("mine", "with"))
    return plain.unionByName(cut.withColumn("side", side).withColumn("key", tile).select(*plain.columns))


def key_levels(rows: int, vocabulary: int) -> int:
    """Tokens in a key, so that about BLOCK points share one: few for small tables, more as they grow."""
    levels, prefix = 1, 5
    while levels < 4 and rows * math.comb(prefix + levels - 1, levels) > BLOCK * math.comb(max(vocabulary, 10), levels):
        levels += 1
    return levels


def near_duplicates(df: DataFrame, id_col: str, text_a: str, text_b: str) -> DataFrame:
    """(node, root) for every row that is close to another in a field both have, directly or through others."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_a).cast("string").alias("a"), F.col(text_b).cast("string").alias("b"))
    tokens = stage(rows.mapInArrow(lambda it: _tokenised(it, "a", "b"), "id long, flag int, elems array<long>"), "tokens")
    total = tokens.count()
    counts = tokens.select(F.explode("elems").alias("e")).groupBy("e").count()
    frequent = counts.where(F.col("count") * RARE > total).collect()  # fewer than RARE times the mean length, whatever the table's size
    rank = {r[0]: k for k, r in enumerate(sorted(frequent, key=lambda r: (r[1], r[0])))}
    levels = key_levels(total, counts.count())
    hashed = tokens.select("id", "flag", "elems", F.xxhash64("elems").alias("h1"), F.xxhash64("elems", F.lit(7)).alias("h2"))
    classes = stage(hashed.groupBy("h1", "h2", "flag").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("elems").alias("elems")), "classes")
    several = classes.where("n > 1").select("h1", "h2", "flag", F.col("id").alias("rep"))
    copies = hashed.drop("elems").join(several, ["h1", "h2", "flag"]).where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    entries = stage(classes.select("id", "flag", "elems").mapInArrow(lambda it: _entries(it, rank, levels), "key long, id long, info long, low long, high long"), "entries")
    found = tiled(entries, BLOCK).repartition("key").sortWithinPartitions("key").mapInArrow(_search, "id_a long, flag_a int, id_b long, flag_b int").distinct()
    side = classes.select("id", "flag", "elems")
    a, b = side.toDF("id_a", "flag_a", "elems_a"), side.toDF("id_b", "flag_b", "elems_b")
    met = found.join(a, ["id_a", "flag_a"]).join(b, ["id_b", "flag_b"])
    close = met.where(5 * F.size(F.array_intersect("elems_a", "elems_b")) >= 4 * F.greatest(F.size("elems_a"), F.size("elems_b")))
    edges = stage(close.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).unionByName(copies), "links")
    drop(tokens, classes, entries)
    return components(edges)


def groups(df: DataFrame, id_col: str, text_a: str, text_b: str) -> DataFrame:
    """One row for each row that is in a group: its group's smallest row number, and the group's size."""
    c = stage(near_duplicates(df, id_col, text_a, text_b), "groups")
    sizes = c.groupBy("root").agg(F.count("*").alias("group_size"))
    return c.join(sizes, "root").select(F.col("node").alias(id_col), F.col("root").alias("group_first"), "group_size")
