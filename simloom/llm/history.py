"""Problem 1: each new batch against everything accepted before, by multi-key sorted-neighbourhood runs.

The history is a folder: a manifest, runs and members.  A run holds the keys of the first sentences of one batch's
records, cut into key ranges (the key's leading bits; bucketed files) and sorted by key within each.  The sentences of a
new batch, of either side, are keyed, cut and sorted alike, and merged with each run range by range: only the window of
equal keys around a sentence is compared, by hashed token groups, the runs are not shuffled again, and of a small batch
only the ranges that it touches are read.  Whichever way round two records repeat one another, a sentence of the later
one is close to the first sentence of the earlier one; so these windows lose nothing, and every sentence is keyed once,
however many records have it.  Records of sentences that met, and whose other sentences share a first token, are
verified on both token sets.

A key names as many tokens of a sentence's first ones as keep a window short: windows of a fixed number of tokens would
grow with the table, as its vocabulary does not.  Runs are compacted as they pile up: four runs of equally many batches
become one, so their number grows with the logarithm of the batches, and every later batch reads the compacted runs.
``AcceptedHistory.open`` goes on where an earlier session stopped.

Within a batch, a record is accepted when no smaller record that it repeats is accepted; this is settled in rounds, each
of which accepts what has no undecided smaller neighbour and rejects the neighbours of what was accepted.  Sentences of
rejected records stay in the run; they lead to no member.

Cases: rows without ID or with a sentence without token are left out (they repeat nothing); an ID delivered more than
once is one record, the one that arrived first; equal contents repeat one another; an empty batch adds nothing.
"""

from __future__ import annotations

import itertools
import json
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import drop, new_path, read_text, remove, stage, write_text
from .near_dup import needed
from .pairs import CLASS, _near, classes_of, frequent_tokens, records

ENTRY = ["key", "sent", "info", "bits"]
RUN = ", ".join(f"{c} long" for c in [*ENTRY, "cut"])
MEMBER = "h1 long, h2 long, first string, ea array<long>, eb array<long>"
FOUND = "id_first string, id_again string"
#: Files cut by the key's range serve a merge by range as they are, and in the order they were written in.
LAYOUT = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.unionOutputPartitioning": "true"}
#: What the manifest calls the layout of runs; folders of another one can't be read.
VERSION = 2
#: Runs of equally many batches that become one.
FAN = 4
#: Sentences that share a key, about: keys have as many tokens as bring it below.
WINDOW = 3000
#: Keys of a run in a range, about.
RANGE = 1_000_000
#: Cells compared at once.
CELLS = 1 << 19


def key_levels(sentences: int, vocabulary: int) -> int:
    """Tokens in a key, so that fewer than about WINDOW sentences share one; a fourth of the vocabulary comes first."""
    levels, first = 1, max(vocabulary // 4, 10)
    while levels < 4 and sentences * math.comb(4 + levels, levels) > WINDOW * math.comb(first, levels):
        levels += 1
    return levels


def _mixed(h, x):
    h = (h ^ x) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _entries(batches, rank: dict[int, int], levels: int):
    """Every sentence under the keys of its first tokens: rare ones by hash, then the frequent ones in the order of rank."""
    known = np.array(sorted(rank), np.int64)
    ranks = np.array([rank[x] for x in known.tolist()], np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column("e")
        values, offsets = lists.flatten().to_numpy(), lists.offsets.to_numpy()
        offsets = offsets.astype(np.int64) - offsets[0]
        n = np.diff(offsets)
        row = np.repeat(np.arange(len(n)), n)
        bit = np.uint64(1) << ((values.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58))
        bits = np.bitwise_or.reduceat(bit, offsets[:-1])
        info = n << 32 | (n - np.bitwise_count(bits).astype(np.int64))
        place = np.full(len(values), -1, np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, values), len(known) - 1)
            place = np.where(known[at] == values, ranks[at], -1)
        ordered = values[np.lexsort((values, place, row))].view(np.uint64)
        least = (4 * n + 4) // 5
        depth = np.minimum(levels, least)  # the same for any two short sentences that can be close
        shape = (n - least + depth) * 8 + depth
        keys, rows = [], []
        for kind in np.unique(shape).tolist():
            length, d = kind >> 3, kind & 7
            mine = np.flatnonzero(shape == kind)
            first = ordered[offsets[mine][:, None] + np.arange(length)]
            for c in itertools.combinations(range(length), d):
                h = np.full(len(mine), d, np.uint64)
                for k in c:
                    h = _mixed(h, first[:, k])
                keys.append(_mixed(h, np.uint64(7)))
                rows.append(mine)
        at = np.concatenate(rows)
        key = np.concatenate(keys).view(np.int64)
        sent, flag = batch.column("sent").to_numpy(), batch.column("is_first").to_numpy(zero_copy_only=False)
        for s in range(0, len(at), 1 << 16):
            some = at[s : s + (1 << 16)]
            columns = [key[s : s + (1 << 16)], sent[some], info[some], bits.view(np.int64)[some]]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(flag[some])], [*ENTRY, "is_first"])


def sentence_entries(sentences: DataFrame, rank: dict[int, int], levels: int) -> DataFrame:
    """(key, sent, info, bits, is_first) of (sent, e, is_first)."""
    kinds = ", ".join(f"{c} long" for c in ENTRY) + ", is_first boolean"
    return sentences.select("sent", "e", "is_first").mapInArrow(lambda it: _entries(it, rank, levels), kinds)


class _Side:
    """One side of a range, sorted by key."""

    def __init__(self, t: pa.Table):
        key, self.sent, info, bits = (t.column(c).to_numpy() for c in ENTRY)
        self.old = t.column("old").to_numpy() if "old" in t.column_names else np.zeros(len(key), bool)
        if (key[1:] < key[:-1]).any():
            order = np.argsort(key, kind="stable")  # runs that are sorted already are merged
            key, self.sent, info, bits, self.old = key[order], self.sent[order], info[order], bits[order], self.old[order]
        n = info >> 32
        small = np.uint8 if n.max(initial=0) < 128 else np.int32  # then bounds fit a byte
        self.bits, self.extra, self.need = bits.view(np.uint64), (info & 0xFFFFFFFF).astype(small), needed(n).astype(small)
        self.starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        self.keys, self.sizes = key[self.starts], np.diff(np.append(self.starts, len(key)))


def _windows(a: _Side, b: _Side):
    """Rows of either side that share a key and whose bound reaches the threshold."""
    _, i, j = np.intersect1d(a.keys, b.keys, assume_unique=True, return_indices=True)
    s, t, p, q = a.starts[i], b.starts[j], a.sizes[i], b.sizes[j]
    cells = p * q
    few = np.flatnonzero(cells <= 4096)
    ends = np.cumsum(cells[few])
    cuts = np.unique(np.searchsorted(ends, np.arange(CELLS, ends[-1] + CELLS, CELLS))) + 1 if len(few) else []
    for some in np.split(few, cuts):
        if not len(some):
            continue
        block = np.repeat(np.arange(len(some)), cells[some])
        at = np.arange(len(block)) - np.repeat(np.cumsum(cells[some]) - cells[some], cells[some])
        x = s[some][block] + at // q[some][block]
        y = t[some][block] + at % q[some][block]
        over = np.bitwise_count(a.bits[x] & b.bits[y]) + np.minimum(a.extra[x], b.extra[y])
        hit = over >= np.maximum(a.need[x], b.need[y])
        yield x[hit], y[hit]
    for k in np.flatnonzero(cells > 4096).tolist():
        for c in range(t[k], t[k] + q[k], 4096):
            right = slice(c, min(c + 4096, t[k] + q[k]))
            step = max(1, CELLS // (right.stop - right.start))
            for r in range(s[k], s[k] + p[k], step):
                left = slice(r, min(r + step, s[k] + p[k]))
                over = np.bitwise_count(a.bits[left, None] & b.bits[None, right]) + np.minimum(a.extra[left, None], b.extra[None, right])
                x, y = np.nonzero(over >= np.maximum(a.need[left, None], b.need[None, right]))
                yield x + r, y + c


def _meet(left: pa.Table, right: pa.Table) -> pa.Table:
    """(s, t, old): sentences of the two sides of a range that may be close, each pair once; equal ones are left out."""
    found = []
    if left.num_rows and right.num_rows:
        a, b = _Side(left), _Side(right)
        found = [(a.sent[x], b.sent[y], b.old[y]) for x, y in _windows(a, b) if len(x)]
    s, t, old = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
    order = np.lexsort((old, t, s))
    s, t, old = s[order], t[order], old[order]
    once = np.ones(len(s), bool)
    once[1:] = (s[1:] != s[:-1]) | (t[1:] != t[:-1]) | (old[1:] != old[:-1])
    once &= s != t
    return pa.table({"s": s[once], "t": t[once], "old": old[once]})


def _met(new: DataFrame, runs: list[DataFrame]) -> DataFrame:
    """(s, t, old): sentences of new entries and of the batch's and (old) the runs' first ones, range by range where both lie."""
    names = [*ENTRY, "cut"]
    there = new.where("is_first").select(*names, F.lit(False).alias("old"))
    for run in runs:
        there = there.unionByName(run.select(*names, F.lit(True).alias("old")))
    # columns of their own, also where both are one table
    left, right = new.select(*(F.col(c).alias(c) for c in names)), there.select(*(F.col(c).alias(c) for c in [*names, "old"]))
    return left.groupBy("cut").cogroup(right.groupBy("cut")).applyInArrow(_meet, "s long, t long, old boolean")


def _first(tokens: str) -> Column:
    """The tokens of which two close sentences share one, in the order of their hashes."""
    n = F.size(tokens)
    return F.explode(F.slice(tokens, F.lit(1), n - F.floor((4 * n + 4) / 5).cast("int") + 1))


class AcceptedHistory:
    """Accepted records in a folder; ranges is the number of key ranges, a power of two: about a million keys of a run each.

    expected is the number of records that it is to hold, about: keys are chosen for it, or for the first batch if that
    is larger.  Of more records, windows grow longer, but nothing is lost.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, ranges: int = 16, expected: int = 0):
        if ranges & (ranges - 1):
            raise ValueError("ranges must be a power of two")
        self.spark, self.path = spark, path or new_path(spark, "history")
        self.ranges, self.expected, self.rank, self.levels = ranges, expected, None, 1
        self.runs: list[dict] = []  # name, path, batches
        self.members: list[str] = []

    @classmethod
    def open(cls, spark: SparkSession, path: str, ranges: int = 16, expected: int = 0) -> AcceptedHistory:
        """The history of a folder as the last finished batch left it; a new one, of so many ranges, where there is none."""
        out, text = cls(spark, path, ranges, expected), read_text(spark, f"{path}/manifest.json")
        if text:
            state = json.loads(text)
            if state.get("version") != VERSION:
                raise ValueError(f"{path} holds runs of another layout")
            out.ranges, out.levels, out.runs, out.members = state["ranges"], state["levels"], state["runs"], state["members"]
            out.rank = {e: k for k, e in enumerate(state["rank"])}
            for run in out.runs:
                spark.sql(f"CREATE TABLE IF NOT EXISTS {run['name']} ({RUN}) USING parquet CLUSTERED BY (cut) SORTED BY (cut, key) INTO {out.ranges} BUCKETS LOCATION '{run['path']}'")
        return out

    def _save(self) -> None:
        state = {"version": VERSION, "ranges": self.ranges, "levels": self.levels, "runs": self.runs, "members": self.members, "rank": sorted(self.rank, key=self.rank.get)}
        write_text(self.spark, f"{self.path}/manifest.json", json.dumps(state))

    def _write_run(self, entries: DataFrame, batches: int) -> dict:
        name = f"simloom_{uuid.uuid4().hex[:12]}"
        run = {"name": name, "path": f"{self.path}/runs/{name}", "batches": batches}
        entries.write.format("parquet").bucketBy(self.ranges, "cut").sortBy("cut", "key").option("path", run["path"]).option("compression", "zstd").saveAsTable(name)
        return run

    def _forget(self, run: dict) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {run['name']}")
        remove(self.spark, run["path"])

    def _known(self) -> DataFrame | None:
        return self.spark.read.schema(MEMBER).parquet(*self.members) if self.members else None

    def _compact(self) -> list[dict]:
        """The last FAN runs become one while they are of equally many batches.  Returns the runs that the manifest no longer names."""
        take, batches, more = 0, self.runs[-1]["batches"] if self.runs else 0, FAN
        while len(rest := self.runs[: len(self.runs) - take]) >= more and all(r["batches"] == batches for r in rest[-more:]):
            take, batches, more = take + more, batches * FAN, FAN - 1
        if not take:
            return []
        old = self.runs[-take:]
        merged = self.spark.table(old[0]["name"])
        for run in old[1:]:
            merged = merged.unionByName(self.spark.table(run["name"]))
        self.runs = [*self.runs[:-take], self._write_run(merged.repartition(self.ranges, "cut"), batches)]
        return old

    def close(self) -> None:
        """Take the tables out of the session; the folder stays."""
        for run in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {run['name']}")

    def delete(self) -> None:
        self.close()
        remove(self.spark, self.path)

    def _touched(self, new: DataFrame) -> list[int] | None:
        """The key ranges that a batch touches; None where it is too large to leave any out."""
        cuts = [r[0] for r in new.select("cut").distinct().collect()]  # at most one for each range
        return cuts if len(cuts) < self.ranges else None

    def add(self, recs: DataFrame) -> DataFrame:
        """(id_first, id_again): the batch's rejected records with the accepted ones they repeat; the rest is accepted.

        The batch's IDs are greater than those of the history.  A batch that fails midway changes nothing.
        """
        if self.rank is None:
            self.rank, vocabulary = frequent_tokens(recs), recs.select(F.explode(F.array_union("ea", "eb")).alias("e")).agg(F.approx_count_distinct("e")).first()[0]
            self.levels = key_levels(max(self.expected, recs.count()), vocabulary)
        before = {k: self.spark.conf.get(k) for k in LAYOUT}
        try:
            for k, v in LAYOUT.items():
                self.spark.conf.set(k, v)
            return self._add(recs)
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)

    def _near(self, classes: DataFrame, new: DataFrame, again: DataFrame) -> DataFrame:
        """(h1, h2, g1, g2, first, first_r, old): classes of the batch with those that they repeat, of the batch or (old) of the history.

        new: the batch's entries; again: its sentences that stand in it more than once.
        """
        cuts = self._touched(new) if self.runs else None
        runs = [self.spark.table(r["name"]) for r in self.runs]
        met = _met(new, runs if cuts is None else [r.where(F.col("cut").isin(cuts)) for r in runs])
        met = met.unionByName(again.select(F.col("sent").alias("s"), F.col("sent").alias("t"), F.lit(False).alias("old")))
        known = classes.withColumn("old", F.lit(False))
        if self.runs:
            sides = classes.select(F.explode(F.array(F.xxhash64("ea"), F.xxhash64("eb"))).alias("s"))
            known = known.unionByName(self._known().withColumn("old", F.lit(True)))
            # a sentence that stands in the history already meets itself
            same = sides.join(self._known().select(F.xxhash64("ea").alias("s")), "s", "left_semi").select("s", F.col("s").alias("t"), F.lit(True).alias("old"))
            met = met.unionByName(same)
        met = stage(met.distinct(), "met")
        both = [classes.select(*CLASS, "first", F.col(x).alias("x"), F.col(y).alias("y"), F.xxhash64(x).alias("s")) for x, y in (("ea", "eb"), ("eb", "ea"))]
        left = both[0].unionByName(both[1]).join(met, "s").select(*CLASS, "first", "x", "y", "t", "old", _first("y").alias("token"))
        there = known.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("first").alias("first_r"), "ea", "eb", F.xxhash64("ea").alias("t"), "old")
        right = there.join(met.select("t", "old").distinct(), ["t", "old"], "left_semi").select("*", _first("eb").alias("token"))
        pairs = left.join(right, ["t", "old", "token"]).where(_near("x", "ea") & _near("y", "eb"))
        pairs = pairs.select(*CLASS, "g1", "g2", "first", "first_r", "old").where("old or h1 <> g1 or h2 <> g2")
        # of the batch, each pair once: either record may have found the other
        turn = ~F.col("old") & ((F.col("h1") > F.col("g1")) | ((F.col("h1") == F.col("g1")) & (F.col("h2") > F.col("g2"))))
        swap = [("h1", "g1"), ("h2", "g2"), ("g1", "h1"), ("g2", "h2"), ("first", "first_r"), ("first_r", "first")]
        near = stage(pairs.select(*(F.when(turn, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in swap), "old").distinct(), "near")
        drop(met)
        return near

    def _add(self, recs: DataFrame) -> DataFrame:
        classes = stage(classes_of(recs), "batch")
        cut = F.shiftright(F.col("key"), 64 - self.ranges.bit_length() + 1) if self.ranges > 1 else F.lit(0).cast("long")
        both = classes.select(F.col("ea").alias("e"), F.lit(True).alias("is_first")).unionByName(classes.select(F.col("eb").alias("e"), F.lit(False).alias("is_first")))
        named = both.select("*", F.xxhash64("e").alias("sent"), F.xxhash64("e", F.lit(7)).alias("h"))
        sentences = stage(named.groupBy("sent", "h").agg(F.first("e").alias("e"), F.max("is_first").alias("is_first"), F.count("*").alias("n")), "sentences")
        entries = self._write_run(sentence_entries(sentences, self.rank, self.levels).withColumn("cut", cut).repartition(self.ranges, "cut"), 1)
        new = self.spark.table(entries["name"])
        near = self._near(classes, new, sentences.where("is_first and n > 1"))
        run = self._write_run(new.where("is_first").select(*ENTRY, "cut"), 1)
        self._forget(entries)
        drop(sentences)
        # within the batch: from the smaller first ID to the greater; what repeats the history is rejected already
        inner = near.where("not old")
        x, y = F.struct("h1", "h2"), F.struct(F.col("g1").alias("h1"), F.col("g2").alias("h2"))
        ahead = F.col("first") < F.col("first_r")
        edges = inner.select(F.when(ahead, x).otherwise(y).alias("x"), F.when(ahead, y).otherwise(x).alias("y"))
        parts = [stage(near.where("old").select(x.alias("g")).distinct(), "lost")]
        lost = parts[0]
        left = stage(edges.join(lost, F.col("x") == F.col("g"), "left_anti").join(lost, F.col("y") == F.col("g"), "left_anti"), "undecided")
        while not left.isEmpty():
            first = left.select("x").distinct().join(left.select(F.col("y").alias("later")).distinct(), F.col("x") == F.col("later"), "left_anti")
            falls = stage(left.join(first, "x", "left_semi").select(F.col("y").alias("g")).distinct(), "lost")
            parts.append(falls)
            # what falls takes its edges along, and so does what stands: all its neighbours fall
            rest = stage(left.join(falls, F.col("x") == F.col("g"), "left_anti").join(falls, F.col("y") == F.col("g"), "left_anti"), "undecided")
            drop(left)
            left = rest
        gone = stage(self.spark.read.schema(lost.schema).parquet(*(q.staged_path for q in parts)).distinct().select("g.h1", "g.h2"), "gone")
        kept = classes.join(gone, CLASS, "left_anti")
        members = f"{self.path}/members/{run['name']}"
        kept.select(*CLASS, "first", "ea", "eb").write.option("compression", "zstd").parquet(members)
        kept, fallen = self.spark.read.schema(MEMBER).parquet(members), gone
        # links: of rejected classes with accepted ones, and of an accepted class's further records with its first
        turned = inner.select(F.col("g1").alias("h1"), F.col("g2").alias("h2"), F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("first").alias("by"))
        both_ways = inner.select(*CLASS, "g1", "g2", F.col("first_r").alias("by")).unionByName(turned)
        by_new = both_ways.join(kept.select(F.col("h1").alias("g1"), F.col("h2").alias("g2")), ["g1", "g2"], "left_semi").select(*CLASS, "by")
        by_old = near.where("old").select(*CLASS, F.col("first_r").alias("by"))
        found = by_old.unionByName(by_new.join(fallen, CLASS, "left_semi")).unionByName(kept.select(*CLASS, F.col("first").alias("by")))
        out = stage(recs.select(*CLASS, "id").join(found, CLASS).where("by < id").select(F.col("by").alias("id_first"), F.col("id").alias("id_again")), "repeats")
        self.runs.append(run)
        self.members.append(members)
        old = self._compact()
        self._save()
        for r in old:
            self._forget(r)
        drop(classes, near, left, gone, *parts)
        return out


def repeats(df: DataFrame, id_col: str, a: str, b: str, arrived: str, path: str | None = None) -> DataFrame:
    """All iterations of a table in turn, each a batch: the IDs with the same first two fields.

    Names of iterations come to the driver: one for each batch that is added.  Without a path the history is deleted
    when all are through.
    """
    spark = df.sparkSession
    recs = records(df, id_col, a, b, [arrived], {"batch": F.substring_index(F.col(id_col), "_", 2)})
    rows = recs.count()
    ranges = 16
    while ranges * RANGE < rows * 16:  # about as many keys as a record's first sentence has where keys name two tokens
        ranges *= 2
    history = AcceptedHistory.open(spark, path, ranges, rows) if path else AcceptedHistory(spark, None, ranges, rows)
    found = []
    try:
        for name in sorted(r[0] for r in recs.select("batch").distinct().collect()):
            found.append(history.add(recs.where(F.col("batch") == name)).staged_path)
    finally:
        history.close() if path else history.delete()
    drop(recs)
    return spark.read.schema(FOUND).parquet(*found) if found else spark.createDataFrame([], FOUND)
