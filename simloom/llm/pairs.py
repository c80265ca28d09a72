"""Sentence pairs that repeat one another: records of two sentences, both close in either arrangement.

A record's keys are hashes of one canonical token from each sentence, taken from the first tokens of either in an order
that puts rare ones first.  Two sentences that share four fifths of the longer one's tokens share one of these first
tokens, so records that repeat one another share a key; nothing is lost.  Records that share a key are bounded by
hashed token groups within the join, before anything is shuffled again, and verified on whole token sets.

Records of equal content (in either arrangement) are one class before any join, so copies never meet pairwise.
Sentences without a token are close to nothing: records with one take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import first_by, stage
from .near_dup import RARE, needed
from .text import Elements, content_tokens

RECORD = "id string, ea array<long>, eb array<long>"
ENTRY = ["key", "h1", "h2", "na", "nb", "xa", "xb", "sa", "sb"]
CLASS = ["h1", "h2"]


def _tokenised(batches, extra: list[str]):
    elements = Elements()

    def arrays(texts):
        flat, ends = [], [0]
        for s in texts:
            flat.extend(sorted(elements(content_tokens(s))))
            ends.append(len(flat))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))

    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("id"), arrays(batch.column("a").to_pylist()), arrays(batch.column("b").to_pylist()), *(batch.column(c) for c in extra)], ["id", "ea", "eb", *extra])


def records(df: DataFrame, id_col: str, a: str, b: str, order: list[str] = (), extra: dict[str, Column] | None = None, per: list[str] = ()) -> DataFrame:
    """(id, ea, eb, h1, h2, extra...): one row for each ID, the first by the order columns, with its content class.

    per names extra columns that make one ID several records.

    Rows without an ID, and rows of which a sentence has no token, are left out.
    """
    extra = extra or {}
    cols = [F.col(id_col).cast("string").alias("id"), *(F.col(c).alias(f"_o{k}") for k, c in enumerate(order)), F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"), *(c.alias(n) for n, c in extra.items())]
    rows = first_by(df.select(*cols).where("id is not null"), ["id", *per], *(f"_o{k}" for k in range(len(order))), "a", "b", *extra).select("id", "a", "b", *extra)
    kinds = "".join(f", {n} {rows.schema[n].dataType.simpleString()}" for n in extra)
    names = list(extra)
    out = rows.mapInArrow(lambda it: _tokenised(it, names), RECORD + kinds).where("size(ea) > 0 and size(eb) > 0")
    u = [(F.xxhash64("ea", F.lit(k)), F.xxhash64("eb", F.lit(k))) for k in (1, 2)]
    return stage(out.select("*", *(F.xxhash64(F.least(x, y), F.greatest(x, y)).alias(n) for n, (x, y) in zip(CLASS, u))), "records")


def frequent_tokens(recs: DataFrame) -> dict[int, int]:
    """Rank of the tokens that stand in more than one of RARE records; fewer than RARE times the mean length."""
    total = recs.count()
    counts = recs.select(F.explode(F.array_union("ea", "eb")).alias("e")).groupBy("e").count()
    rows = counts.where(F.col("count") * RARE > total).collect()
    return {r[0]: k for k, r in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}


def classes_of(recs: DataFrame) -> DataFrame:
    """(h1, h2, first, ea, eb): the content classes, each with its smallest ID."""
    return recs.groupBy(*CLASS).agg(F.min("id").alias("first"), F.first("ea").alias("ea"), F.first("eb").alias("eb"))


def _first_tokens(e: list[int], rank: dict[int, int]) -> list[int]:
    return sorted(e, key=lambda x: (rank.get(x, -1), x))[: len(e) - needed(len(e)) + 1]


def _groups(e: list[int]) -> int:
    bits = 0
    for x in e:
        bits |= 1 << (x * 0x9E3779B97F4A7C15 >> 58 & 63)
    return bits


def _entries(batches, rank: dict[int, int]):
    for batch in batches:
        rows, keys, info = [], [], []
        for k, (a, b) in enumerate(zip(batch.column("ea").to_pylist(), batch.column("eb").to_pylist())):
            ga, gb = _groups(a), _groups(b)
            found = {hash((x, y) if x < y else (y, x)) for x in _first_tokens(a, rank) for y in _first_tokens(b, rank)}
            keys.extend(found)
            rows.extend([k] * len(found))
            info.append((len(a), len(b), len(a) - ga.bit_count(), len(b) - gb.bit_count(), ga - (1 << 64) if ga >> 63 else ga, gb - (1 << 64) if gb >> 63 else gb))
        at, numbers = np.array(rows, np.int64), np.array(info, np.int64).reshape(-1, 6)
        ids = [batch.column(c).to_numpy()[at] for c in CLASS]
        yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.int64)), *map(pa.array, ids), *(pa.array(numbers[at, c]) for c in range(6))], ENTRY)


def entries_of(classes: DataFrame, rank: dict[int, int]) -> DataFrame:
    return classes.select(*CLASS, "ea", "eb").mapInArrow(lambda it: _entries(it, rank), ", ".join(f"{c} long" for c in ENTRY))


def _may(n1, n2, x1, x2, s1, s2) -> Column:
    bound = F.bit_count(F.col(s1).bitwiseAND(F.col(s2))) + F.least(x1, x2)
    return 5 * bound >= 4 * F.greatest(n1, n2)


def meeting(left: DataFrame, right: DataFrame, within: bool = False, also: str | None = None) -> DataFrame:
    """(h1, h2, g1, g2): classes of two sets of entries that share a key and whose bound reaches the threshold.

    also names a further column that follows from the key, by which both sides are laid out already.
    """
    r = right.select(*(F.col(c).alias(f"r_{c}") for c in [*ENTRY, *([also] if also else [])]))
    straight = _may("na", "r_na", "xa", "r_xa", "sa", "r_sa") & _may("nb", "r_nb", "xb", "r_xb", "sb", "r_sb")
    crossed = _may("na", "r_nb", "xa", "r_xb", "sa", "r_sb") & _may("nb", "r_na", "xb", "r_xa", "sb", "r_sa")
    on = (F.col("key") == F.col("r_key")) & (straight | crossed)
    if also:
        on = (F.col(also) == F.col(f"r_{also}")) & on
    if within:
        on &= (F.col("h1") < F.col("r_h1")) | ((F.col("h1") == F.col("r_h1")) & (F.col("h2") < F.col("r_h2")))
    return left.join(r, on).select(*CLASS, F.col("r_h1").alias("g1"), F.col("r_h2").alias("g2")).distinct()


def _near(x: str, y: str) -> Column:
    return 5 * F.size(F.array_intersect(x, y)) >= 4 * F.greatest(F.size(x), F.size(y))


def verified(met: DataFrame, left: DataFrame, right: DataFrame, *more: str) -> DataFrame:
    """The pairs of classes that are close, with the smallest ID of either (first, first_r)."""
    a = left.select(*CLASS, "first", "ea", "eb")
    b = right.select("h1", "h2", "first", "ea", "eb", *more).toDF("g1", "g2", "first_r", "ra", "rb", *more)
    both = met.join(a, CLASS).join(b, ["g1", "g2", *more])
    return both.where((_near("ea", "ra") & _near("eb", "rb")) | (_near("ea", "rb") & _near("eb", "ra"))).select(*CLASS, "g1", "g2", "first", "first_r", *more)


def overlapping_classes(recs: DataFrame, side: str) -> DataFrame:
    """(h1, h2, g1, g2): content classes of 'eval' records with those of 'train' records that they repeat.

    First the canonical record hashes of either side are joined, which finds all records of equal content; what is near
    but not equal comes from shared keys.
    """
    rank = frequent_tokens(recs)
    evals, trains = stage(classes_of(recs.where(F.col(side) == "eval")), "evals"), stage(classes_of(recs.where(F.col(side) == "train")), "trains")
    same = evals.select(*CLASS).join(trains.select(*CLASS), CLASS).select(*CLASS, F.col("h1").alias("g1"), F.col("h2").alias("g2"))
    met = meeting(entries_of(evals, rank), entries_of(trains, rank)).where("h1 <> g1 or h2 <> g2")
    close = verified(met, evals, trains).select(*CLASS, "g1", "g2")
    return stage(same.unionByName(close), "overlaps")


def cross_overlaps(recs: DataFrame, side: str) -> DataFrame:
    """(id, other): every record whose side is 'eval' with every record whose side is 'train' that it repeats.

    An ID on both sides is a record on either, and repeats itself if its content does.
    """
    close = overlapping_classes(recs, side)
    left = recs.where(F.col(side) == "eval").select(*CLASS, "id")
    right = recs.where(F.col(side) == "train").select("h1", "h2", "id").toDF("g1", "g2", "other")
    return close.join(left, CLASS).join(right, ["g1", "g2"]).select("id", "other")


def overlap_counts(recs: DataFrame, side: str, *by: str) -> DataFrame:
    """(by..., records, leaked, pairs): of the 'eval' records, those that repeat 'train' records, and the pairs they make.

    Pairs are counted from the sizes of content classes; none is formed.
    """
    close = overlapping_classes(recs, side)
    sizes = recs.where(F.col(side) == "train").groupBy(F.col("h1").alias("g1"), F.col("h2").alias("g2")).count()
    hits = close.join(sizes, ["g1", "g2"]).groupBy(*CLASS).agg(F.sum("count").alias("n"))
    rows = recs.where(F.col(side) == "eval").groupBy(*by, *CLASS).agg(F.count("*").alias("m")).join(hits, CLASS, "left")
    zero = F.lit(0).cast("long")
    return rows.groupBy(*by).agg(F.sum("m").alias("records"), F.coalesce(F.sum(F.when(F.col("n").isNotNull(), F.col("m"))), zero).alias("leaked"), F.coalesce(F.sum(F.col("m") * F.col("n")), zero).alias("pairs"))
