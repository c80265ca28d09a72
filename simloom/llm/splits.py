"""Problem 6: train, validation and test splits that keep related records together.

Records are tied by a sentence's content, on either side, and by the anchor named in the ID.  Components come from
hooking and shortcutting parent tables; the groups for validation and test are chosen by subset sums over the
multiplicities of group sizes, held as bits of one integer, so that totals come as close to the targets as groups allow.

Cases: rows without ID are left out; a missing sentence or one without token ties nothing; an ID of one field has no
anchor; an ID delivered more than once is one record; equal sizes are told apart by a hash of the group's smallest ID.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .frames import stage
from .text import canon, content_tokens

_FIELD = re.compile(r"[0-9]+|[^\W\d_]+")
SHARES = {"validation": 0.1, "test": 0.1}


def anchor_of(record_id: str) -> str | None:
    """All fields of an ID but the last, however written: look-alikes, case, separators and leading zeros don't count."""
    fields = _FIELD.findall(canon(record_id).casefold())
    return "_".join(f.lstrip("0") or "0" if f.isdigit() else f for f in fields[:-1]) or None


def _keys(batches):
    for batch in batches:
        ids, keys = [], []
        for i, *texts in zip(*(batch.column(c).to_pylist() for c in ("id", "a", "b"))):
            names = {"s" + " ".join(t) for s in texts if (t := content_tokens(s))}
            if anchor := anchor_of(i):
                names.add("i" + anchor)
            for n in names:
                ids.append(i)
                keys.append(xxhash.xxh3_128_digest(n.encode("utf-8", "surrogatepass")))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(keys, pa.binary())], ["id", "key"])


def ties(df: DataFrame, id_col: str, a: str, b: str) -> DataFrame:
    """(a, b): each record with the smallest record that has a key in common with it; never all pairs of a key."""
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).where("id is not null")
    keys = stage(rows.mapInArrow(_keys, "id string, key binary").distinct(), "keys")
    firsts = keys.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last").select("key", "first")
    return keys.join(firsts, "key").where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))


def related(df: DataFrame, id_col: str, a: str, b: str) -> DataFrame:
    """(node, root) for every record that is tied to another."""
    return components(ties(df, id_col, a, b))


def _subset(left: dict[int, int], target: int, unit: int) -> dict[int, int]:
    """How many groups of each size to take, so that their total in units comes closest to the target; sizes rounded up."""
    goal = target // unit
    items = []  # (units, size, how many): multiplicities by powers of two
    for size in sorted(left, reverse=True):
        n, k = left[size], 1
        while n > 0:
            k = min(k, n)
            if size * k <= 2 * target + 1:
                items.append((-(-size * k // unit), size, k))
            n -= k
            k *= 2
    mask = (1 << (2 * goal + 2)) - 1
    reach = [1]
    for units, _, _ in items:
        reach.append((reach[-1] | reach[-1] << units) & mask)
    near = (t for d in range(goal + 2) for t in ((goal - d, goal + d) if unit == 1 else (goal - d,)))  # rough steps stay below the target
    total = next((t for t in near if t >= 0 and reach[-1] >> t & 1), 0)
    taken: dict[int, int] = {}
    for k in range(len(items) - 1, -1, -1):
        units, size, n = items[k]
        if not reach[k] >> total & 1:
            total -= units
            taken[size] = taken.get(size, 0) + n
    return taken


def choose(sizes: dict[int, int], targets: list[float], bits: int = 1 << 21) -> list[dict[int, int]]:
    """For each target in turn, how many groups of each size to take so that the total comes closest to it.

    The bits of one integer stand for the totals that can be reached.  A target that needs more bits than given is first
    met to nine tenths in units, then what is left likewise, until single records fit the bits and count exactly.
    """
    left, out = dict(sizes), []
    for target in targets:
        rest, taken = round(target), {}
        while rest > 0:
            unit = max(1, -(-rest * 2 // bits))
            some = _subset(left, rest if unit == 1 else rest * 9 // 10, unit)
            for size, n in some.items():
                taken[size] = taken.get(size, 0) + n
                left[size] -= n
                rest -= size * n
            if unit == 1 or not some:
                break
        out.append(taken)
    return out


def assign(df: DataFrame, id_col: str, a: str, b: str, shares: dict[str, float] | None = None, cells: int = 1024) -> DataFrame:
    """(id, group_first, split): every record once."""
    shares = SHARES if shares is None else shares
    ids = df.select(F.col(id_col).cast("string").alias("id")).where("id is not null").distinct()
    tied = stage(related(df, id_col, a, b), "tied")
    member = stage(ids.join(tied, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("root")), "member")
    groups = stage(member.groupBy("root").agg(F.count("*").alias("size")).select("*", F.xxhash64("root").alias("h")).select("*", F.pmod("h", F.lit(cells)).alias("cell")), "sizes")
    per_size = {r[0]: r[1] for r in groups.groupBy("size").count().collect()}  # distinct sizes: at most the root of twice the records
    total = sum(s * n for s, n in per_size.items())
    taken = choose(per_size, [p * total for p in shares.values()])
    # the rank of a group among those of its size, without gathering a size in one task: counts per cell, then within the cell
    counts = groups.groupBy("size", "cell").count()
    before = counts.select("size", "cell", (F.sum("count").over(Window.partitionBy("size").orderBy("cell")) - F.col("count")).alias("before"))
    ranked = groups.join(before, ["size", "cell"]).select("root", "size", (F.col("before") + F.row_number().over(Window.partitionBy("size", "cell").orderBy("h", "root"))).alias("rank"))
    spark = df.sparkSession
    bounds, start = [], dict.fromkeys(per_size, 0)
    for name, t in zip(shares, taken):
        for size, n in t.items():
            bounds.append((size, start[size], start[size] + n, name))
            start[size] += n
    cut = spark.createDataFrame(bounds, "s long, lo long, hi long, name string")
    named = ranked.join(cut, (F.col("size") == F.col("s")) & (F.col("rank") > F.col("lo")) & (F.col("rank") <= F.col("hi")), "left").select("root", F.coalesce("name", F.lit("train")).alias("split"))
    return member.join(named, "root").select(F.col("id").alias(id_col), F.col("root").alias("group_first"), "split")
