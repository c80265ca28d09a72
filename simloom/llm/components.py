"""Connected components by hooking and shortcutting parent tables.

Every round reads the edges that are left and a parent for each of their nodes:

* hooking: a node takes its smallest neighbour as parent if that is smaller than itself,
* shortcutting: parents are replaced by the parents' parents, twice,
* contraction: both ends of every edge are replaced by their parents; loops and repeated edges vanish.

The smallest node of a component never gets a parent, so it is what all others end at.  Rounds grow with the
logarithm of the component's diameter.  All tables stay distributed; each round's are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import drop, stage


def _clean(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge to another; root is the smallest node of its component.

    Nulls on either side and loops make no edge.  An empty table gives an empty table.
    """
    left = stage(_clean(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna()), "edges")
    maps: list[DataFrame] = []
    for _ in range(max_rounds):
        if left.isEmpty():
            break
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root"))
        parent = stage(parent, "parents")
        jumped = parent
        up = parent.select(F.col("node").alias("p"), F.col("root").alias("q")).where("p <> q")
        for _ in range(2):
            jumped = jumped.join(up, F.col("root") == F.col("p"), "left").select("node", F.coalesce("q", "root").alias("root"))
        jumped = stage(jumped.where("node <> root"), "jumped")
        maps.append(jumped)
        ja, jb = jumped.toDF("na", "ra"), jumped.toDF("nb", "rb")
        new = left.join(ja, F.col("a") == F.col("na"), "left").join(jb, F.col("b") == F.col("nb"), "left")
        new = stage(_clean(new.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))), "edges")
        drop(parent, left) if maps[1:] else drop(parent)
        if not maps[1:]:
            first = left
        left = new
    else:
        raise RuntimeError(f"components: edges left after {max_rounds} rounds")
    if not maps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    drop(left)
    nodes = first.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    out = nodes.join(maps[0], "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    for m in maps[1:]:
        out = out.join(m.toDF("p", "q"), F.col("root") == F.col("p"), "left").select("node", F.coalesce("q", "root").alias("root"))
    return out
