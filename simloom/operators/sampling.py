"""Deterministic sampling, binning and selection. Order comes from hashes of seed and key, so it is the same anywhere."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import word_distance
from .cleaning import with_id
from .stats import quantiles


def hash_order(seed: int | str, *keys: str) -> Column:
    """md5 of seed and keys: a total order that any engine can repeat."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))


def sample(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """The first n rows in hash order; all rows, in that order, if there are fewer."""
    return df.orderBy(hash_order(seed, key), key).limit(n)


def edges(df: DataFrame, col: str, bins: int) -> tuple[float, float] | None:
    lo, hi = df.agg(F.min(col), F.max(col)).first()
    return None if lo is None else (lo, hi)


def minmax_bins(df: DataFrame, col: str, bins: int, name: str = "bin") -> DataFrame:
    """Equal-width bins between the smallest and the greatest value; all in bin 0 if those are equal; null in the last."""
    found = edges(df, col, bins)
    if found is None or found[0] == found[1]:
        return df.withColumn(name, F.lit(0))
    lo, hi = found
    inner = [lo + (hi - lo) * k / bins for k in range(1, bins)]
    place = sum((F.when(F.col(col) >= e, 1).otherwise(0) for e in inner), F.lit(0))
    return df.withColumn(name, F.when(F.col(col).isNull(), bins - 1).otherwise(place).cast("int"))


def bin_stats(df: DataFrame, col: str, name: str = "bin") -> DataFrame:
    return df.groupBy(name).agg(F.count("*").alias("count"), F.min(col).alias("min"), F.max(col).alias("max"))


def quantile_bins(df: DataFrame, col: str, bins: int, name: str = "bin") -> DataFrame:
    """Bins between distinct quantiles (linear interpolation), closed on the right."""
    cuts = quantiles(df, col, [k / bins for k in range(bins + 1)]) or []
    inner = sorted(set(cuts))[1:-1]
    return df.withColumn(name, sum((F.when(F.col(col) > e, 1).otherwise(0) for e in inner), F.lit(0)).cast("int"))


def _capped(df: DataFrame, group: str, most: int, seed: int, key: str) -> DataFrame:
    """The first rows of each group in hash order; partial limits come before the shuffle."""
    order = Window.partitionBy(group).orderBy(hash_order(seed, key), key)
    return df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def balanced_pick(df: DataFrame, k: int, bins: int, group: str, seed: int, key: str) -> DataFrame:
    """k rows, as many from each bin as there are, up to k // bins; what lacks comes from the rest in hash order."""
    first = _capped(df, group, k // bins, seed, key)
    n = first.count()
    if n >= k:
        return first.limit(k)
    rest = df.join(first.select(F.col(key).alias("_taken")), F.col(key) == F.col("_taken"), "left_anti")
    return first.unionByName(sample(rest, k - n, seed, key))


def quota_pick(df: DataFrame, k: int, group: str, seed: int, key: str) -> DataFrame:
    """k rows, k // u from each of the u groups and one more from the first k % u; an error if a group is too small."""
    groups = sorted((r[0], r[1]) for r in df.groupBy(group).count().collect())  # a row for each bin
    if not groups:
        return df
    each, more = divmod(k, len(groups))
    quota = {g: each + (i < more) for i, (g, _) in enumerate(groups)}
    if short := [g for g, n in groups if n < quota[g]]:
        raise ValueError(f"groups {short} hold fewer rows than their quota")
    most = F.create_map(*(F.lit(x) for kv in quota.items() for x in kv))
    order = Window.partitionBy(group).orderBy(hash_order(seed, key), key)
    return df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most[F.col(group)]).drop("_n")


def split_by_pick(df: DataFrame, picked: DataFrame, key: str) -> DataFrame:
    """All rows, told apart by whether they were picked."""
    marks = picked.select(F.col(key).alias("_k"), F.lit(True).alias("selected"))
    return df.join(marks, F.col(key) == F.col("_k"), "left").drop("_k").withColumn("selected", F.coalesce("selected", F.lit(False)))


def spread_pick(df: DataFrame, k: int, col: str, key: str, cells: int = 4096) -> DataFrame:
    """k rows evenly spaced in the order of a column (ties by key): positions are the whole parts of k steps over n rows.

    Rows are placed by counts per cell of the column's range and by their place within the cell, so no task sorts all.
    """
    rows = df.where(F.col(col).isNotNull())
    lo, hi, n = rows.agg(F.min(col), F.max(col), F.count("*")).first()
    if not n:
        return rows
    wide = (hi - lo) or 1.0
    placed = rows.withColumn("_c", F.least(F.floor((F.col(col) - lo) / wide * cells), F.lit(cells - 1)))
    sizes = placed.groupBy("_c").count()
    before = sizes.select("_c", (F.sum("count").over(Window.orderBy("_c")) - F.col("count")).alias("_b"))  # at most so many cells
    want = sorted({int(i * (n - 1) / (k - 1)) if k > 1 else 0 for i in range(k)})
    ranked = placed.join(F.broadcast(before), "_c").withColumn("place", F.col("_b") + F.row_number().over(Window.partitionBy("_c").orderBy(col, key)) - 1)
    wanted = df.sparkSession.createDataFrame([(w,) for w in want], "place long")
    return ranked.join(F.broadcast(wanted), "place", "left_semi").drop("_c", "_b")


def decayed_threshold(iteration: int, least: float, most: float, iterations: int, fixed: bool = False) -> float:
    """The bar falls from most to least with the logarithm of the iteration; fixed keeps it at most; iteration 0 admits nothing."""
    if fixed:
        return most
    return math.inf if iteration == 0 else most - (most - least) / math.log(iterations) * math.log(iteration)


def pair_id(iteration: int, batch: str, local: str, rank: str) -> Column:
    """Iteration, batch, place within it and the neighbour's rank; ascending order is the order of drawing."""
    return F.format_string(f"pair_{iteration:04d}_%03d_%03d_%02d", batch, local, rank)


def beta_thresholds(batches: int, least: float, most: float, a: float | None, b: float | None, seed: int) -> list[float]:
    """A bar for each batch: most less a Beta-distributed part of the span; without a or b it is least."""
    if not a or not b:
        return [least] * batches
    rng = np.random.default_rng(seed)
    return [most - float(x) * (most - least) for x in rng.beta(a, b, batches)]


def sampled_similar_pairs(queries: DataFrame, near: DataFrame, texts: DataFrame, id_col: str, text: str, k: int, iteration: int = 1, least: float = 0.88, most: float = 0.98, per_batch: int = 250, more_words: int = 5, a: float | None = None, b: float | None = None, seed: int = 42, seen: DataFrame | None = None) -> DataFrame:
    """(ID, q, c, sim, SentenceA, SentenceB): k pairs of a query and one of its neighbours, drawn batch by batch.

    Queries come in hash order and in batches of per_batch; each batch has its own bar when a and b are given.  A query's
    neighbours (near has q, c, sim) are visited in hash order; the first that reaches the bar, is no pair of seen (q, c)
    and differs by more words than given makes the pair.  Places are numbered by ranges of the order, not by one task.
    """
    placed = with_id(queries.select(F.col(id_col).alias("q")).where("q is not null").distinct().withColumn("_h", hash_order(seed, "q")), "_place", ["_h", "q"])
    placed = placed.select("q", F.floor(F.col("_place") / per_batch).cast("int").alias("batch"), "_place")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "c")) - 1).join(placed, "q").where("q <> c")
    if a and b:
        n = placed.agg(F.max("batch")).first()[0]
        bars = F.array(*(F.lit(x) for x in beta_thresholds((n if n is not None else -1) + 1 or 1, least, most, a, b, seed)))
        close = ranked.where(F.col("sim") >= F.get(bars, F.col("batch")))
    else:
        close = ranked.where(F.col("sim") >= least)
    if seen is not None:
        close = close.join(seen.select("q", "c"), ["q", "c"], "left_anti")
    t = texts.select(F.col(id_col).alias("_id"), F.col(text).alias("_t"))
    far = close.join(t.toDF("q", "SentenceA"), "q").join(t.toDF("c", "SentenceB"), "c").where(word_distance("SentenceA", "SentenceB") > more_words)
    one = far.withColumn("_n", F.row_number().over(Window.partitionBy("q").orderBy(hash_order(seed, "q", "c"), "c"))).where("_n = 1")
    first = one.orderBy("_place").limit(k)
    local = F.row_number().over(Window.partitionBy("batch").orderBy("_place")) - 1
    return first.withColumn("_local", local).select(pair_id(iteration, "batch", "_local", "rank").alias("ID"), "q", "c", "sim", "SentenceA", "SentenceB")


def cluster_sizes(member: DataFrame, clusters: int, name: str = "cluster") -> DataFrame:
    """(cluster, count) of all clusters, empty ones included."""
    every = member.sparkSession.range(clusters).select(F.col("id").cast("int").alias(name))
    return every.join(member.groupBy(F.col(name).alias("_c")).count(), F.col(name) == F.col("_c"), "left").select(name, F.coalesce("count", F.lit(0).cast("long")).alias("count"))


def bin_report(df: DataFrame, picked: DataFrame, col: str, key: str, name: str = "bin") -> DataFrame:
    """bin_stats with how many of each bin were picked, 0 where none."""
    chosen = df.join(picked.select(F.col(key).alias("_k")), F.col(key) == F.col("_k"), "left_semi").groupBy(F.col(name).alias("_b")).agg(F.count("*").alias("count_selected"))
    return bin_stats(df, col, name).join(chosen, F.col(name) == F.col("_b"), "left").drop("_b").withColumn("count_selected", F.coalesce("count_selected", F.lit(0).cast("long")))


def sampled_cluster_pairs(df: DataFrame, id_col: str, vec: str, k: int = 250, clusters: int = 10, pairs: int = 4000, bins: int = 10, seed: int = 42) -> dict[str, DataFrame]:
    """Five tables of one draw: all pairs with their bin, the k picked and the others, bin statistics, cluster sizes."""
    drawn = cluster_pairs(df, id_col, vec, clusters, pairs, seed)
    every = minmax_bins(drawn.withColumn("ID", F.format_string("pair_%02d_%02d_%s_%s", "cluster_a", "cluster_b", F.col("id_a").cast("string"), F.col("id_b").cast("string"))), "cosine_norm", bins)
    picked = balanced_pick(every, k, bins, "bin", seed, "ID")
    marked = split_by_pick(every, picked, "ID")
    ends = every.select(F.explode(F.array(F.struct(F.col("cluster_a").alias("cluster"), F.col("id_a").alias("id")), F.struct(F.col("cluster_b").alias("cluster"), F.col("id_b").alias("id")))).alias("x")).select("x.*").distinct()
    return {"all_pairs": every, "selected": marked.where("selected").drop("selected"), "not_selected": marked.where("not selected").drop("selected"), "bins": bin_report(every, picked, "cosine_norm", "ID"), "sizes": cluster_sizes(ends, clusters)}


def distant_pairs(near: DataFrame, texts: DataFrame, id_col: str, text: str, least: float, more_words: int, k: int, seed: int) -> DataFrame:
    """Sampled pairs: each query's first neighbour, in hash order, that is near enough and differs by more words.

    near has (q, c, sim).  Queries come in hash order and the first k pairs stay.
    """
    t = texts.select(F.col(id_col).alias("_id"), F.col(text).alias("_t"))
    close = near.where((F.col("sim") >= least) & (F.col("q") != F.col("c")))  # the cheap test first
    a, b = t.toDF("q", "SentenceA"), t.toDF("c", "SentenceB")
    far = close.join(a, "q").join(b, "c").where(word_distance("SentenceA", "SentenceB") > more_words)
    one = far.withColumn("_n", F.row_number().over(Window.partitionBy("q").orderBy(hash_order(seed, "q", "c"), "c"))).where("_n = 1").drop("_n")
    return one.orderBy(hash_order(seed, "q"), "q").limit(k)


def random_pairs(df: DataFrame, id_col: str, text: str, k: int, more_words: int, seed: int, tries: int = 20) -> DataFrame:
    """Pairs of rows that a hash throws together: in each of some rounds neighbours in hash order form pairs.

    Rounds go on until k pairs are there or tries pairs were drawn for each wanted one; a table without more pairs than
    that gives all of them.  Pairs that came before and pairs that differ by too few words are dropped; the first k by
    hash stay.  The numbers of k pairs are collected.
    """
    rows = df.select(F.col(id_col).alias("_id"), F.col(text).alias("_t")).where("_t is not null")
    n = rows.count()
    ends = ["id_a", "id_b", "SentenceA", "SentenceB"]
    order = [hash_order(seed, "id_a", "id_b"), F.col("id_a"), F.col("id_b")]

    def far(pairs: DataFrame) -> DataFrame:
        return pairs.where(word_distance("SentenceA", "SentenceB") > more_words).dropDuplicates(["id_a", "id_b"])

    def first(pairs: DataFrame) -> list:
        return far(pairs.where("id_a <> id_b")).orderBy(*order).limit(k).select("id_a", "id_b").collect()

    if n * (n - 1) // 2 <= tries * k:
        every = rows.agg(F.sort_array(F.collect_list(F.struct("_id", "_t"))).alias("all")).select("all", F.posexplode("all").alias("i", "x"))
        every = every.select("x", F.explode(F.slice("all", F.col("i") + 2, F.lit(max(n, 1)))).alias("y"))
        found = first(every.select("x._id", "y._id", "x._t", "y._t").toDF(*ends))
    else:
        cells = max(1, min(65536, n // 64))
        most = -(-tries * k // (n - cells))
        rounds, found = max(1, min(most, -(-2 * k // (n - cells)))), []
        while True:
            mixed = rows.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
            mixed = mixed.withColumn("_h", F.md5(F.concat_ws("|", F.concat(F.lit(f"{seed}-"), "_r"), F.col("_id").cast("string"))))
            mixed = mixed.withColumn("_cell", F.pmod(F.xxhash64("_h"), F.lit(cells)))
            after = Window.partitionBy("_r", "_cell").orderBy("_h", "_id")
            p = mixed.select("_id", "_t", F.lead("_id").over(after).alias("o"), F.lead("_t").over(after).alias("ot")).where("o is not null")
            ahead = F.col("_id") < F.col("o")
            found = first(p.select(F.least("_id", "o"), F.greatest("_id", "o"), F.when(ahead, F.col("_t")).otherwise(F.col("ot")), F.when(ahead, F.col("ot")).otherwise(F.col("_t"))).toDF(*ends))
            if len(found) >= k or rounds >= most:
                break
            rounds = min(most, 2 * rounds)
    kind = rows.schema["_id"].dataType.simpleString()
    keys = F.broadcast(df.sparkSession.createDataFrame(found, f"id_a {kind}, id_b {kind}"))
    with_a = rows.toDF("id_a", "SentenceA").join(keys, "id_a")
    both = rows.toDF("id_b", "SentenceB").join(F.broadcast(with_a), "id_b")  # k rows
    return far(both.select(*ends)).orderBy(*order).limit(k).withColumn("FaissDistance", F.lit(None).cast("double"))


def cluster_pairs(df: DataFrame, id_col: str, vec: str, clusters: int, pairs: int, seed: int, tries: int = 10) -> DataFrame:
    """Pairs drawn across and within spherical k-means clusters: (cluster_a, cluster_b, id_a, id_b, cosine_norm).

    Of tries runs of k-means, with seeds of their own, the one of least training cost counts.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from ..functions.vectors import as_doubles, cosine01

    rows = df.where(F.col(vec).isNotNull()).select(F.col(id_col).alias("id"), as_doubles(vec).alias("v")).withColumn("features", array_to_vector("v"))
    models = [KMeans(k=clusters, distanceMeasure="cosine", maxIter=50, seed=seed + i).fit(rows) for i in range(tries)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    member = best.transform(rows).select("id", "v", F.col("prediction").alias("cluster"))
    place = Window.partitionBy("cluster").orderBy(hash_order(seed, "id"), "id")
    member = member.withColumn("place", F.row_number().over(place) - 1)
    sizes = [(r[0], r[1]) for r in member.groupBy("cluster").count().collect()]  # a row for each cluster
    spark = df.sparkSession
    combos = spark.createDataFrame([(a, b, na, nb) for a, na in sizes for b, nb in sizes if a <= b], "cluster_a int, cluster_b int, na long, nb long")
    draws = combos.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(pairs))))
    draws = draws.select("cluster_a", "cluster_b", F.pmod(F.xxhash64(F.lit(seed), "cluster_a", "cluster_b", "draw", F.lit("a")), "na").alias("pa"), F.pmod(F.xxhash64(F.lit(seed), "cluster_a", "cluster_b", "draw", F.lit("b")), "nb").alias("pb"))
    a = member.select(F.col("cluster").alias("cluster_a"), F.col("place").alias("pa"), F.col("id").alias("id_a"), F.col("v").alias("va"))
    b = member.select(F.col("cluster").alias("cluster_b"), F.col("place").alias("pb"), F.col("id").alias("id_b"), F.col("v").alias("vb"))
    both = draws.join(a, ["cluster_a", "pa"]).join(b, ["cluster_b", "pb"]).where("id_a <> id_b")
    once = both.withColumns({"lo": F.least("id_a", "id_b"), "hi": F.greatest("id_a", "id_b")}).dropDuplicates(["lo", "hi"])
    return once.select("cluster_a", "cluster_b", "id_a", "id_b", cosine01(F.col("va"), F.col("vb")).alias("cosine_norm"))


def label_sets(near: DataFrame, words: DataFrame, id_col: str, text: str, per_anchor: int, mean_of: int, anchors: int, closer_than: int | None, ascending: bool = True) -> DataFrame:
    """Anchors with candidates that no two anchors share: (anchor, rank, candidate, sim, mean_sim).

    Near duplicates of the anchor (at most closer_than words apart) are no candidates; anchors need enough of them and
    are taken greedily by the mean similarity of the first ones.  The choice walks over anchors in order and holds
    anchors x per_anchor numbers of those that can still be chosen, so the anchors are a bounded set of queries.
    """
    t = words.select(F.col(id_col).alias("_id"), F.col(text).alias("_t"))
    pool = near.where("q <> c")
    if closer_than is not None:
        pool = pool.join(t.toDF("q", "_a"), "q").join(t.toDF("c", "_b"), "c").where(word_distance("_a", "_b") > closer_than).drop("_a", "_b")
    ranked = pool.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "c"))).where(F.col("rank") <= max(per_anchor, mean_of))
    sets = ranked.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("rank", "c", "sim"))).alias("found")).where(F.size("found") >= max(per_anchor, mean_of))
    mean = F.aggregate(F.slice("found", 1, mean_of), F.lit(0.0), lambda s, x: s + x["sim"]) / mean_of
    ordered = sets.select("q", mean.alias("mean_sim"), F.slice("found", 1, per_anchor).alias("found")).orderBy(F.asc("mean_sim") if ascending else F.desc("mean_sim"), "q")
    used, taken, out = set(), 0, []
    for row in ordered.toLocalIterator():
        ids = [x["c"] for x in row["found"]]
        if taken >= anchors:
            break
        if row["q"] in used or not used.isdisjoint(ids):
            continue
        used |= {row["q"], *ids}
        taken += 1
        out += [(row["q"], k + 1, x["c"], x["sim"], row["mean_sim"]) for k, x in enumerate(row["found"])]
    return near.sparkSession.createDataFrame(out, "anchor long, rank int, candidate long, sim double, mean_sim double")


def candidate_pool(near: DataFrame, texts: DataFrame, id_col: str, text: str, pool: int = 100, search: int = 100, closer_than: int | None = 5) -> DataFrame:
    """(q, c, sim, rank): each anchor's pool. Of the search + 1 nearest the first counts as the anchor itself and goes;
    near duplicates (at most closer_than words apart; None keeps them) go; the pool nearest that are left stay."""
    if pool > search:
        raise ValueError("search must be at least pool")
    order = Window.partitionBy("q").orderBy(F.desc("sim"), "c")
    rest = near.withColumn("_r", F.row_number().over(order)).where((F.col("_r") > 1) & (F.col("_r") <= search + 1)).drop("_r")
    if closer_than is not None:
        t = texts.select(F.col(id_col).alias("_id"), F.col(text).alias("_t"))
        rest = rest.join(t.toDF("q", "_a"), "q").join(t.toDF("c", "_b"), "c").where(word_distance("_a", "_b") > closer_than).drop("_a", "_b")
    return rest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= pool).select("q", "c", "sim", "rank")


def shuffled_numbers(sets: DataFrame, anchor: str, candidate: str, seed: int = 1337) -> DataFrame:
    """The candidates with a number in hash order within their anchor, so that the list doesn't tell their rank."""
    order = Window.partitionBy(anchor).orderBy(hash_order(seed, anchor, candidate), candidate)
    return sets.withColumn("shuffled", F.row_number().over(order))


def wide_candidates(sets: DataFrame, anchor: str, rank: str, final: int, **values: str) -> DataFrame:
    """One row for each anchor with columns cand_01_<name> on; anchors with fewer candidates have nulls."""
    wanted = [F.max(F.when(F.col(rank) == k, F.col(c))).alias(f"cand_{k:02d}_{n}") for k in range(1, final + 1) for n, c in values.items()]
    return sets.groupBy(anchor).agg(*wanted)


def anchor_blocks(sets: DataFrame, anchor: str, number: str, candidate: str) -> DataFrame:
    """(block, row, type, id): the anchor's row before its candidates' rows, in the order of their number."""
    head = sets.select(F.col(anchor).alias("block"), F.lit(0).alias("row"), F.lit("anchor").alias("type"), F.col(anchor).alias("id")).distinct()
    return head.unionByName(sets.select(F.col(anchor).alias("block"), F.col(number).alias("row"), F.lit("candidate").alias("type"), F.col(candidate).alias("id")))
