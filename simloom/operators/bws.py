"""Best-worst scaling: tuples of four pairs, annotation, counting scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import answer_labels
from .sampling import hash_order

SLOTS = ["id_1", "id_2", "id_3", "id_4"]


def four_tuples(df: DataFrame, id_col: str, rounds: int = 2, seed: int = 42, cells: int = 256) -> DataFrame:
    """(tuple_index, id_1..id_4): in each round every ID once, in hash order cut into fours; what is left over is topped
    up with the cell's first ones.  IDs are cut within cells of the hash, so no task orders them all."""
    ids = df.select(F.col(id_col).alias("id")).where("id is not null").distinct()
    n = ids.count()
    cells = max(1, min(cells, n // 64))
    out = None
    for r in range(rounds):
        h = hash_order(f"{seed}-{r}", "id")
        placed = ids.select("id", h.alias("h")).withColumn("cell", F.pmod(F.conv(F.substring("h", 1, 8), 16, 10).cast("long"), F.lit(cells)))
        w = Window.partitionBy("cell")
        ranked = placed.select("id", "cell", (F.row_number().over(w.orderBy("h", "id")) - 1).alias("k"), F.count("*").over(w).alias("n"))
        short = F.pmod(-F.col("n"), F.lit(4))  # how many the last four lack
        extra = ranked.where((F.col("k") < short) & (F.col("n") >= 4)).select("id", "cell", (F.col("n") + F.col("k")).alias("k"), "n")
        whole = ranked.where("n >= 4").unionByName(extra)
        fours = whole.groupBy("cell", F.floor(F.col("k") / 4).alias("q")).agg(F.array_sort(F.collect_list(F.struct("k", "id"))).alias("f"))
        fours = fours.select(F.lit(r).alias("round"), "cell", "q", *(F.col("f")[i]["id"].alias(s) for i, s in enumerate(SLOTS)))
        out = fours if out is None else out.unionByName(fours)
    index = F.format_string("%02d_%04d_%06d", "round", "cell", "q")
    return out.select(index.alias("tuple_index"), *SLOTS)


def slots_of(df: DataFrame, *keep: str) -> DataFrame:
    """Four columns of IDs as rows (slot, id)."""
    return df.select(*keep, F.posexplode(F.array(*SLOTS)).alias("slot", "id"))


def with_texts(tuples: DataFrame, pairs: DataFrame, id_col: str, a: str, b: str, key: str = "tuple_index") -> DataFrame:
    """The sentences of all four pairs; NOT_FOUND for unknown IDs, empty for missing ones; of equal IDs the last by text."""
    known = pairs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.struct(a, b)).alias("t"))
    rows = slots_of(tuples, key).join(known, "id", "left")
    shown = lambda c: F.when(F.col("id").isNull() | (F.col("id") == ""), "").when(F.col("t").isNull(), "NOT_FOUND").otherwise(F.coalesce(F.col(f"t.{c}"), F.lit("")))
    wide = rows.select(key, "slot", F.struct(F.col("id"), shown(a).alias("A"), shown(b).alias("B")).alias("p")).groupBy(key).pivot("slot", [0, 1, 2, 3]).agg(F.first("p"))
    return wide.select(key, *(F.col(f"{i}")["id"].alias(f"id_{i + 1}") for i in range(4)), *(F.col(f"{i}")[x].alias(f"pair_{i + 1}_{x}") for i in range(4) for x in "AB"))


def annotated(tuples: DataFrame, scores: DataFrame, id_col: str, score: str, key: str = "tuple_index") -> DataFrame:
    """Best and worst pair of each tuple by a score; ties go to the earliest slot, IDs without score don't count."""
    known = scores.where(F.col(id_col).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(score).alias("s"))
    rows = slots_of(tuples, key).join(known, "id")
    per = rows.groupBy(key).agg(F.max(F.struct("s", -F.col("slot"), "id")).alias("best"), F.min(F.struct("s", "slot", "id")).alias("worst"))
    return tuples.join(per, key).select(key, *SLOTS, F.col("best.id").alias("best_pair"), F.col("worst.id").alias("worst_pair"))


def counting_scores(df: DataFrame, best: str = "best_pair", worst: str = "worst_pair") -> DataFrame:
    """Per ID: (best - worst) / appearances, and that rescaled to 0..1. Nulls don't count in any column."""
    shown = df.select(F.explode(F.array(*SLOTS)).alias("ID"), F.lit(1).alias("n"), F.lit(0).alias("b"), F.lit(0).alias("w"))
    chosen = df.select(F.explode(F.array(F.struct(F.col(best).alias("ID"), F.lit(0).alias("n"), F.lit(1).alias("b"), F.lit(0).alias("w")), F.struct(F.col(worst).alias("ID"), F.lit(0).alias("n"), F.lit(0).alias("b"), F.lit(1).alias("w")))).alias("x")).select("x.*")
    per = shown.unionByName(chosen).where("ID is not null").groupBy("ID").agg(F.sum("b").alias("best_count"), F.sum("w").alias("worst_count"), F.sum("n").alias("appearances")).where("appearances > 0")
    raw = (F.col("best_count") - F.col("worst_count")) / F.col("appearances")
    return per.select("*", raw.alias("raw_score"), ((raw + 1) / 2).alias("score"))


def resolved_answers(df: DataFrame, answer: str, seed: int = 42, key: str = "tuple_index") -> DataFrame:
    """The IDs an answer names; an answer without two different valid labels is replaced by two IDs in hash order."""
    most, least = answer_labels(answer)
    ids = F.array(*SLOTS)
    named = df.withColumns({"_m": most, "_l": least})
    valid = F.col("_m").isNotNull() & F.col("_l").isNotNull() & (F.get(ids, F.col("_m") - 1) != F.get(ids, F.col("_l") - 1))
    mixed = F.array_sort(F.transform(ids, lambda x: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"), x.cast("string"))).alias("h"), x.alias("id"))))
    ok = F.coalesce(valid, F.lit(False))
    return named.select(*df.columns, F.when(ok, F.get(ids, F.col("_m") - 1)).otherwise(mixed[0]["id"]).alias("best_pair"), F.when(ok, F.get(ids, F.col("_l") - 1)).otherwise(mixed[1]["id"]).alias("worst_pair"), F.when(ok, "1").otherwise("*").alias("trials"))


def still_open(tuples: DataFrame, done: DataFrame, key: str = "tuple_index") -> DataFrame:
    """Tuples without annotation: where an interrupted run goes on."""
    return tuples.join(done.select(key), key, "left_anti")


def chosen_pair(df: DataFrame, choice: str) -> Column:
    """First position (1 to 4) that holds the chosen ID; null if none does."""
    return F.nullif(F.array_position(F.array(*SLOTS), F.col(choice)), F.lit(0))
