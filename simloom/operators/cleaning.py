"""Cleaning, keyed lookups and simple pairs of sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_sentence, strip


def first_per(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in a total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def clean_sentences(df: DataFrame, text: str, order: list[str], distinct: bool = True) -> DataFrame:
    """Missing texts dropped, notes and outer blanks removed, empty ones dropped; of equal ones the first stays."""
    out = df.where(F.col(text).isNotNull()).withColumn(text, clean_sentence(text)).where(F.col(text) != "")
    return first_per(out, [text], *order) if distinct else out


def clean_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """Runs of tabs become a blank; pairs with a blank side are dropped; kept texts aren't stripped."""
    out = df.withColumns({c: F.regexp_replace(c, r"\t+", " ") for c in (a, b)})
    return out.where((strip(a) != "") & (strip(b) != ""))


def with_id(df: DataFrame, id_col: str, order: list[str]) -> DataFrame:
    """An ID for tables that lack one: the position by the order columns, from 0. One task numbers block totals only."""
    if id_col in df.columns:
        return df
    blocks = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    sizes = blocks.groupBy("_p").count()
    before = sizes.select("_p", (F.sum("count").over(Window.orderBy("_p")) - F.col("count")).alias("_b"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return blocks.withColumn("_r", place).join(before, "_p").withColumn(id_col, F.col("_b") + F.col("_r")).drop("_p", "_b", "_r")


def prepared_sentences(df: DataFrame, id_col: str, text: str) -> DataFrame:
    return df.where(F.col(text).isNotNull()).select(F.col(id_col), strip(text).alias(text)).where(F.col(text) != "")


def unique_sentences(df: DataFrame, *columns: str) -> DataFrame:
    """All different texts of the columns, uncleaned."""
    return df.select(F.explode(F.array(*columns)).alias("sentence")).where("sentence is not null").distinct()


def self_pairs(df: DataFrame, text: str, clean: bool = False) -> DataFrame:
    s = df.where(F.col(text).isNotNull()).select((clean_sentence(text) if clean else F.col(text)).alias("s"))
    s = (s.where("s <> ''") if clean else s).distinct()
    return s.select(F.col("s").alias("text1"), F.col("s").alias("text2"))


def consecutive_pairs(df: DataFrame, line: str, order: list[str], text: str) -> DataFrame:
    """Each sentence with the next of its line; a missing text breaks the sequence."""
    after = F.lead(text).over(Window.partitionBy(line).orderBy(*order))
    pairs = df.where(F.col(line).isNotNull()).select(line, *order, F.col(text).alias("SentenceA"), after.alias("SentenceB"))
    return pairs.where("SentenceA is not null and SentenceB is not null")


def lookup(df: DataFrame, key: str, known: DataFrame, known_key: str, value: str, order: list, name: str) -> DataFrame:
    """The table with a looked-up column; of several values for a key the first by the order counts."""
    needed = df.select(F.col(key).alias("_k")).where("_k is not null").distinct()
    rows = known.select(F.col(known_key).alias("_k"), F.col(value).alias(name), *(F.col(o).alias(f"_o{i}") for i, o in enumerate(order))).where(f"_k is not null and {name} is not null")
    one = first_per(rows.join(needed, "_k", "left_semi"), ["_k"], *(f"_o{i}" for i in range(len(order))), name).select("_k", name)
    return df.join(one, F.col(key) == F.col("_k"), "left").drop("_k")


def in_other_script(df: DataFrame, text: str, known: DataFrame, known_text: str, known_other: str, order: list[str], name: str) -> DataFrame:
    """The other script's form of a text, or the text itself where none is known."""
    out = lookup(df, text, known, known_text, known_other, order, "_other")
    return out.withColumn(name, F.coalesce("_other", text)).drop("_other")


def unmatched_share(df: DataFrame, col: str) -> Column:
    return F.avg(F.col(col).isNull().cast("int"))


def with_scores(pairs: DataFrame, scores: DataFrame, id_col: str, score: str, most_missing: float | None = None) -> DataFrame:
    """Pairs with their scores by ID; an error if more than the given share has none. A former score column goes."""
    out = pairs.drop(score).where(F.col(id_col).isNotNull()).join(scores.select(id_col, score), id_col, "left")
    if most_missing is not None:
        missing = out.agg(unmatched_share(out, score)).first()[0]
        if missing is not None and missing > most_missing:
            raise ValueError(f"{missing:.1%} of the pairs have no score; at most {most_missing:.1%} may lack one")
    return out
