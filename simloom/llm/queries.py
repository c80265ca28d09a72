"""Queries of this subpackage by name, and SQL for those that DuckDB can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import abuse, history, leaks, lookalike, mixing, mixture, near_dup, neighbours, pairs, splits, sql
from .frames import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return history.repeats(table(spark, d, "selected_pairs"), "ID", "SentenceA", "SentenceB", "arrived_at")


def _split_name(c: str):
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    name = _split_name("split_name")
    side = F.when(name == "train", "train").when(name.isin("validation", "test"), "eval")
    source = F.coalesce("set_source", F.lit("unknown"))
    return pairs.records(table(spark, d, "scored_pairs"), "ID", "SentenceA", "SentenceB", extra={"side": side, "split": name, "source": source}, per=["side"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    both = pairs.cross_overlaps(_scored(spark, d), "side")
    return both.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b"))


def p2_overlap_by_split(spark: SparkSession, d: str) -> DataFrame:
    """Per evaluation split and source: its records, those that stand in train, and the pairs they make."""
    return pairs.overlap_counts(_scored(spark, d), "side", "split", "source")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    joined = mixture.clusters(table(spark, d, "sentence_vectors"), "vec_id", "embeddings")[0]
    return joined.where("node <> root").select(F.col("root").alias("vec_id_first"), F.col("node").alias("vec_id"))


def p4_clusters(spark: SparkSession, d: str) -> DataFrame:
    return mixture.described(table(spark, d, "sentence_vectors"), "vec_id", "embeddings", "Segmented_Text_EWTS")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    near = neighbours.nearest(table(spark, d, "sentence_vectors"), "vec_id", "embeddings")
    return near.select(F.least("id", "other").alias("vec_id_a"), F.greatest("id", "other").alias("vec_id_b")).distinct()


def p5_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.nearest(table(spark, d, "sentence_vectors"), "vec_id", "embeddings").withColumnRenamed("id", "vec_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    c = splits.related(table(spark, d, "merged_trainset"), "ID", "SentenceA", "SentenceB")
    return c.where("node <> root").select(F.col("root").alias("id_first"), F.col("node").alias("id_member"))


def p6_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign(table(spark, d, "merged_trainset"), "ID", "SentenceA", "SentenceB")


TEXTS = ["Segmented_Text_EWTS", "Segmented_Text"]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.alike_pairs_of_rows(table(spark, d, "segments"), "seg_no", TEXTS).toDF("seg_no_a", "seg_no_b")


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.alike_classes(table(spark, d, "segments"), "seg_no", TEXTS)


def p3_one_form(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.one_form(table(spark, d, "segments").select("seg_no", *TEXTS), TEXTS)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    c = near_dup.near_duplicates(table(spark, d, "segments"), "seg_no", "Segmented_Text_EWTS", "Segmented_Text")
    return c.where("node <> root").select(F.col("root").alias("seg_no_first"), F.col("node").alias("seg_no"))


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_dup.groups(table(spark, d, "segments"), "seg_no", "Segmented_Text_EWTS", "Segmented_Text")


GOLD = ["SentenceA", "SentenceB", "SentenceA_unicode", "SentenceB_unicode"]


def _leaked(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "gold_pairs"), "ID", GOLD)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaked(spark, d).select(F.col("id").alias("doc_id"), F.col("item").alias("item_id")).distinct()


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Per leaked item: in how many documents it stands, and the largest part of a sentence found."""
    return _leaked(spark, d).groupBy(F.col("item").alias("item_id")).agg(F.countDistinct("id").alias("documents"), F.max("coverage").alias("coverage"))


def _targets(spark: SparkSession, d: str) -> list[tuple[str, float, int]]:
    rows = table(spark, d, "mix_targets").select("source_name", "target_share", "max_repeats").dropna().limit(mixing.MOST_TARGETS + 1).collect()
    if len(rows) > mixing.MOST_TARGETS:
        raise ValueError(f"more than {mixing.MOST_TARGETS} targets")
    return sorted(tuple(r) for r in rows)


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed(table(spark, d, "documents"), "doc_id", "text", abuse.source_name("source"), _targets(spark, d))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(table(spark, d, "documents"), "doc_id", "text", abuse.source_name("source"), _targets(spark, d))


def _scored_docs(spark: SparkSession, d: str, **keep) -> DataFrame:
    labels, terms = table(spark, d, "doc_labels"), table(spark, d, "term_list")
    return abuse.scored(table(spark, d, "documents"), "doc_id", "text", labels, "doc_id", "abusive", "rater", terms, "term", "category", keep=keep)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _scored_docs(spark, d).where(F.col("score") > abuse.THRESHOLD).select(F.col("id").alias("doc_id"))


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored_docs(spark, d).withColumnRenamed("id", "doc_id")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    each = _scored_docs(spark, d, source=abuse.source_name("source"))
    bad = F.col("score") > abuse.THRESHOLD
    return each.groupBy("source").agg(F.count("*").alias("documents"), F.count_if(bad).alias("abusive"), F.avg(F.when(bad, 1.0).otherwise(0.0)).alias("rate"), F.max("score").alias("worst"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_overlap_by_split": p2_overlap_by_split,
    "p4_found": p4_found,
    "p4_clusters": p4_clusters,
    "p5_found": p5_found,
    "p5_neighbours": p5_neighbours,
    "p6_found": p6_found,
    "p6_splits": p6_splits,
    "p3_found": p3_found,
    "p3_classes": p3_classes,
    "p3_one_form": p3_one_form,
    "p8_found": p8_found,
    "p8_items": p8_items,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_scores": p10_scores,
    "p10_rates": p10_rates,
    "p7_found": p7_found,
    "p7_groups": p7_groups,
}

SQL: dict[str, str] = sql.SQL
