"""Algebra of result tables: folds, best epochs, upserts, pivots, ensembles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cleaning import first_per


def fold_means(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Mean, sample deviation and number of rows by configuration; null keys are a group."""
    return df.groupBy(*keys).agg(*(f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_samp))), F.count("*").alias("n_rows"))


def incomplete(df: DataFrame, folds: int = 4) -> DataFrame:
    return df.where(F.col("n_rows") != folds)


def masked(df: DataFrame, columns: list[str], least: int = 4) -> DataFrame:
    """Values from fewer rows than needed become null."""
    return df.withColumns({c: F.when(F.col("n_rows") >= least, F.col(c)) for c in columns})


def best_rows(df: DataFrame, keys: list[str], metric: str, order: list[str]) -> DataFrame:
    """The row with the greatest metric of each key; missing last, ties to the first by the order."""
    return first_per(df, keys, F.desc_nulls_last(metric), *order)


def best_flags(df: DataFrame, columns: list[str], groups: list[str] = ()) -> DataFrame:
    """Whether each value is its column's greatest within the group; maxima are joined, nothing is gathered."""
    if groups:
        tops = df.groupBy(*groups).agg(*(F.max(c).alias(f"_{c}") for c in columns))
        out = df.join(tops, list(groups))
    else:
        out = df.join(F.broadcast(df.agg(*(F.max(c).alias(f"_{c}") for c in columns))))
    return out.select(*df.columns, *((F.abs(F.col(c) - F.col(f"_{c}")) < 1e-9).alias(f"{c}_best") for c in columns))


def wrong_pairs(df: DataFrame, keys: list[str], error: str, label: str, source: str) -> DataFrame:
    """Per pair: how often it was wrong, mean error, their product, mean label, the sorted sources."""
    per = df.groupBy(*keys).agg(F.count("*").alias("times"), F.avg(F.abs(error)).alias("mean_error"), F.avg(label).alias("mean_label"), F.array_join(F.array_sort(F.collect_set(source)), ",").alias("sources"))
    return per.withColumn("disagreement", F.col("times") * F.col("mean_error"))


def pivoted(df: DataFrame, index: str, setting: str, values: list[str], metrics: list[str]) -> DataFrame:
    """Settings as columns; an error if an index has a setting twice."""
    if not df.groupBy(index, setting).count().where("count > 1").isEmpty():
        raise ValueError(f"several rows for one {index} and {setting}")
    wide = df.groupBy(index).pivot(setting, values).agg(*(F.first(m).alias(m) for m in metrics))
    return wide.toDF(index, *(f"{v}_{m}" for v in values for m in metrics)) if len(metrics) > 1 else wide.toDF(index, *(f"{v}_{metrics[0]}" for v in values))


def minmax(df: DataFrame, col: str, groups: list[str], name: str, when: Column | None = None) -> DataFrame:
    """Values scaled to 0..1 within groups; 0 where the range is below 1e-9. Only rows that meet the condition count."""
    rows = df if when is None else df.where(when)
    span = rows.groupBy(*groups).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    out = df.join(span, list(groups), "left") if groups else df.join(F.broadcast(span))
    wide = F.col("_hi") - F.col("_lo")
    scaled = F.when(wide < 1e-9, 0.0).otherwise(F.try_divide(F.col(col) - F.col("_lo"), wide))
    return out.withColumn(name, scaled if when is None else F.when(when, scaled).otherwise(F.col(col))).drop("_lo", "_hi")


def ensemble(df: DataFrame, columns: list[str], weights: list[float] | None = None, name: str = "ensemble") -> DataFrame:
    """Weighted sum of scores scaled to 0..1; equal weights unless given, not renormalised."""
    weights = weights or [1 / len(columns)] * len(columns)
    out = df
    for c in columns:
        out = minmax(out, c, [], f"_n_{c}")
    return out.withColumn(name, reduce(lambda a, b: a + b, (F.col(f"_n_{c}") * w for c, w in zip(columns, weights)))).drop(*(f"_n_{c}" for c in columns))


def upsert(log: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """New rows overwrite the first old row with the same settings (null equals null), else are added; columns are united."""
    old = log.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    fresh = new.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).distinct()
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)))
    kept = old.join(fresh, same & (F.col("_n") == 1), "left_anti").drop("_n")
    return new.unionByName(kept, allowMissingColumns=True)


def metric_sets(df: DataFrame, dataset: str, metrics: dict[str, Column]) -> DataFrame:
    """Metrics of each dataset and of all together ('aggregated')."""
    out = df.groupingSets([[F.col(dataset)], []], F.col(dataset)).agg(F.grouping(dataset).alias("_all"), *(c.alias(n) for n, c in metrics.items()))
    return out.select(F.when(F.col("_all") == 1, "aggregated").otherwise(F.col(dataset)).alias(dataset), *metrics)


def united(frames: dict[str, DataFrame], source: str) -> DataFrame:
    """All rows of all frames, columns by name, each with where it comes from."""
    parts = [f.withColumn(source, F.lit(n)) for n, f in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def side_by_side(frames: dict[str, DataFrame], key: str) -> DataFrame:
    """Frames joined on a key, rows of any kept; other columns get the frame's name."""
    named = [f.toDF(*(c if c == key else f"{n}_{c}" for c in f.columns)) for n, f in frames.items()]
    return reduce(lambda a, b: a.join(b, key, "full"), named)


def settings_grid(spark, options: dict[str, list], base: DataFrame | None = None) -> DataFrame:
    """All combinations of some options, for each row of a base table if given: rows are exploded, so no join is needed."""
    out = spark.range(1).select() if base is None else base
    for name, values in options.items():
        out = out.select("*", F.explode(F.array(*(F.lit(v) for v in values))).alias(name))
    return out
