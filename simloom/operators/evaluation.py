"""Rows of evaluation results: correlations of scores with labels, shaped and named for the results log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine, dot, euclidean, manhattan
from .stats import kendall, pearson, spearman, with_p_value

#: Similarities of two vectors by name.
SIMILARITIES = {"cosine": cosine, "manhattan": manhattan, "euclidean": euclidean, "dot": dot}


def correlations(df: DataFrame, groups: list[str], score: str, label: str, with_kendall: bool = False, p_values: bool = False) -> DataFrame:
    """(groups..., n, pearson, spearman, kendall?, p values?): of one score with the label, rows with both only."""
    parts = [pearson(df, groups, score, label), spearman(df, groups, score, label).drop("n")]
    if with_kendall:
        parts.append(kendall(df, groups, score, label))
    if groups:
        out = reduce(lambda a, b: a.join(b, groups, "left"), parts)
    else:  # one row each
        out = reduce(lambda a, b: a.join(F.broadcast(b.withColumn("_one", F.lit(1))), "_one"), [parts[0].withColumn("_one", F.lit(1)), *parts[1:]]).drop("_one")
    for name in ("pearson", "spearman") if p_values else ():
        out = with_p_value(out, name, name=f"{name}_p")
    return out


def cross_encoder_metrics(df: DataFrame, score: str, label: str, groups: list[str] = ()) -> DataFrame:
    """Pearson, Spearman and Kendall of predicted scores with labels."""
    return correlations(df, list(groups), score, label, with_kendall=True)


def bi_encoder_metrics(df: DataFrame, a: str, b: str, label: str, groups: list[str] = (), kinds: tuple[str, ...] = tuple(SIMILARITIES)) -> DataFrame:
    """(groups..., similarity, n, pearson, spearman): of each similarity of two vectors with the label.

    The similarities are rows, not columns, so that all of them are correlated in one pass.
    """
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("similarity"), SIMILARITIES[k](F.col(a), F.col(b)).alias("score")) for k in kinds)))
    long = df.select(*groups, F.col(label).alias("_label"), each.alias("x")).select(*groups, "_label", "x.similarity", "x.score")
    return correlations(long, [*groups, "similarity"], "score", "_label")


def metric_row(metrics: DataFrame, prefix: str, kinds: tuple[str, ...] = tuple(SIMILARITIES), keep: list[str] = (), empty: float = 0.0) -> DataFrame:
    """One row for each of keep: columns prefix_correlation_similarity, empty where a correlation is missing."""
    wanted = [F.coalesce(F.max(F.when(F.col("similarity") == k, F.col(c))), F.lit(empty)).alias(f"{prefix}_{c}_{k}") for c in ("pearson", "spearman") for k in kinds]
    return metrics.groupBy(*keep).agg(*wanted)


def two_tests(first: DataFrame, second: DataFrame, keys: list[str], names: tuple[str, str] = ("test", "second_test")) -> DataFrame:
    """The metrics of two test sets side by side; rows of either are kept."""
    a, b = (d.toDF(*(c if c in keys else f"{n}_{c}" for c in d.columns)) for d, n in zip((first, second), names))
    return a.join(b, keys, "full")


def logged(metrics: DataFrame, settings: dict[str, object], epoch: int | None = None, step: int | None = None) -> DataFrame:
    """Metrics as rows of the log: with the run's settings, and the epoch or step that was evaluated."""
    what = f"epoch_{epoch}" if epoch is not None else f"step_{step}" if step is not None else "final"
    return metrics.select(*(F.lit(v).alias(k) for k, v in settings.items()), F.lit(what).alias("evaluated_model"), *metrics.columns)


def slot_statistics(annotated: DataFrame, cosines: DataFrame, slots: list[str], id_col: str = "ID", value: str = "cosine") -> DataFrame:
    """(slots, n, mean, std, min, max): of the cosines of all pairs in all slots; an ID in two slots counts twice."""
    each = annotated.select(F.explode(F.array(*slots)).alias("_id")).where("_id is not null")
    rows = each.join(cosines.select(F.col(id_col).alias("_id"), F.col(value).alias("x")), "_id", "left")
    return rows.agg(F.count("*").alias("slots"), F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))


def noise_score(tokens: str, loss: str) -> Column:
    """Tokens by summed loss: 0 for no tokens, infinite for no loss."""
    return F.when(F.col(tokens) == 0, 0.0).when(F.col(loss) == 0, float("inf")).otherwise(F.try_divide(F.col(tokens).cast("double"), F.col(loss)))


def noise_rank(p_a: str, p_b: str) -> Column:
    """Pairs of clean sentences first."""
    return -F.col(p_a) - F.col(p_b)


def setting_of(c: str) -> Column:
    """Which kind of training set a name stands for; the first that fits."""
    has = lambda w: F.contains(F.lower(F.col(c)), F.lit(w))
    both = has("gold") & (has("synth") | has("+"))
    return F.when(F.col(c).isNull() | (F.col(c) == ""), "baseline").when(both, "two-phase").when(has("gold"), "gold").otherwise("synthetic")


def single_model_rows(df: DataFrame, model: str, metrics: list[str], digits: int = 4) -> DataFrame:
    """Rows of single models with the first metric column that the table has, rounded; an error if it has none."""
    there = next((m for m in metrics if m in df.columns), None)
    if there is None:
        raise ValueError(f"none of {metrics} is a column")
    return df.where(~F.startswith(F.coalesce(F.col(model), F.lit("")), F.lit("combined"))).select(model, F.round(there, digits).alias("metric"))


def type_table(df: DataFrame, model: str, means: list[str], rows: str = "n_rows") -> DataFrame:
    """By model the mean of means and the least number of rows that one of them is of."""
    return df.groupBy(model).agg(*(F.avg(m).alias(m) for m in means), F.min(rows).alias(rows))


def ends_report(df: DataFrame, order: str, key: str, n: int = 10) -> DataFrame:
    """The n greatest and the n smallest rows by a column, ties by key, each told apart; two partial sorts."""
    top = df.orderBy(F.desc_nulls_last(order), key).limit(n).withColumn("end", F.lit("head"))
    return top.unionByName(df.orderBy(F.asc_nulls_last(order), F.desc(key)).limit(n).withColumn("end", F.lit("tail")))
