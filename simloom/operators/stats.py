"""Statistics of scores and vectors. NaN counts as missing; constant columns have no correlation (null)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUANTILES = [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]


def correlation(a: str, b: str) -> Column:
    """Pearson's r within a group; null where either column is constant."""
    return F.when((F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0), F.corr(a, b))


def pearson(df: DataFrame, groups: list[str], a: str, b: str, name: str = "pearson") -> DataFrame:
    """(groups..., n, name): one aggregation with partial sums; null where a column is constant in its group."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*groups, F.col(a).cast("double").alias(a), F.col(b).cast("double").alias(b))
    vary = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    return rows.groupBy(*groups).agg(F.count("*").alias("n"), F.when(vary, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))).alias(name))


def p_value(r: float | None, n: int) -> float | None:
    """Two-sided chance of a correlation at least as strong where there is none: Student's t by the incomplete beta function."""
    if r is None or n < 3:
        return None
    if r == 0:
        return 1.0
    if abs(r) >= 1:
        return 0.0
    x, a = 1 - r * r, (n - 2) / 2  # the value is I_x(a, 1/2)

    def fraction(a: float, b: float, x: float) -> float:  # continued fraction of the incomplete beta function
        tiny, c, d = 1e-300, 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
        out = d
        for m in range(1, 500):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / ((1 + num * d) or tiny)
                c = (1 + num / c) or tiny
                out *= c * d
            if abs(c * d - 1) < 1e-15:
                break
        return out

    front = math.exp(math.lgamma(a + 0.5) - math.lgamma(a) - math.lgamma(0.5) + a * math.log(x) + 0.5 * math.log1p(-x)) if x > 0 else 0.0
    return front * fraction(a, 0.5, x) / a if x < (a + 1) / (a + 2.5) else 1 - front * fraction(0.5, a, 1 - x) / 0.5


def with_p_value(df: DataFrame, r: str, n: str = "n", name: str = "p_value") -> DataFrame:
    """A correlation table (a row for each group) with the p-value of one of its columns."""

    @F.pandas_udf("double")
    def run(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([p_value(None if pd.isna(x) else x, int(m)) for x, m in zip(r, n)], dtype="float64")

    return df.withColumn(name, run(r, n))


def average_ranks(df: DataFrame, groups: list[str], col: str, name: str, cells: int = 1024) -> DataFrame:
    """Average ranks within each group. Ranks come from counts of values, summed by cells of the value's range first,
    so neither a group nor a frequent value is gathered in one task."""
    values = df.groupBy(*groups, F.col(col).alias("_v")).agg(F.count("*").alias("_n"))
    span = values.groupBy(*groups).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    celled = values.join(span, groups) if groups else values.join(F.broadcast(span))
    celled = celled.withColumn("_c", F.least(F.floor(F.coalesce(F.try_divide(F.col("_v") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0)) * cells), F.lit(cells - 1)))
    sums = celled.groupBy(*groups, "_c").agg(F.sum("_n").alias("_s"))
    before = sums.select(*groups, "_c", (F.sum("_s").over(Window.partitionBy(*groups).orderBy("_c")) - F.col("_s")).alias("_b"))
    within = F.sum("_n").over(Window.partitionBy(*groups, "_c").orderBy("_v")) - F.col("_n")
    ranks = celled.join(before, [*groups, "_c"]).select(*groups, "_v", (F.col("_b") + within + (F.col("_n") + 1) / 2).alias(name))
    return df.join(ranks.withColumnRenamed("_v", col), [*groups, col])


def spearman(df: DataFrame, groups: list[str], a: str, b: str) -> DataFrame:
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*groups, F.col(a).cast("double").alias(a), F.col(b).cast("double").alias(b))
    ranked = average_ranks(average_ranks(rows, groups, a, "_ra"), groups, b, "_rb")
    return pearson(ranked, groups, "_ra", "_rb", "spearman")


def _discordant(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[int, int]:
    """Concordant minus discordant pairs, by merging halves; and their number. Points are distinct, n how often each."""
    order = np.lexsort((y, x))
    x, y, n = x[order], np.unique(y[order], return_inverse=True)[1], n[order].astype(np.int64)
    tree = np.zeros(y.max() + 2, np.int64)

    def below(i):
        s = 0
        while i > 0:
            s += tree[i]
            i -= i & -i
        return s

    total, seen, start = 0, 0, 0
    ends = np.append(np.flatnonzero(np.diff(x)) + 1, len(x))
    for end in ends:
        for k in range(start, end):
            less = below(y[k])
            total += int(n[k]) * int(2 * less + (below(y[k] + 1) - less) - seen)
        for k in range(start, end):
            i = y[k] + 1
            while i < len(tree):
                tree[i] += n[k]
                i += i & -i
            seen += int(n[k])
        start = end
    return total, seen


def kendall(df: DataFrame, groups: list[str], a: str, b: str) -> DataFrame:
    """Kendall's tau-b of each group, over counts of distinct points; a task holds one group's distinct points."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    points = rows.groupBy(*groups, F.col(a).cast("double").alias("_x"), F.col(b).cast("double").alias("_y")).agg(F.count("*").alias("_n"))
    if not groups:
        points, groups = points.withColumn("_g", F.lit(1)), ["_g"]
    fields = ", ".join(f"{g} {points.schema[g].dataType.simpleString()}" for g in groups)

    def tau(key, t):
        x, y, n = (t.column(c).to_numpy() for c in ("_x", "_y", "_n"))
        net, total = _discordant(x, y, n)
        pairs = total * (total - 1) / 2
        ties = [sum(c * (c - 1) / 2 for c in np.bincount(np.unique(v, return_inverse=True)[1], n)) for v in (x, y)]
        under = np.sqrt((pairs - ties[0]) * (pairs - ties[1]))
        return pa.table({**{g: pa.array([k.as_py()], k.type) for g, k in zip(groups, key)}, "kendall": pa.array([net / under if under > 0 else None], pa.float64())})

    out = points.groupBy(*groups).applyInArrow(tau, f"{fields}, kendall double")
    return out.drop("_g")


def quantiles(df: DataFrame, col: str, shares: list[float], cells: int = 4096) -> list[float] | None:
    """Exact quantiles by linear interpolation. Cells of the value's range are counted first; only the cells that hold a
    wanted place are sorted, each by itself. The driver gets the cells' counts and the two values of each share."""
    rows = df.select(F.col(col).cast("double").alias("v")).where("v is not null")
    lo, hi, n = rows.agg(F.min("v"), F.max("v"), F.count("*")).first()
    if not n:
        return None
    cell = F.least(F.floor((F.col("v") - lo) / ((hi - lo) or 1.0) * cells), F.lit(cells - 1)).cast("int")
    counts = dict(rows.groupBy(cell.alias("c")).count().collect())
    places = sorted({p for q in shares for p in (math.floor(q * (n - 1)), math.ceil(q * (n - 1)))})
    before, total, wanted = {}, 0, {}
    for c in sorted(counts):
        before[c] = total
        total += counts[c]
        if inside := [p for p in places if before[c] <= p < total]:
            wanted[c] = inside
    start = F.create_map(*(F.lit(x) for c in wanted for x in (c, before[c])))
    some = rows.withColumn("c", cell).where(F.col("c").isin(list(wanted))).groupBy("c", "v").agg(F.count("*").alias("n"))
    ends = some.withColumn("end", start[F.col("c")] + F.sum("n").over(Window.partitionBy("c").orderBy("v")))
    hit = F.exists(F.array(*(F.lit(p) for p in places)), lambda p: (p >= F.col("end") - F.col("n")) & (p < F.col("end")))
    found = sorted((r["end"], r["v"]) for r in ends.where(hit).select("end", "v").collect())
    at = lambda p: next(v for end, v in found if p < end)
    out = []
    for q in shares:
        x = q * (n - 1)
        a, b = at(math.floor(x)), at(math.ceil(x))
        out.append(a + (b - a) * (x - math.floor(x)))
    return out


def described(df: DataFrame, col: str, groups: list[str] = (), population: bool = True) -> DataFrame:
    """Count, mean, deviation, extremes and nine quantiles (linear interpolation); with groups each group's distinct
    values are held by one task."""
    spread = F.stddev_pop(col) if population else F.stddev_samp(col)
    basic = [F.count(col).alias("n"), F.avg(col).alias("mean"), spread.alias("std"), F.min(col).alias("min"), F.max(col).alias("max")]
    names = [f"q{round(q * 100):02d}" for q in QUANTILES]
    if not groups:
        values = quantiles(df, col, QUANTILES) or [None] * len(QUANTILES)
        return df.agg(*basic).select("*", *(F.lit(v).cast("double").alias(name) for v, name in zip(values, names)))
    cut = F.percentile(col, F.array(*(F.lit(q) for q in QUANTILES)))
    out = df.groupBy(*groups).agg(*basic, cut.alias("_q"))
    return out.select(*groups, "n", "mean", "std", "min", "max", *(F.col("_q")[i].alias(name) for i, name in enumerate(names)))


def finite_percentiles(df: DataFrame, col: str, shares: list[float]) -> list[float] | None:
    """Quantiles of the values that are numbers and finite."""
    return quantiles(df.where(~F.isnan(col) & (F.abs(col) < float("inf"))), col, shares)


def dimension_stats(df: DataFrame, vec: str) -> DataFrame:
    """Mean and population deviation of each dimension; partial sums come before the shuffle."""
    each = df.where(F.col(vec).isNotNull()).select(F.posexplode(F.col(vec).cast("array<double>")).alias("dim", "x"))
    return each.groupBy("dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


def histogram(df: DataFrame, col: str, bins: int, lo: float, hi: float) -> DataFrame:
    """(bin, from, to, count): equal steps of a given range, empty ones included; values outside are left out."""
    wide = (hi - lo) / bins
    inside = df.where((F.col(col) >= lo) & (F.col(col) <= hi)).groupBy(F.least(F.floor((F.col(col) - lo) / wide), F.lit(bins - 1)).cast("int").alias("_b")).count()
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(inside, F.col("bin") == F.col("_b"), "left").select("bin", (lo + F.col("bin") * wide).alias("from"), (lo + (F.col("bin") + 1) * wide).alias("to"), F.coalesce("count", F.lit(0).cast("long")).alias("count"))


def random_index_pairs(n: int, pairs: int, seed: int, spark) -> DataFrame:
    """(draw, i, j): pairs of places below n by hash, i <> j; the draws that fall together are left out."""
    draw = spark.range(pairs).select(F.col("id").alias("draw"), *(F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}{c}"), "id")), 1, 12), 16, 10).cast("long"), F.lit(n)).alias(c) for c in "ij"))
    return draw.where("i <> j")


def isolation(counts: DataFrame, close: str = "close") -> DataFrame:
    """(median, mean, isolated): of neighbour counts, and the share of rows without any."""
    middle = quantiles(counts, close, [0.5]) or [None]
    return counts.agg(F.lit(middle[0]).cast("double").alias("median"), F.avg(close).alias("mean"), F.avg((F.col(close) == 0).cast("int")).alias("isolated"))


def principal_plane(df: DataFrame, vec: str, keep: list[str], axes: int = 2) -> DataFrame:
    """(keep..., x): every vector's coordinates on the leading principal axes; missing vectors are left out."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = df.where(F.col(vec).isNotNull()).select(*keep, array_to_vector(F.col(vec).cast("array<double>")).alias("_v"))
    return PCA(k=axes, inputCol="_v", outputCol="_x").fit(rows).transform(rows).select(*keep, vector_to_array("_x").alias("x"))


def whitening(df: DataFrame, vec: str) -> tuple[np.ndarray, np.ndarray]:
    """Mean and whitening matrix from sums over all rows; the driver gets one row per task of D x D numbers."""

    def sums(batches):
        n, s, q = 0, None, None
        for batch in batches:
            x = np.array([v for v in batch.column("v").to_pylist() if v is not None], np.float64)
            if len(x):
                n, s, q = n + len(x), x.sum(0) + (0 if s is None else s), x.T @ x + (0 if q is None else q)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tolist()]), pa.array([q.ravel().tolist()])], ["n", "s", "q"])

    rows = df.select(F.col(vec).cast("array<double>").alias("v")).mapInArrow(sums, "n long, s array<double>, q array<double>").collect()
    n = sum(r[0] for r in rows)
    mean = np.sum([r[1] for r in rows], axis=0) / n
    cov = np.sum([r[2] for r in rows], axis=0).reshape(len(mean), -1) / n - np.outer(mean, mean)
    values, axes = np.linalg.eigh(cov)
    return mean, axes / np.sqrt(np.maximum(values, 1e-12))
