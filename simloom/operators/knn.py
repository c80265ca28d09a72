"""Exact search: a stated set of queries against all rows, in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors that one pass sends to the executors.
BLOCK = 20_000


#: Rows of queries that are compared with a batch at once.
ROWS = 1024


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x**2).sum(1, keepdims=True)), 1e-12) if len(x) else x


def _best(batches, shared, k: int):
    """Each query's k best of the task's rows, ties to the smaller id; held as three arrays sorted by query."""
    names, q = np.asarray(shared.value[0], np.int64), shared.value[1]
    row, ids, sims = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for batch in batches:
        if not batch.num_rows:
            continue
        here, x = batch.column("id").to_numpy(), _unit(_matrix(batch.column("v"))).T
        found = [(row, ids, sims)]
        for s in range(0, len(q), ROWS):
            c = q[s : s + ROWS] @ x
            bar = np.partition(c, -k, axis=1)[:, -k] if k < c.shape[1] else np.full(len(c), -np.inf)
            a, b = np.nonzero(c >= bar[:, None])
            found.append((a + s, here[b], c[a, b]))
        row, ids, sims = (np.concatenate(z) for z in zip(*found))
        order = np.lexsort((ids, -sims, row))
        row, ids, sims = row[order], ids[order], sims[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        row, ids, sims = row[rank < k], ids[rank < k], sims[rank < k]
    yield pa.RecordBatch.from_arrays([pa.array(names[row]), pa.array(ids), pa.array(sims)], ["q", "c", "sim"])


def _above(batches, shared, least: float):
    names, q = shared.value
    for batch in batches:
        if batch.num_rows:
            x = _unit(_matrix(batch.column("v"))).T
            n = np.concatenate([(q[s : s + ROWS] @ x >= least).sum(1) for s in range(0, len(q), ROWS)])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(n.astype(np.int64))], ["q", "n"])


def _passes(queries: DataFrame, base: DataFrame, id_col: str, vec: str, run, schema: str) -> DataFrame:
    """One pass over all rows for each block of queries; a block's size is fixed, so what is broadcast is bounded."""
    spark = base.sparkSession
    rows = base.select(F.col(id_col).cast("long").alias("id"), F.col(vec).alias("v")).where("v is not null")
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vec).alias("v")).where("v is not null")
    n = asked.count()
    parts = max(1, -(-n // BLOCK))
    out = None
    for p in range(parts):
        some = asked.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == p).orderBy("id").toArrow()
        shared = spark.sparkContext.broadcast((some.column("id").to_pylist(), _unit(_matrix(some.column("v")))))
        found = rows.mapInArrow(lambda it, s=shared: run(it, s), schema) if some.num_rows else spark.createDataFrame([], schema)
        out = found if out is None else out.unionByName(found)
    return out


def top_k(queries: DataFrame, base: DataFrame, id_col: str, vec: str, k: int) -> DataFrame:
    """(q, c, sim, rank): the k rows of highest cosine for every query, itself included; ties to the smaller id.

    Every task keeps k rows per query, so only those are shuffled.
    """
    part = _passes(queries, base, id_col, vec, lambda it, s: _best(it, s, k), "q long, c long, sim double")
    order = Window.partitionBy("q").orderBy(F.desc("sim"), "c")
    return part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def close_counts(queries: DataFrame, base: DataFrame, id_col: str, vec: str, least: float) -> DataFrame:
    """(q, close): how many others have at least the given cosine with the query, which is one of the rows."""
    part = _passes(queries, base, id_col, vec, lambda it, s: _above(it, s, least), "q long, n long")
    return part.groupBy("q").agg((F.sum("n") - 1).alias("close"))
