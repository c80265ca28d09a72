"""Vectors of a table: usable ones, equal ones as one class, fast pseudo-rotations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import stage


def as_matrix(lists: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the right length without nulls, and where they were."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    valid = (sizes == dim) & ~np.asarray(lists.is_null())
    values = lists.values.slice(lists.offsets[0].as_py(), int(lists.offsets[-1].as_py()) - int(lists.offsets[0].as_py()))
    flat = values.to_numpy(zero_copy_only=False).astype(np.float32)
    starts = (lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py())[valid]
    x = flat[starts[:, None] + np.arange(dim)] if len(starts) else np.zeros((0, dim), np.float32)
    return x, np.flatnonzero(valid)


def _usable(batches, dim: int, with_vector: bool):
    for batch in batches:
        x, at = as_matrix(batch.column("v"), dim)
        norm = np.sqrt((x.astype(np.float64) ** 2).sum(1))
        ok = np.isfinite(norm) & (norm > 0) & np.asarray(batch.column("id").is_valid())[at]
        x, at = x[ok], at[ok]
        ids = batch.column("id").take(pa.array(at))
        h = [xxhash.xxh3_128_digest(r.tobytes()) for r in x]
        two = np.frombuffer(b"".join(h), np.int64).reshape(-1, 2)
        cols = [ids, pa.array(np.ascontiguousarray(two[:, 0])), pa.array(np.ascontiguousarray(two[:, 1]))]
        if with_vector:
            cols.append(pa.array([r.tobytes() for r in x], pa.binary()))
        yield pa.RecordBatch.from_arrays(cols, ["id", "h1", "h2", "v"][: len(cols)])


def dimension(df: DataFrame, col: str) -> int:
    """The most frequent length; vectors of another length are unusable."""
    top = df.where(F.col(col).isNotNull()).groupBy(F.size(col).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return top["n"] if top else 0


def usable(df: DataFrame, id_col: str, col: str, dim: int, with_vector: bool = True) -> DataFrame:
    """(id, h1, h2, v): vectors of the right length, finite, not zero; h1 and h2 hash the stored numbers, v holds them."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(col).cast("array<float>").alias("v"))
    return rows.mapInArrow(lambda it: _usable(it, dim, with_vector), "id long, h1 long, h2 long" + ", v binary" * with_vector)


def equal_classes(df: DataFrame, id_col: str, col: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """Usable vectors without equal copies, and (rep, id) for all members of classes of more than one row.

    Only hashes are shuffled to find the classes. A repeated row of a representative may stay once per input partition.
    """
    hashes = stage(usable(df, id_col, col, dim, with_vector=False).distinct(), "hashes")
    several = stage(hashes.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n"), "several")
    members = hashes.join(several, ["h1", "h2"]).select("rep", "id")
    vectors = usable(df, id_col, col, dim).join(several, ["h1", "h2"], "left").where("rep is null or rep = id").select("id", "v")
    return vectors, members


def hadamard(y: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of every row: as many rounds of sums and differences as the width has bits."""
    n, wide = y.shape
    h = 1
    while h < wide:
        z = y.reshape(n, wide // (2 * h), 2, h)
        y = np.concatenate([z[:, :, :1] + z[:, :, 1:], z[:, :, :1] - z[:, :, 1:]], axis=2).reshape(n, wide)
        h *= 2
    return y / np.sqrt(wide).astype(np.float32)


class PseudoRotation:
    """Three rounds of random signs and a Hadamard transform; vectors are padded to a power of two."""

    def __init__(self, dim: int, seed: int, kept: int | None = None):
        self.dim = dim
        self.wide = 1 << max(1, (dim - 1).bit_length())
        self.kept = min(kept or self.wide, self.wide)  # axes that are looked at; fewer make larger buckets
        self.signs = np.random.default_rng(seed).choice(np.array([-1, 1], np.float32), (3, self.wide))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        y = np.zeros((len(x), self.wide), np.float32)
        y[:, : self.dim] = x
        for s in self.signs:
            y = hadamard(y * s)
        return y[:, : self.kept]

    def axes(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The signed axes nearest to each row, nearest first."""
        y = self(x)
        probes = min(probes, self.kept)
        top = np.argpartition(-np.abs(y), probes - 1, axis=1)[:, :probes]
        at = np.take_along_axis(y, top, 1)
        order = np.argsort(-np.abs(at), axis=1, kind="stable")
        return np.take_along_axis(top * 2 + (at > 0), order, 1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt((x**2).sum(1))[:, None]


def stack(batch: pa.RecordBatch, dim: int, name: str = "v") -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(name).to_pylist()), np.float32).reshape(-1, dim)
