"""Extension points: encoders and scorers as pandas UDFs, with stand-ins that need no model."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def encoder(encode: Callable[[list[str]], np.ndarray]):
    """A column function from text to array<float> that calls the model once per batch."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(np.asarray(encode([t or "" for t in texts]), np.float32)))

    return run


def pair_scorer(score: Callable[[list[str], list[str]], list[float]]):
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(score(a.fillna("").tolist(), b.fillna("").tolist()), dtype="float64")

    return run


def hash_embedding(texts: list[str], dim: int = 32) -> np.ndarray:
    """Counts of hashed words: a stand-in encoder that is the same everywhere."""
    import zlib

    out = np.zeros((len(texts), dim), np.float32)
    for row, t in zip(out, texts):
        for w in t.split():
            h = zlib.crc32(w.encode())
            row[h % dim] += 1 if h >> 31 else -1
    return out


def encode_distinct(df: DataFrame, text: str, run: Callable[[Column], Column], name: str) -> DataFrame:
    """Each different text is encoded once and joined back."""
    once = df.select(F.col(text).alias("_t")).where("_t is not null").distinct().withColumn(name, run(F.col("_t")))
    return df.join(once, F.col(text) == F.col("_t"), "left").drop("_t")
