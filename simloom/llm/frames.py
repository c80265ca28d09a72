"""Tables between jobs, in the folder that the cluster shares."""

from __future__ import annotations

import itertools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_number = itertools.count()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where a local session has none (as in tests) a folder of our own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='simloom-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/simloom/{name}-{next(_number)}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str = "t") -> DataFrame:
    """Cut the lineage: write the table to the shared folder and read it from there. A lost executor loses nothing of it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Remove staged tables that no later step reads."""
    for t in tables:
        if path := getattr(t, "staged_path", None):
            remove(t.sparkSession, path)


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _file(spark, path)
    fs.delete(p, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, whole or not at all: written beside its place and moved there."""
    fs, p = _file(spark, path)
    _, beside = _file(spark, f"{path}.{uuid.uuid4().hex[:8]}")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(p, False)
    fs.rename(beside, p)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None if there is none."""
    fs, p = _file(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def first_by(df: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """One row for each key: the smallest of its rows, compared column by column; partial aggregation comes before the shuffle."""
    rest = [c for c in columns if c not in keys]
    return df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row")).select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest))
