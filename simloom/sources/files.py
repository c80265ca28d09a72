"""Files in and out: delimited text, tuples of IDs, result logs, tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver, NaN as missing in all its numbers."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def separator(spark: SparkSession, path: str) -> str:
    """Tab if the first line has one, else comma."""
    first = spark.read.text(path).first()
    return "\t" if first and "\t" in first[0] else ","


def read_delimited(spark: SparkSession, path: str, schema: StructType | str, sep: str | None = None) -> DataFrame:
    """A csv or tsv with a header; the schema is given, not guessed. NaN counts as missing."""
    return spark.read.option("header", True).option("sep", sep or separator(spark, path)).option("nanValue", "NaN").schema(schema).csv(path)


def read_folder(spark: SparkSession, pattern: str, schema: StructType | str, source: str = "source_file") -> DataFrame:
    """All files that match, with the file each row comes from as first column."""
    df = spark.read.option("header", True).schema(schema).csv(pattern).select("*", "_metadata.file_name")
    return df.select(F.col("file_name").alias(source), *(c for c in df.columns if c != "file_name"))


def read_id_tuples(spark: SparkSession, path: str, width: int = 4) -> DataFrame:
    """Lines of tab-separated IDs; short lines are filled with '', long ones cut."""
    parts = spark.read.text(path).select(F.split("value", "\t").alias("p"))
    return parts.select(*(F.coalesce(F.get("p", F.lit(i)), F.lit("")).alias(f"id_{i + 1}") for i in range(width)))


def save(df: DataFrame, path: str, exists_ok: bool = False, rows_per_file: int | None = None, by: list[str] = (), kind: str = "parquet") -> None:
    """Refuses to overwrite unless told; optionally cut into files of so many rows, or into folders by columns."""
    out = df.write.mode("overwrite" if exists_ok else "errorifexists")
    if rows_per_file:
        out = out.option("maxRecordsPerFile", rows_per_file)
    if by:
        out = out.partitionBy(*by)
    if kind in ("csv", "tsv"):
        out.option("header", True).option("sep", "\t" if kind == "tsv" else ",").csv(path)
    else:
        out.parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
