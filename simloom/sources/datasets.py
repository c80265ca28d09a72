"""Datasets for training and evaluation: columns chosen, checked and renamed; embeddings with their sentences; small settings."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators.cleaning import clean_sentences, with_id
from ..operators.sampling import hash_order

#: Losses that learn from pairs alone.
UNLABELLED = ("multiple_negatives", "contrastive_tension", "tsdae", "simcse")


def require(df: DataFrame, *columns: str) -> DataFrame:
    """The table, or an error that names the columns it lacks."""
    if lacking := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns {lacking} are missing; there are {df.columns}")
    return df


def with_missing(df: DataFrame, columns: dict[str, object]) -> DataFrame:
    """Columns that the table lacks, with a default."""
    return df.withColumns({c: F.lit(v) for c, v in columns.items() if c not in df.columns})


def prepared(df: DataFrame, drop: list[str] = (), rename: dict[str, str] | None = None, order: list[str] = (), first: list[str] = ()) -> DataFrame:
    """Columns dropped and renamed, rows sorted, some columns first; every column named must exist."""
    require(df, *drop, *(rename or {}))
    out = df.drop(*drop).withColumnsRenamed(rename or {})
    require(out, *order, *first)
    out = out.select(*first, *(c for c in out.columns if c not in first))
    return out.orderBy(*order) if order else out


def column_mapping(script: str, loss: str) -> dict[str, str]:
    """Which columns are the two texts, by script, and the label where the loss learns from one."""
    end = "_unicode" if script == "unicode" else ""
    out = {f"SentenceA{end}": "text1", f"SentenceB{end}": "text2"}
    return out if any(u in loss.lower() for u in UNLABELLED) else {**out, "score": "label"}


def dataset(df: DataFrame, mapping: dict[str, str], seed: int | None = None, key: str | None = None) -> DataFrame:
    """The mapped columns; where a script column is missing its plain twin stands in. With a seed rows come in hash order."""
    chosen = {}
    for source, name in mapping.items():
        plain = source.removesuffix("_unicode")
        chosen[name] = source if source in df.columns else require(df, plain).columns and plain
    keep = [F.col(s).alias(n) for n, s in chosen.items()]
    if seed is None:
        return df.select(*keep)
    return df.orderBy(hash_order(seed, key or next(iter(chosen.values()))), *chosen.values()).select(*keep)


def datasets(frames: dict[str, DataFrame], mapping: dict[str, str], seed: int | None = None) -> dict[str, DataFrame]:
    """Any number of sets by name; only those for training are shuffled."""
    return {n: dataset(f, mapping, seed if n.startswith("train") else None) for n, f in frames.items()}


def model_dataset(df: DataFrame, labelled: bool = True, order: list[str] = ("SentenceA", "SentenceB"), seed: int | None = None) -> DataFrame:
    """(ID, text1, text2, label?): pairs as a model takes them. A missing ID column becomes the row's place.

    A label that is wanted and not there is an error; rows come in hash order only when labelled and a seed is given.
    """
    require(df, "SentenceA", "SentenceB", *(["score"] if labelled else []))
    named = with_id(df, "ID", list(order))
    out = named.select(F.col("ID").cast("string").alias("ID"), F.col("SentenceA").alias("text1"), F.col("SentenceB").alias("text2"), *([F.col("score").alias("label")] if labelled else []))
    return out.orderBy(hash_order(seed, "ID"), "ID") if labelled and seed is not None else out


# ---- embeddings ----------------------------------------------------------------------------------------------------


def embeddings_with_sentences(vectors: DataFrame, sentences: DataFrame, id_col: str, vec: str, text: str) -> DataFrame:
    """(id, sentence, vector): joined by number; an error if a side lacks rows or vectors differ in length."""
    a, b = vectors.select(id_col, vec).where(F.col(vec).isNotNull()), sentences.select(id_col, text)
    out = a.join(b, id_col, "full")
    odd = out.agg(F.count_if(F.col(vec).isNull()), F.count_if(F.col(text).isNull()), F.min(F.size(vec)), F.max(F.size(vec))).first()
    if odd[0] or odd[1] or odd[2] != odd[3]:
        raise ValueError(f"{odd[0]} sentences without vector, {odd[1]} vectors without sentence, lengths {odd[2]} to {odd[3]}")
    return out.select(id_col, text, vec)


def prefix(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """The first n rows by their number; the filter reaches the scan."""
    return df.where(F.col(id_col) < n)


def export_embeddings(df: DataFrame, text: str, order: list[str], encode, path: str, iteration: int) -> None:
    """Cleaned, distinct sentences with their vectors, as the folder of one iteration; refuses to overwrite."""
    s = with_id(clean_sentences(df.select(text, *order), text, order).select(text, *order), "vec_id", order)
    s.select("vec_id", F.col(text).alias("sentence"), encode(F.col(text)).alias("embedding")).write.parquet(f"{path}/iteration={iteration}")


def load_or_encode(spark: SparkSession, path: str, iteration: int, df: DataFrame, text: str, order: list[str], encode) -> DataFrame:
    """The vectors of an iteration: as written, or encoded and written first."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/iteration={iteration}")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        export_embeddings(df, text, order, encode, path, iteration)
    return spark.read.parquet(f"{path}/iteration={iteration}")


def retire(spark: SparkSession, path: str, iteration: int, kept: int = 3) -> bool:
    """Delete the folder that is so many iterations old; whether there was one."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/iteration={iteration - kept}")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(fs.exists(p) and fs.delete(p, True))


def copy_partition(spark: SparkSession, source: str, target: str) -> None:
    """A folder's table written again elsewhere; refuses to overwrite."""
    spark.read.parquet(source).write.parquet(target)


# ---- logs, answers and settings ------------------------------------------------------------------------------------


def update_last(log: DataFrame, place: str, values: dict[str, object]) -> DataFrame:
    """The log with columns set in its last row; columns it lacked are null elsewhere."""
    last = F.col(place) == F.lit(log.agg(F.max(place)).first()[0])
    return log.withColumns({c: F.when(last, F.lit(v)).otherwise(F.col(c) if c in log.columns else F.lit(None)) for c, v in values.items()})


def best_checkpoint(spark: SparkSession, path: str) -> tuple[str, int] | None:
    """A trainer state's best checkpoint and its step; None where it names none."""
    text = spark.read.text(path, wholetext=True).first()
    best = json.loads(text[0]).get("best_model_checkpoint") if text else None
    return (best, int(best.rsplit("-", 1)[-1])) if best else None


def response_text(c: str) -> Column:
    """A model's answer as text: a string as it is, a JSON list of parts joined, a JSON object's text."""
    part = "array<struct<text:string>>"
    listed = F.array_join(F.transform(F.from_json(c, part), lambda x: x["text"]), "")
    strings = F.array_join(F.from_json(c, "array<string>"), "")
    one = F.from_json(c, "struct<text:string>")["text"]
    form = F.substring(F.trim(c), 1, 2)
    return strip(F.when(form.rlike(r"^\[\s*\{"), listed).when(F.startswith(F.trim(c), F.lit("[")), strings).when(F.startswith(F.trim(c), F.lit("{")), F.coalesce(one, F.col(c))).otherwise(F.col(c)))


def settings(text: str) -> dict:
    """A YAML mapping; empty text is an empty one, anything else an error."""
    import yaml

    out = yaml.safe_load(text)
    if out is None:
        return {}
    if not isinstance(out, dict):
        raise ValueError("settings must be a mapping")
    return out


def registry(files: dict[str, str]) -> dict[str, dict]:
    """Model settings by the model they name; of two files for one model the later by name counts."""
    return {s["model"]: s for name in sorted(files) if "model" in (s := settings(files[name]))}


def script_pairs(df: DataFrame, known: DataFrame, sides: dict[str, str], order: list[str]) -> DataFrame:
    """Columns <side>_unicode looked up in both sides of a known table of pairs with their script; A before B, later rows win."""
    parts = None
    for priority, (a, u) in enumerate(sides.items()):
        p = known.where(F.col(a).isNotNull() & F.col(u).isNotNull()).select(F.col(a).alias("_t"), F.struct(F.lit(priority).alias("p"), *order, F.col(u).alias("u")).alias("_s"))
        parts = p if parts is None else parts.unionByName(p)
    table = parts.groupBy("_t").agg(F.max("_s")["u"].alias("_u"))
    out = df
    for a in sides:
        out = out.join(table, out[a] == F.col("_t"), "left").withColumn(f"{a}_found", F.col("_u")).drop("_t", "_u")
    return out


def add_scripts(spark: SparkSession, paths: list[str], known: DataFrame, sides: dict[str, str], order: list[str]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """script_pairs over several tables; those that can't be read are reported, not fatal."""
    done, failed = {}, {}
    for path in paths:
        try:
            df = spark.read.parquet(path)
            require(df, *sides)
            done[path] = script_pairs(df, known, sides, order)
        except Exception as e:  # noqa: BLE001  one bad file doesn't stop the rest
            failed[path] = str(e).splitlines()[0]
    return done, failed


def sheets(path: str) -> dict[str, object]:
    """All sheets of a workbook as pandas tables by name; needs a spreadsheet reader. An empty workbook is an error."""
    import pandas as pd

    out = {n: t for n, t in pd.read_excel(path, sheet_name=None).items() if len(t.columns)}
    if not out:
        raise ValueError(f"{path} has no sheet with columns")
    return out


def all_sheets(spark: SparkSession, path: str, name: str = "sheet") -> DataFrame:
    """The sheets' rows united by column name, each with its sheet."""
    out = None
    for sheet, t in sheets(path).items():
        df = spark.createDataFrame(t.astype(object).where(t.notna(), None)).withColumn(name, F.lit(sheet))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out
