"""Datasets, evaluation rows and sampling parameters on small literal tables."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from simloom import hooks
from simloom.operators import evaluation, sampling, stats
from simloom.sources import datasets


def test_p_values_against_known_ones():
    # r = 0.5, n = 12 is t = 1.8257 with 10 degrees of freedom; r = 0.8, n = 5 is t = 2.3094 with 3
    assert stats.p_value(0.5, 12) == pytest.approx(0.09785, abs=1e-5) and stats.p_value(-0.8, 5) == pytest.approx(0.10409, abs=1e-5)
    assert stats.p_value(0.0, 30) == pytest.approx(1.0) and stats.p_value(1.0, 9) == 0.0 and stats.p_value(None, 9) is None and stats.p_value(0.3, 2) is None


def test_exact_quantiles(spark):
    rng = random.Random(0)
    for values in ([rng.gauss(0, 5) for _ in range(300)], [3.0] * 9, [1.0, 2.0], [1e9, *[0.001 * k for k in range(50)]]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
        shares = [0.0, 0.1, 0.25, 0.5, 0.99, 1.0]
        assert stats.quantiles(df, "x", shares) == pytest.approx(np.quantile(values, shares).tolist())
    assert stats.quantiles(df.limit(0), "x", [0.5]) is None
    odd = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (3.0,)], "x double")
    assert stats.finite_percentiles(odd, "x", [0.5]) == [2.0]


def test_constant_columns_have_no_correlation(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0), ("b", 1.0, 2.0), ("b", 2.0, 4.0), ("b", 3.0, 6.0), ("c", None, 1.0)], "g string, x double, y double")
    got = {r["g"]: (r["n"], r["pearson"], r["spearman"]) for r in evaluation.correlations(df, ["g"], "x", "y").collect()}
    assert got["a"] == (2, None, None) and got["b"][0] == 3 and got["b"][1] == pytest.approx(1.0) and "c" not in got
    one = evaluation.cross_encoder_metrics(df.where("g = 'b'"), "x", "y").first()
    assert (one["n"], one["pearson"], one["spearman"], one["kendall"]) == (3, pytest.approx(1.0), pytest.approx(1.0), pytest.approx(1.0))
    empty = evaluation.metric_row(evaluation.bi_encoder_metrics(spark.createDataFrame([("a", [1.0, 0.0], [0.0, 1.0], 1.0)], "g string, v array<double>, w array<double>, y double"), "v", "w", "y", ["g"]), "test", keep=["g"]).first()
    assert empty["test_pearson_cosine"] == 0.0


def test_thresholds_and_ids(spark):
    assert sampling.decayed_threshold(0, 0.88, 0.98, 11) == math.inf and sampling.decayed_threshold(1, 0.88, 0.98, 11) == 0.98
    assert sampling.decayed_threshold(11, 0.88, 0.98, 11) == pytest.approx(0.88) and sampling.decayed_threshold(5, 0.88, 0.98, 11, fixed=True) == 0.98
    assert sampling.beta_thresholds(2, 0.1, 0.9, None, 2.0, 1) == [0.1, 0.1] and all(0.1 <= x <= 0.9 for x in sampling.beta_thresholds(5, 0.1, 0.9, 2.0, 2.0, 1))
    texts = spark.createDataFrame([(k, f"w{k} a b c d e {k}") for k in range(12)], "id long, t string")
    near = spark.createDataFrame([(q, c, 0.9 if q != c else 1.0) for q in range(12) for c in range(12)], "q long, c long, sim double")
    run = lambda **kw: sampling.sampled_similar_pairs(texts.select("id"), near, texts, "id", "t", least=0.5, more_words=1, per_batch=4, **kw).collect()
    first = run(k=6)
    assert len(first) == 6 and sorted({r["ID"][10:13] for r in first}) == ["000", "001"] and len({r["q"] for r in first}) == 6 and all(r["q"] != r["c"] for r in first)
    seen = spark.createDataFrame([(r["q"], r["c"]) for r in first], "q long, c long")
    assert {(r["q"], r["c"]) for r in run(k=12, seen=seen)}.isdisjoint({(r["q"], r["c"]) for r in first})
    assert len(run(k=12, most=0.6, a=2.0, b=2.0)) == 12 and run(k=5, iteration=3)[0]["ID"].startswith("pair_0003_")
    assert sampling.sampled_similar_pairs(texts.select("id").limit(0), near, texts, "id", "t", 5, least=0.5).count() == 0


def test_pools_drop_the_first_place_and_near_duplicates(spark):
    texts = spark.createDataFrame([(0, "a b c d e f g h"), (1, "a b c d e f g x"), (2, "q r s t u v w x"), (3, "k l m n o p q r")], "id long, t string")
    near = spark.createDataFrame([(0, 0, 1.0), (0, 1, 0.9), (0, 2, 0.8), (0, 3, 0.7)], "q long, c long, sim double")
    assert [(r["c"], r["rank"]) for r in sampling.candidate_pool(near, texts, "id", "t", 3, 3).collect()] == [(2, 1), (3, 2)]
    assert [r["c"] for r in sampling.candidate_pool(near, texts, "id", "t", 1, 3, closer_than=None).collect()] == [1]
    with pytest.raises(ValueError):
        sampling.candidate_pool(near, texts, "id", "t", 5, 3)


def test_datasets_check_their_columns(spark):
    df = spark.createDataFrame([("b", "B", 1.0), ("a", "A", None)], "SentenceA string, SentenceB string, score double")
    assert [tuple(r) for r in datasets.model_dataset(df).orderBy("ID").collect()] == [("0", "a", "A", None), ("1", "b", "B", 1.0)]
    with pytest.raises(ValueError, match="score"):
        datasets.model_dataset(df.drop("score"))
    assert datasets.model_dataset(df.drop("score"), labelled=False).columns == ["ID", "text1", "text2"]
    assert datasets.column_mapping("unicode", "MultipleNegatives_multiple_negatives") == {"SentenceA_unicode": "text1", "SentenceB_unicode": "text2"}
    assert datasets.dataset(df, datasets.column_mapping("unicode", "cosine"), 42).columns == ["text1", "text2", "label"]
    assert datasets.prepared(df, drop=["score"], rename={"SentenceA": "x"}, order=["x"], first=["SentenceB"]).columns == ["SentenceB", "x"]
    with pytest.raises(ValueError, match="nothere"):
        datasets.prepared(df, drop=["nothere"])
    assert datasets.with_missing(df, {"score": 0.0, "extra": "e"}).first()["extra"] == "e"


def test_embeddings_are_written_read_and_retired(spark, tmp_path):
    df = spark.createDataFrame([(1, "ka kha"), (2, "ga"), (3, "ka kha [note]"), (4, None)], "n long, t string")
    path, encode = str(tmp_path / "vectors"), hooks.encoder(hooks.hash_embedding)
    first = datasets.load_or_encode(spark, path, 1, df, "t", ["n"], encode)
    assert sorted(r["sentence"] for r in first.collect()) == ["ga", "ka kha"] and first.select("vec_id").distinct().count() == 2
    assert datasets.load_or_encode(spark, path, 1, df.limit(0), "t", ["n"], encode).count() == 2  # read, not encoded again
    datasets.copy_partition(spark, f"{path}/iteration=1", f"{path}/iteration=4")
    with pytest.raises(Exception, match="(?i)exists"):
        datasets.copy_partition(spark, f"{path}/iteration=1", f"{path}/iteration=4")
    with pytest.raises(ValueError, match="1 sentences without vector"):
        datasets.embeddings_with_sentences(first, df.select(F.col("n").alias("vec_id"), "t").where("n < 3").unionByName(spark.createDataFrame([(0, "x")], "vec_id long, t string")), "vec_id", "embedding", "t")
    done, failed = datasets.add_scripts(spark, [f"{path}/iteration=4", f"{path}/none"], df, {"t": "t"}, ["n"])
    assert not done and len(failed) == 2
    assert datasets.retire(spark, path, 4) and not datasets.retire(spark, path, 4) and (tmp_path / "vectors" / "iteration=4").exists()


def test_states_settings_and_answers(spark, tmp_path):
    (tmp_path / "state.json").write_text(json.dumps({"best_model_checkpoint": "out/checkpoint-120"}))
    assert datasets.best_checkpoint(spark, str(tmp_path / "state.json")) == ("out/checkpoint-120", 120)
    (tmp_path / "none.json").write_text("{}")
    assert datasets.best_checkpoint(spark, str(tmp_path / "none.json")) is None
    raw = spark.createDataFrame([(" plain ",), ('["a", "b"]',), ('[{"text": "x"}, {"text": "y"}]',), ('{"text": "z"}',), (None,)], "r string")
    assert [r[0] for r in raw.select(datasets.response_text("r")).collect()] == ["plain", "ab", "xy", "z", None]
    pytest.importorskip("yaml")
    assert datasets.settings("") == {} and datasets.registry({"b.yaml": "model: m\nk: 2", "a.yaml": "model: m\nk: 1", "c.yaml": "k: 3"}) == {"m": {"model": "m", "k": 2}}
    with pytest.raises(ValueError):
        datasets.settings("- a")


def test_noise_and_settings(spark):
    df = spark.createDataFrame([(0.0, 1.0, None), (4.0, 0.0, "gold+synth"), (4.0, 2.0, "gold"), (1.0, None, "x")], "n double, l double, s string")
    rows = df.select(evaluation.noise_score("n", "l").alias("v"), evaluation.setting_of("s").alias("k")).collect()
    assert [r["v"] for r in rows] == [0.0, math.inf, 2.0, None] and [r["k"] for r in rows] == ["baseline", "two-phase", "gold", "synthetic"]
    with pytest.raises(ValueError):
        evaluation.single_model_rows(df, "s", ["nothere"])
