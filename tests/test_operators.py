"""Small frames for the cases that real tables seldom have: ties, nulls, repeats, constants, empty tables."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from simloom import hooks
from simloom.functions import text as T
from simloom.functions import vectors as V
from simloom.operators import bws, cleaning, knn, results, sampling, stats
from simloom.sources import files


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*(cols or df.columns)).collect())


def distance(a, b):
    a, b = a.replace("/", " ").split(), b.replace("/", " ").split()
    d = list(range(len(b) + 1))
    for i, x in enumerate(a):
        prev, d[0] = d[0], i + 1
        for j, y in enumerate(b):
            prev, d[j + 1] = d[j + 1], min(d[j + 1] + 1, d[j] + 1, prev + (x != y))
    return d[-1]


def test_clean_sentence_keeps_first_and_strips_any_blank(spark):
    df = spark.createDataFrame([(1, " a [x] b "), (2, "a  b"), (3, None), (4, "[only]"), (5, " a  b\t"), (6, "a\n[b\nc]")], "i int, s string")
    assert rows(cleaning.clean_sentences(df, "s", ["i"])) == [(1, "a  b"), (6, "a\n[b\nc]")]
    assert cleaning.clean_sentences(df, "s", ["i"], distinct=False).count() == 4
    assert cleaning.clean_sentences(df.limit(0), "s", ["i"]).count() == 0


def test_word_distance_is_edits_of_words(spark):
    rng = random.Random(1)
    pairs = [(" ".join(rng.choices("ka kha ga nga ca".split(), k=rng.randint(1, 9))), "/".join(rng.choices("ka kha ga nga ca".split(), k=rng.randint(1, 9)))) for _ in range(60)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", T.word_distance("a", "b").alias("d"), T.word_distance("a", "b", 2).alias("near")).collect()
    for r in got:
        assert r["d"] == distance(r["a"], r["b"])
        assert (r["near"] == -1) == (r["d"] > 2)


def test_answers_types_and_names(spark):
    df = spark.createDataFrame([("most similar: P2\nLeast similar - P4", None, "x/y"), ("nothing", False, "z"), (None, True, "")], "t string, u boolean, n string")
    most, least = T.answer_labels("t")
    assert [tuple(r) for r in df.select(most, least, T.score_type("u"), T.short_name("n")).collect()] == [(2, 4, "bws", "y"), (None, None, "emr", "z"), (None, None, "bws", "")]
    w = spark.createDataFrame([("combined(a=0.5,b=0)",), ("single",)], "c string").select(T.combined_weights("c").alias("w")).collect()
    assert w[0]["w"] == {"a": 0.5, "b": 0.0} and w[1]["w"] is None
    s = spark.createDataFrame([("set_A_1_D_",), (None,)], "c string").select(T.one_set_letter("c").alias("c"), T.mapped_parts(F.lit("p+q"), {"p": "one"}).alias("m"), T.without_thinking(F.lit("<think>a\nb</think> c")).alias("t")).collect()
    assert s[0]["c"] == "set_X_1_X_" and s[1]["c"] == "" and s[0]["m"] == "one+q" and s[0]["t"] == "c"


def test_lookup_takes_first_and_falls_back(spark):
    known = spark.createDataFrame([(2, "a", "B"), (1, "a", "A"), (3, "b", None), (4, None, "N")], "o int, t string, u string")
    df = spark.createDataFrame([("a",), ("b",), (None,)], "t string")
    assert {(r["t"], r["s"]) for r in cleaning.in_other_script(df, "t", known, "t", "u", ["o"], "s").collect()} == {("a", "A"), ("b", "b"), (None, None)}


def test_too_many_missing_scores_is_an_error(spark):
    p, s = spark.createDataFrame([("1",), ("2",), (None,)], "ID string"), spark.createDataFrame([("1", 0.5)], "ID string, score double")
    assert rows(cleaning.with_scores(p, s, "ID", "score")) == [("1", 0.5), ("2", None)] or cleaning.with_scores(p, s, "ID", "score").count() == 2
    with pytest.raises(ValueError):
        cleaning.with_scores(p, s, "ID", "score", most_missing=0.05)


def test_missing_sentence_breaks_the_line(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (1, 3, "c"), (1, 4, "d"), (None, 1, "x"), (None, 2, "y")], "l int, o int, t string")
    assert rows(cleaning.consecutive_pairs(df, "l", ["o"], "t"), "SentenceA", "SentenceB") == [("c", "d")]


def test_positions_as_ids(spark):
    df = spark.createDataFrame([(x,) for x in "dbca"], "t string")
    assert rows(cleaning.with_id(df, "ID", ["t"]), "t", "ID") == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    got = df.select(V.cosine(a, b), V.manhattan(a, b), V.norm(V.unit(a))).collect()
    assert got[0][0] == pytest.approx(0.96) and got[0][1] == -2 and got[0][2] == pytest.approx(1)
    assert got[1][0] == 0 and got[1][2] == 0
    assert spark.createDataFrame([([float("nan"), float("inf"), -float("inf")],)], "a array<double>").select(V.finite(F.col("a"))).first()[0] == [0.0, 1.0, -1.0]


def test_top_k_against_brute_force(spark):
    x = np.random.default_rng(0).normal(size=(60, 8))
    x[7] = x[3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "id long, v array<double>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    want = {(q, int(c)) for q in range(0, 60, 10) for c in np.lexsort((np.arange(60), -s[q].round(12)))[:5]}
    assert {(r["q"], r["c"]) for r in knn.top_k(df.where("id % 10 = 0"), df, "id", "v", 5).collect()} == want
    counts = {r["q"]: r["close"] for r in knn.close_counts(df.where("id % 10 = 0"), df, "id", "v", 0.3).collect()}
    assert counts == {q: int((s[q] >= 0.3).sum()) - 1 for q in range(0, 60, 10)}


def test_bins_and_picks(spark):
    values = [0.0, 0.1, 0.1, 0.5, 0.9, 1.0, 1.0, 1.0]
    df = spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], "id string, x double")
    edges = np.linspace(0, 1, 5)[1:-1]
    assert {r["id"]: r["bin"] for r in sampling.minmax_bins(df, "x", 4).collect()} == {str(i): int(np.digitize(v, edges)) for i, v in enumerate(values)}
    assert {r["bin"] for r in sampling.minmax_bins(df.withColumn("x", F.lit(3.0)), "x", 4).collect()} == {0}
    cut = pd.qcut(values, 4, labels=False, duplicates="drop")
    assert {r["id"]: r["bin"] for r in sampling.quantile_bins(df, "x", 4).collect()} == {str(i): int(b) for i, b in enumerate(cut)}
    binned = sampling.minmax_bins(df, "x", 4)
    assert sampling.balanced_pick(binned, 6, 4, "bin", 1, "id").count() == 6
    assert sampling.balanced_pick(binned, 50, 4, "bin", 1, "id").count() == 8
    with pytest.raises(ValueError):
        sampling.quota_pick(binned, 8, "bin", 1, "id")
    assert [r["place"] for r in sampling.spread_pick(df, 3, "x", "id").orderBy("place").collect()] == [0, 3, 7]
    assert sampling.spread_pick(df.limit(0), 3, "x", "id").count() == 0


def test_sample_is_the_same_under_any_partitioning(spark):
    df = spark.range(200).select(F.col("id").cast("string").alias("k"))
    assert rows(sampling.sample(df.repartition(7), 20, 3, "k")) == rows(sampling.sample(df.coalesce(1), 20, 3, "k"))


def test_tuples_hold_four_different_ids_and_appear_evenly(spark):
    df = spark.createDataFrame([(f"p{i}",) for i in range(130)] + [(None,), ("p1",)], "ID string")
    t = bws.four_tuples(df, "ID", rounds=3, cells=2).collect()
    seen = {}
    for r in t:
        four = [r[s] for s in bws.SLOTS]
        assert len(set(four)) == 4
        for i in four:
            seen[i] = seen.get(i, 0) + 1
    assert len(seen) == 130 and min(seen.values()) >= 3 and max(seen.values()) <= 6


def test_annotation_ties_and_counting(spark):
    t = spark.createDataFrame([("t1", "a", "b", "c", "d"), ("t2", "a", "b", "x", "d")], "tuple_index string, id_1 string, id_2 string, id_3 string, id_4 string")
    s = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 0.0), ("d", 0.0)], "ID string, s double")
    done = bws.annotated(t, s, "ID", "s")
    assert rows(done, "tuple_index", "best_pair", "worst_pair") == [("t1", "a", "c"), ("t2", "a", "d")]
    got = {r["ID"]: r["score"] for r in bws.counting_scores(done).collect()}
    assert got["a"] == 1.0 and got["b"] == 0.5 and got["c"] == 0.0 and got["d"] == 0.25 and got["x"] == 0.5
    odd = spark.createDataFrame([("a", None, "c", "d", None, "c")], "id_1 string, id_2 string, id_3 string, id_4 string, best_pair string, worst_pair string")
    assert {r["ID"]: r["raw_score"] for r in bws.counting_scores(odd).collect()} == {"a": 0.0, "c": -1.0, "d": 0.0}
    texts = bws.with_texts(t, spark.createDataFrame([("a", "A1", "A2"), ("b", "B1", None)], "ID string, SentenceA string, SentenceB string"), "ID", "SentenceA", "SentenceB")
    r = texts.where("tuple_index = 't2'").first()
    assert (r["pair_1_A"], r["pair_2_B"], r["pair_3_A"]) == ("A1", "", "NOT_FOUND")


def test_correlations_against_pandas(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 6, 80).astype(float)
    y = (x + rng.integers(0, 5, 80)).astype(float)
    df = spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(x, y)] + [("c", 1.0, 2.0), ("c", 1.0, 3.0), ("n", None, 1.0)], "g string, x double, y double")
    p = {r["g"]: r["pearson"] for r in stats.pearson(df, ["g"], "x", "y").collect()}
    assert p["g"] == pytest.approx(np.corrcoef(x, y)[0, 1]) and p["c"] is None
    s = {r["g"]: r["spearman"] for r in stats.spearman(df, ["g"], "x", "y").collect()}
    assert s["g"] == pytest.approx(np.corrcoef(pd.Series(x).rank(), pd.Series(y).rank())[0, 1])
    i, j = np.triu_indices(80, 1)
    sx, sy = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
    want = (sx * sy).sum() / np.sqrt((sx != 0).sum() * (sy != 0).sum())
    k = {r["g"]: r["kendall"] for r in stats.kendall(df, ["g"], "x", "y").collect()}
    assert k["g"] == pytest.approx(want) and k["c"] is None


def test_distribution_is_numpys(spark):
    x = np.random.default_rng(3).normal(size=101)
    r = stats.described(spark.createDataFrame([(float(v),) for v in x], "x double"), "x").first()
    assert r["std"] == pytest.approx(x.std()) and r["q25"] == pytest.approx(np.quantile(x, 0.25)) and r["n"] == 101


def test_whitening(spark):
    x = np.random.default_rng(4).normal(size=(300, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.3], [0, 0, 2]])
    mean, w = stats.whitening(spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>"), "v")
    assert np.allclose(np.cov(((x - mean) @ w).T, bias=True), np.eye(3), atol=1e-8)


def test_upsert_first_match_only_and_null_settings(spark):
    log = spark.createDataFrame([(1, "a", None, 0.1), (2, "a", None, 0.2), (3, "b", "x", 0.3)], "n int, m string, s string, v double")
    new = spark.createDataFrame([("a", None, 0.9, "t")], "m string, s string, v double, extra string")
    got = results.upsert(log, new, ["m", "s"], ["n"])
    assert {(r["m"], r["s"], r["v"], r["extra"]) for r in got.collect()} == {("a", None, 0.9, "t"), ("a", None, 0.2, None), ("b", "x", 0.3, None)}


def test_result_tables(spark):
    df = spark.createDataFrame([("m", "A", 1.0), ("m", "B", 3.0), ("n", "A", None), ("n", "B", 2.0)], "m string, s string, v double")
    agg = {r["m"]: r for r in results.fold_means(df, ["m"], ["v"]).collect()}
    assert agg["m"]["v_mean"] == 2 and agg["m"]["v_std"] == pytest.approx(2**0.5) and agg["n"]["v_std"] is None
    assert {(r["m"], r["s"]) for r in results.best_rows(df, ["m"], "v", ["s"]).collect()} == {("m", "B"), ("n", "B")}
    assert rows(results.pivoted(df, "m", "s", ["A", "B"], ["v"]))[0] == ("m", 1.0, 3.0)
    with pytest.raises(ValueError):
        results.pivoted(df.union(df), "m", "s", ["A", "B"], ["v"])
    assert {r["m"]: r["e"] for r in results.ensemble(df.where("s = 'B'").withColumn("w", F.lit(5.0)), ["v", "w"], [0.5, 0.5], "e").collect()} == {"m": 0.5, "n": 0.0}
    assert results.settings_grid(spark, {"a": [1, 2], "b": ["x", "y", "z"]}).count() == 6
    sets = {r["s"]: r["n"] for r in results.metric_sets(df, "s", {"n": F.count("*")}).collect()}
    assert sets == {"A": 2, "B": 2, "aggregated": 4}


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x\ty\n1\tNaN\n2\tb\n")
    assert files.separator(spark, str(tmp_path / "a.csv")) == "\t"
    assert rows(files.read_delimited(spark, str(tmp_path / "a.csv"), "x int, y string"), "x") == [(1,), (2,)]
    (tmp_path / "t.txt").write_text("a\tb\na\tb\tc\td\te\n")
    assert rows(files.read_id_tuples(spark, str(tmp_path / "t.txt"))) == [("a", "b", "", ""), ("a", "b", "c", "d")]
    df = spark.range(3)
    files.save(df, str(tmp_path / "out"))
    with pytest.raises(Exception):
        files.save(df, str(tmp_path / "out"))
    files.append(df, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_hooks(spark):
    df = spark.createDataFrame([("a b",), ("a b",), (None,)], "t string")
    got = hooks.encode_distinct(df, "t", hooks.encoder(hooks.hash_embedding), "e").collect()
    assert sum(r["e"] is not None for r in got) == 2
    assert df.select(hooks.pair_scorer(lambda a, b: [float(len(x)) for x in a])("t", "t").alias("s")).count() == 3


def test_random_pairs_of_small_tables_are_as_many_as_asked_for(spark):
    for n, k, want in ((1000, 250, 250), (120, 250, 250), (10, 250, 45), (1, 5, 0)):
        df = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(8))) for i in range(n)] + [(-1, None)], "id long, t string")
        got = sampling.random_pairs(df, "id", "t", k, 5, 42).collect()
        assert len({(r["id_a"], r["id_b"]) for r in got}) == len(got) == want
        assert all(r["id_a"] < r["id_b"] and r["SentenceA"].startswith(f"w{r['id_a']}x") and r["SentenceB"].startswith(f"w{r['id_b']}x") for r in got)
    near = spark.createDataFrame([(i, f"same words all over but {i}") for i in range(200)], "id long, t string")
    assert sampling.random_pairs(near, "id", "t", 20, 5, 42).count() == 0


def test_cluster_pairs_take_the_best_of_ten_runs(spark, monkeypatch):
    from pyspark.ml.clustering import KMeans

    fit, seeds = KMeans.fit, []
    monkeypatch.setattr(KMeans, "fit", lambda self, df: (seeds.append(self.getSeed()), fit(self, df))[1])
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(40)], "id long, v array<double>")
    assert sampling.cluster_pairs(df, "id", "v", 3, 5, 42).count() > 0
    assert len(set(seeds)) == 10
