"""Queries over evaluation rows, datasets, pair sampling and label sets; they join those of the other module."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluation, knn, sampling, stats
from ..sources import datasets
from ..sources.files import table
from . import queries as base
from .queries import DOT, NORM, NUM, SEED, query, r6

_PAIRS = "(SELECT a.vec_id, a.vec_id % 3 AS fold, a.embedding::DOUBLE[] v, b.embedding::DOUBLE[] w, abs(a.label - b.label)::DOUBLE y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"
_SIMS = {
    "cosine": f"{DOT.format('v', 'w')} / ({NORM.format('v')} * {NORM.format('w')})",
    "manhattan": "-list_sum(list_transform(list_zip(v, w), lambda p: abs(p[1] - p[2])))",
    "euclidean": "-sqrt(list_sum(list_transform(list_zip(v, w), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))",
    "dot": DOT.format("v", "w"),
}
_LONG = f"(SELECT fold, y, unnest([{', '.join(repr(k) for k in _SIMS)}]) AS similarity, unnest([{', '.join(_SIMS.values())}]) AS x FROM {_PAIRS})"
_RANKED = "(SELECT *, rank() OVER (PARTITION BY fold, similarity ORDER BY {0}) + (count(*) OVER (PARTITION BY fold, similarity, {0}) - 1) / 2.0 AS {1} FROM {2})"
_METRICS = f"(SELECT fold, similarity, count(*) AS n, corr(x, y) AS pearson, corr(rx, ry) AS spearman FROM {_RANKED.format('y', 'ry', _RANKED.format('x', 'rx', _LONG))} GROUP BY 1, 2)"


def _labelled_pairs(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"), F.col("label").alias("label_w"))
    return e.join(after, "vec_id").select((F.col("vec_id") % 3).alias("fold"), "v", "w", F.abs(F.col("label") - F.col("label_w")).cast("double").alias("y"))


@query(f"SELECT fold, similarity, n, round(pearson, 6) AS pearson, round(spearman, 6) AS spearman FROM {_METRICS}")
def bi_encoder_metrics(spark, d):
    m = evaluation.bi_encoder_metrics(_labelled_pairs(spark, d), "v", "w", "y", ["fold"])
    return m.select("fold", "similarity", "n", r6("pearson").alias("pearson"), r6("spearman").alias("spearman"))


@query(f"""SELECT fold, {", ".join(f"round(coalesce(max({c}) FILTER (similarity = '{k}'), 0), 6) AS test_{c}_{k}" for c in ("pearson", "spearman") for k in _SIMS)}, 'epoch_3' AS evaluated_model, 'm' AS model FROM {_METRICS} GROUP BY fold""")
def evaluation_rows(spark, d):
    m = evaluation.bi_encoder_metrics(_labelled_pairs(spark, d), "v", "w", "y", ["fold"])
    row = evaluation.metric_row(m, "test", keep=["fold"])
    return evaluation.logged(row.select("fold", *(r6(c).alias(c) for c in row.columns[1:])), {"model": "m"}, epoch=3)


@query(f"""WITH m AS {_METRICS}, a AS (SELECT fold, pearson FROM m WHERE similarity = 'cosine'), b AS (SELECT fold, pearson FROM m WHERE similarity = 'dot' AND fold < 2)
SELECT coalesce(a.fold, b.fold) AS fold, round(a.pearson, 6) AS test_pearson, round(b.pearson, 6) AS second_test_pearson FROM a FULL JOIN b ON a.fold = b.fold""")
def two_test_rows(spark, d):
    m = evaluation.bi_encoder_metrics(_labelled_pairs(spark, d), "v", "w", "y", ["fold"]).select("fold", "similarity", r6("pearson").alias("pearson"))
    return evaluation.two_tests(m.where("similarity = 'cosine'").drop("similarity"), m.where("similarity = 'dot' and fold < 2").drop("similarity"), ["fold"])


@query(f"""WITH g AS (SELECT m.ID, m.x, m.y FROM {base._TWO} m), r AS (SELECT *, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 a, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 b FROM g),
i AS (SELECT *, row_number() OVER () k FROM g), t AS (SELECT sum(sign(p.x - q.x) * sign(p.y - q.y)) s, count(*) FILTER (p.x <> q.x) cx, count(*) FILTER (p.y <> q.y) cy FROM i p JOIN i q ON p.k <> q.k)
SELECT (SELECT count(*) FROM r) AS n, round((SELECT corr(x, y) FROM r), 6) AS pearson, round((SELECT corr(a, b) FROM r), 6) AS spearman, round(s / sqrt(cx * cy), 6) AS kendall FROM t""")
def cross_encoder_metrics(spark, d):
    m = evaluation.cross_encoder_metrics(base._two_scores(spark, d), "FaissDistance", "score")
    return m.select("n", *(r6(c).alias(c) for c in ("pearson", "spearman", "kendall")))


@query()
def correlation_p_values(spark, d):
    return evaluation.correlations(base._two_scores(spark, d), ["iteration_source"], "FaissDistance", "score", p_values=True)


@query(f"""WITH s AS (SELECT unnest([id_1, id_2, id_3, id_4]) id FROM {base._TUP}), c AS (SELECT id, substr(id, 2)::INT % 97 / 97.0 AS x FROM s)
SELECT count(*) AS slots, count(x) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(min(x), 6) AS min, round(max(x), 6) AS max FROM c""")
def slot_statistics(spark, d):
    t = base._tuples(spark, d)
    cosines = base.bws.slots_of(t).select("id").distinct().select(F.col("id").alias("ID"), (F.substring("id", 2, 9).cast("int") % 97 / 97.0).alias("cosine"))
    out = evaluation.slot_statistics(t, cosines, base.bws.SLOTS)
    return out.select("slots", "n", *(r6(c).alias(c) for c in ("mean", "std", "min", "max")))


@query(f"""SELECT ID, CASE WHEN tokens = 0 THEN 0.0 WHEN loss = 0 THEN NULL ELSE round(tokens / loss, 6) END AS noise, loss = 0 AND tokens > 0 AS endless, round(-loss - tokens, 6) AS noise_rank
FROM (SELECT DISTINCT ID, len({base._WORDS.format("SentenceA")})::DOUBLE tokens, round(coalesce({NUM.format("score")}, 0), 1) loss FROM gold_pairs)""")
def noise_scores(spark, d):
    g = table(spark, d, "gold_pairs").select("ID", F.size(base.T.words("SentenceA")).cast("double").alias("tokens"), F.round(F.coalesce("score", F.lit(0.0)), 1).alias("loss")).distinct()
    n = g.withColumn("noise", evaluation.noise_score("tokens", "loss"))
    endless = F.col("noise") == float("inf")
    return n.select("ID", F.when(~endless, r6("noise")).alias("noise"), endless.alias("endless"), r6(evaluation.noise_rank("loss", "tokens")).alias("noise_rank"))


@query(f"""WITH r AS (SELECT string_split(model, '/')[-1] model_short, file, avg(m1) m1, avg(m2) m2, count(*) n_rows FROM {base._LOG} GROUP BY 1, 2) SELECT model_short, round(avg(m1), 6) AS m1, round(avg(m2), 6) AS m2, min(n_rows) AS n_rows FROM r GROUP BY 1""")
def type_table(spark, d):
    rows = base._log(spark, d).groupBy(base.T.short_name("model").alias("model_short"), "file").agg(F.avg("m1").alias("m1"), F.avg("m2").alias("m2"), F.count("*").alias("n_rows"))
    return evaluation.type_table(rows, "model_short", ["m1", "m2"]).select("model_short", r6("m1").alias("m1"), r6("m2").alias("m2"), "n_rows")


@query(f"""SELECT model, round(avg(m1), 4) AS metric FROM (SELECT CASE WHEN l_linenumber = 7 THEN concat('combined(', model, ')') ELSE model END model, m1 FROM {base._LOG}) WHERE model NOT LIKE 'combined%' GROUP BY 1""")
def single_model_rows(spark, d):
    named = base._log(spark, d).withColumn("model", F.when(F.col("l_linenumber") == 7, F.concat(F.lit("combined("), "model", F.lit(")"))).otherwise(F.col("model")))
    return evaluation.single_model_rows(named.groupBy("model").agg(F.avg("m1").alias("m1")), "model", ["absent", "m1"])


@query("""SELECT DISTINCT set_source, CASE WHEN set_source IS NULL OR set_source = '' THEN 'baseline' WHEN lower(set_source) LIKE '%gold%' AND (lower(set_source) LIKE '%synth%' OR set_source LIKE '%+%') THEN 'two-phase' WHEN lower(set_source) LIKE '%gold%' THEN 'gold' ELSE 'synthetic' END AS setting FROM scored_pairs""")
def settings_by_source(spark, d):
    return table(spark, d, "scored_pairs").select("set_source", evaluation.setting_of("set_source").alias("setting")).distinct()


@query(f"""WITH x AS {base._DIST} SELECT * FROM (SELECT ID, x, 'head' AS "end" FROM x ORDER BY x DESC, ID LIMIT 10) UNION ALL SELECT * FROM (SELECT ID, x, 'tail' FROM x ORDER BY x, ID DESC LIMIT 10)""")
def ends_report(spark, d):
    return evaluation.ends_report(base._distances(spark, d), "x", "ID")


# ---- datasets ------------------------------------------------------------------------------------------------------


@query(f"""SELECT ID, SentenceA AS text1, SentenceB AS text2, {NUM.format("score")} AS label FROM scored_pairs""")
def model_dataset(spark, d):
    return datasets.model_dataset(table(spark, d, "scored_pairs"), seed=SEED)


@query("""SELECT (row_number() OVER (ORDER BY ID, SentenceA, SentenceB) - 1)::VARCHAR AS ID, SentenceA AS text1, SentenceB AS text2 FROM gold_pairs""")
def model_dataset_by_place(spark, d):
    g = table(spark, d, "gold_pairs").withColumnRenamed("ID", "gold_id")
    return datasets.model_dataset(g, labelled=False, order=["gold_id", "SentenceA", "SentenceB"])


@query(f"""SELECT SentenceA_unicode AS text1, SentenceB_unicode AS text2, {NUM.format("score")} AS label FROM gold_pairs UNION ALL SELECT SentenceA, SentenceB, {NUM.format("score")} FROM merged_trainset""")
def scripts_with_fallback(spark, d):
    mapping = datasets.column_mapping("unicode", "cosine_similarity")
    sets = datasets.datasets({"test": table(spark, d, "gold_pairs"), "train": table(spark, d, "merged_trainset")}, mapping, SEED)
    return sets["test"].unionByName(sets["train"])


@query("""WITH k AS (SELECT SentenceA t, SentenceA_unicode u, 0 p, ID FROM gold_pairs UNION ALL SELECT SentenceB, SentenceB_unicode, 1, ID FROM gold_pairs), m AS (SELECT t, arg_max(u, (p, ID, u)) u FROM k WHERE t IS NOT NULL AND u IS NOT NULL GROUP BY 1)
SELECT s.ID, s.SentenceA, s.SentenceB, a.u AS "SentenceA_found", b.u AS "SentenceB_found" FROM (SELECT ID, SentenceA, SentenceB FROM gold_pairs) s LEFT JOIN m a ON s.SentenceA = a.t LEFT JOIN m b ON s.SentenceB = b.t""")
def script_pairs(spark, d):
    g = table(spark, d, "gold_pairs")
    return datasets.script_pairs(g.select("ID", "SentenceA", "SentenceB"), g, {"SentenceA": "SentenceA_unicode", "SentenceB": "SentenceB_unicode"}, ["ID"])


@query("""SELECT vec_id, text AS sentence, len(embedding)::INT AS n FROM embeddings JOIN documents ON doc_id = vec_id WHERE vec_id < 200""")
def embeddings_with_sentences(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("sentence"))
    e = datasets.prefix(table(spark, d, "embeddings"), "vec_id", 200).join(t.select("vec_id"), "vec_id", "left_semi")
    return datasets.embeddings_with_sentences(e, t.join(e.select("vec_id"), "vec_id", "left_semi"), "vec_id", "embedding", "sentence").select("vec_id", "sentence", F.size("embedding").alias("n"))


@query("""SELECT n_nationkey AS id, CASE n_nationkey % 3 WHEN 0 THEN n_name WHEN 1 THEN concat(n_name, '!') ELSE n_name END AS answer FROM nation""")
def answer_texts(spark, d):
    n = table(spark, d, "nation")
    name, quoted = F.col("n_name"), F.concat(F.lit('"'), "n_name", F.lit('"'))
    raw = F.when(F.col("n_nationkey") % 3 == 0, name).when(F.col("n_nationkey") % 3 == 1, F.concat(F.lit('[{"text": '), quoted, F.lit('}, {"text": "!"}]'))).otherwise(F.concat(F.lit('{"text": '), quoted, F.lit("}")))
    return n.withColumn("raw", raw).select(F.col("n_nationkey").alias("id"), datasets.response_text("raw").alias("answer"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey = (SELECT max(o_orderkey) FROM orders) THEN 'last' END AS note, CASE WHEN o_orderkey = (SELECT max(o_orderkey) FROM orders) THEN 'Z' ELSE o_orderstatus END AS o_orderstatus FROM orders""")
def last_row_updated(spark, d):
    return datasets.update_last(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", {"note": "last", "o_orderstatus": "Z"}).select("o_orderkey", "note", "o_orderstatus")


# ---- sampling and label sets ---------------------------------------------------------------------------------------

_E = f"(SELECT vec_id, embedding::DOUBLE[] v, {NORM.format('embedding::DOUBLE[]')} l FROM embeddings)"
_NEAR = f"(SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, c) k FROM (SELECT q.vec_id q, b.vec_id c, {DOT.format('q.v', 'b.v')} / (q.l * b.l) s FROM {_E} q, {_E} b WHERE q.vec_id % 100 = 0))"
_FAR = f"""(SELECT n.*, x.text A, y.text B, {base._WORDS.format("x.text")} wa, {base._WORDS.format("y.text")} wb FROM (SELECT * FROM {_NEAR} WHERE k <= {{0}}) n JOIN documents x ON x.doc_id = n.q JOIN documents y ON y.doc_id = n.c)"""
_WORDS_APART = f"levenshtein({base._CODED.format('wa')}, {base._CODED.format('wb')})".replace("list_position(k,", "list_position(list_distinct(list_concat(wa, wb)),")


def _near(spark, d, k: int) -> DataFrame:
    e = table(spark, d, "embeddings")
    return knn.top_k(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", k)


def _texts(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text")


_H1, _H2 = "md5('42|' || q)", "md5('42|' || q || '|' || c)"


@query(f"""WITH p AS (SELECT q, row_number() OVER (ORDER BY {_H1}, q) - 1 AS place FROM (SELECT DISTINCT q FROM {_NEAR})), f AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY {_H2}, c) n FROM {_FAR.format(20)} WHERE s >= 0.2 AND q <> c AND {_WORDS_APART} > 5),
o AS (SELECT f.*, p.place, p.place // 3 AS batch FROM f JOIN p ON f.q = p.q WHERE n = 1 ORDER BY place LIMIT 250)
SELECT printf('pair_%04d_%03d_%03d_%02d', 2, batch, row_number() OVER (PARTITION BY batch ORDER BY place) - 1, k - 1) AS ID, q, c, round(s, 6) AS sim, A AS "SentenceA", B AS "SentenceB" FROM o""")
def sampled_similar_pairs(spark, d):
    q = table(spark, d, "embeddings").where("vec_id % 100 = 0")
    out = sampling.sampled_similar_pairs(q, _near(spark, d, 20), _texts(spark, d), "vec_id", "text", 250, iteration=2, least=0.2, most=0.4, per_batch=3, seed=SEED)
    return out.select("ID", "q", "c", r6("sim").alias("sim"), "SentenceA", "SentenceB")


@query(f"""WITH f AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY {_H2}, c) n FROM {_FAR.format(20)} WHERE s >= 0.2 AND q <> c AND {_WORDS_APART} > 5)
SELECT q, c, round(s, 6) AS sim, A AS "SentenceA", B AS "SentenceB" FROM f WHERE n = 1 ORDER BY {_H1}, q LIMIT 250""")
def similar_pairs(spark, d):
    out = sampling.distant_pairs(_near(spark, d, 20), _texts(spark, d), "vec_id", "text", 0.2, 5, 250, SEED)
    return out.select("q", "c", r6("sim").alias("sim"), "SentenceA", "SentenceB")


_POOL = f"(SELECT q, c, s, row_number() OVER (PARTITION BY q ORDER BY s DESC, c) AS rank FROM {_FAR.format(61)} WHERE k > 1 AND {_WORDS_APART} > 5)"


@query(f"SELECT q, c, round(s, 6) AS sim, rank::INT AS rank FROM {_POOL} WHERE rank <= 40")
def candidate_pool(spark, d):
    return sampling.candidate_pool(_near(spark, d, 61), _texts(spark, d), "vec_id", "text", pool=40, search=60).select("q", "c", r6("sim").alias("sim"), F.col("rank").cast("int"))


def _sets(spark, d) -> DataFrame:
    return sampling.shuffled_numbers(sampling.candidate_pool(_near(spark, d, 61), _texts(spark, d), "vec_id", "text", pool=5, search=60), "q", "c")


_SETS = f"(SELECT *, row_number() OVER (PARTITION BY q ORDER BY md5('1337|' || q || '|' || c), c) AS shuffled FROM {_POOL} WHERE rank <= 5)"


@query(f"SELECT q, {', '.join(f'''max(c) FILTER (rank = {k}) AS cand_{k:02d}_id, round(max(s) FILTER (rank = {k}), 6) AS cand_{k:02d}_distance''' for k in range(1, 6))} FROM {_SETS} GROUP BY q")
def label_set_wide(spark, d):
    return sampling.wide_candidates(_sets(spark, d).withColumn("sim", r6("sim")), "q", "rank", 5, id="c", distance="sim")


@query(f"SELECT q AS block, 0 AS row, 'anchor' AS type, q AS id FROM (SELECT DISTINCT q FROM {_SETS}) UNION ALL SELECT q, shuffled::INT, 'candidate', c FROM {_SETS}")
def label_set_blocks(spark, d):
    return sampling.anchor_blocks(_sets(spark, d), "q", "shuffled", "c")


@query(f"""WITH b AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY {base._HASH.format("ID")}, ID) n FROM {base._BIN}), f AS (SELECT ID FROM b WHERE n <= 25), r AS (SELECT ID, row_number() OVER (ORDER BY {base._HASH.format("ID")}, ID) m FROM b WHERE n > 25),
p AS (SELECT ID FROM f UNION ALL SELECT ID FROM r WHERE m <= 250 - (SELECT count(*) FROM f)) SELECT bin::INT AS bin, count(*) AS count, min(x) AS min, max(x) AS max, count(*) FILTER (ID IN (SELECT ID FROM p)) AS count_selected FROM b GROUP BY 1""")
def bin_report(spark, d):
    binned = sampling.minmax_bins(base._distances(spark, d), "x", 10)
    return sampling.bin_report(binned, sampling.balanced_pick(binned, 250, 10, "bin", SEED, "ID"), "x", "ID")


@query("""SELECT k::INT AS label, count(vec_id) AS count FROM range(60) t(k) LEFT JOIN embeddings ON label = k GROUP BY 1""")
def cluster_sizes(spark, d):
    return sampling.cluster_sizes(table(spark, d, "embeddings"), 60, "label")


@query()
def sampled_cluster_pairs(spark, d):
    return sampling.sampled_cluster_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", pairs=400)["selected"]


@query(f"""WITH e AS (SELECT vec_id i, v, l FROM {_E}), n AS (SELECT count(*) n FROM e), r AS (SELECT range k, ('0x' || substr(md5('42i|' || range), 1, 12))::BIGINT % (SELECT n FROM n) i, ('0x' || substr(md5('42j|' || range), 1, 12))::BIGINT % (SELECT n FROM n) j FROM range(5000)),
c AS (SELECT {DOT.format("a.v", "b.v")} / (a.l * b.l) x FROM r JOIN e a ON a.i = r.i JOIN e b ON b.i = r.j WHERE r.i <> r.j),
h AS (SELECT least(floor((x + 1) / 0.05), 39)::INT b, count(*) n FROM c GROUP BY 1) SELECT k::INT AS bin, coalesce(h.n, 0)::BIGINT AS count FROM range(40) t(k) LEFT JOIN h ON h.b = k""")
def cosine_histogram(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    pairs = stats.random_index_pairs(e.count(), 5000, SEED, spark)
    both = pairs.join(e.toDF("i", "v"), "i").join(e.toDF("j", "w"), "j")
    return stats.histogram(both.select(base.V.cosine(F.col("v"), F.col("w")).alias("x")), "x", 40, -1.0, 1.0).select("bin", "count")


@query(f"""WITH c AS (SELECT q, count(*) FILTER (s >= 0.3) - 1 AS close FROM {_NEAR} GROUP BY 1) SELECT quantile_cont(close, 0.5)::DOUBLE AS median, round(avg(close), 6) AS mean, round(avg((close = 0)::INT), 6) AS isolated FROM c""")
def isolation(spark, d):
    e = table(spark, d, "embeddings")
    out = stats.isolation(knn.close_counts(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 0.3))
    return out.select("median", r6("mean").alias("mean"), r6("isolated").alias("isolated"))


@query(f"""SELECT round(avg(s), 6) AS mean FROM {_NEAR} WHERE k = 1""")
def top_similarity_mean(spark, d):
    return _near(spark, d, 1).agg(r6(F.avg("sim")).alias("mean"))


@query("""SELECT round(quantile_cont(noise_score, 0.05), 9) AS q05, round(quantile_cont(noise_score, 0.5), 9) AS q50, round(quantile_cont(noise_score, 0.95), 9) AS q95 FROM segments WHERE NOT isnan(noise_score) AND NOT isinf(noise_score)""")
def finite_noise_percentiles(spark, d):
    v = stats.finite_percentiles(table(spark, d, "segments"), "noise_score", [0.05, 0.5, 0.95]) or [None] * 3
    return spark.range(1).select(*(F.round(F.lit(x).cast("double"), 9).alias(n) for x, n in zip(v, ("q05", "q50", "q95"))))


@query()
def principal_plane(spark, d):
    return stats.principal_plane(table(spark, d, "embeddings"), "embedding", ["vec_id"])
