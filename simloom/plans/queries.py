"""Queries over the driver's tables by name, and the SQL that checks each. Floats are rounded to 6 decimals on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import hooks
from ..functions import text as T
from ..functions import vectors as V
from ..operators import bws, cleaning, knn, results, sampling, stats
from ..sources.files import table
from ..streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
SEED = 42


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c: str | Column) -> Column:
    return F.round(c, 6)


#: SQL twins of the column functions.
BLANK = "[\\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
STRIP = f"regexp_replace({{0}}, '^{BLANK}+|{BLANK}+$', '', 'g')"
CLEAN = STRIP.format(r"regexp_replace({0}, '\[.*?\]', '', 'g')")
NUM = "CASE WHEN isnan({0}) THEN NULL ELSE {0} END"
NORM = "sqrt(list_sum(list_transform({0}, lambda x: x * x)))"
DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda p: p[1] * p[2]))"


# ---- vectors -------------------------------------------------------------------------------------------------------


@query(f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] v FROM embeddings), n AS (SELECT vec_id, v, {NORM.format("v")} l FROM e),
p AS (SELECT q.vec_id q, b.vec_id c, {DOT.format("q.v", "b.v")} / (q.l * b.l) s FROM n q, n b WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, c) k FROM p)
SELECT q, c, k::INT AS rank, round(s, 6) AS sim FROM r WHERE k <= 20""")
def cosine_topk(spark, d):
    e = table(spark, d, "embeddings")
    return knn.top_k(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 20).select("q", "c", F.col("rank").cast("int"), r6("sim").alias("sim"))


@query(f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] v FROM embeddings), n AS (SELECT vec_id, v, {NORM.format("v")} l FROM e)
SELECT q.vec_id AS q, (count(*) FILTER ({DOT.format("q.v", "b.v")} / (q.l * b.l) >= 0.3) - 1)::BIGINT AS close FROM n q, n b WHERE q.vec_id % 100 = 0 GROUP BY 1""")
def close_neighbour_counts(spark, d):
    e = table(spark, d, "embeddings")
    return knn.close_counts(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 0.3)


def _consecutive_vectors(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", V.as_doubles("embedding").alias("v"))
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return e.join(after, "vec_id")


_PAIRS = "WITH p AS (SELECT a.vec_id, a.embedding::DOUBLE[] v, b.embedding::DOUBLE[] w FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"


@query(f"""{_PAIRS} SELECT vec_id, round({DOT.format("v", "w")}, 6) AS dot, round({DOT.format("v", "w")} / ({NORM.format("v")} * {NORM.format("w")}), 6) AS cosine,
round(-list_sum(list_transform(list_zip(v, w), lambda p: abs(p[1] - p[2]))), 6) AS manhattan, round(-sqrt(list_sum(list_transform(list_zip(v, w), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 6) AS euclidean FROM p""")
def pair_similarities(spark, d):
    v, w = F.col("v"), F.col("w")
    return _consecutive_vectors(spark, d).select("vec_id", r6(V.dot(v, w)).alias("dot"), r6(V.cosine(v, w)).alias("cosine"), r6(V.manhattan(v, w)).alias("manhattan"), r6(V.euclidean(v, w)).alias("euclidean"))


@query(f"""{_PAIRS} SELECT count(*) AS n, round(avg(1 - {DOT.format("v", "w")} / ({NORM.format("v")} * {NORM.format("w")})), 6) AS drift FROM p""")
def embedding_drift(spark, d):
    return _consecutive_vectors(spark, d).agg(F.count("*").alias("n"), r6(F.avg(1 - V.cosine(F.col("v"), F.col("w")))).alias("drift"))


@query(f"""{_PAIRS}, c AS (SELECT {DOT.format("v", "w")} / ({NORM.format("v")} * {NORM.format("w")}) x FROM p)
SELECT count(x) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(min(x), 6) AS min, round(max(x), 6) AS max, {", ".join(f"round(quantile_cont(x, {q}), 6) AS q{round(q * 100):02d}" for q in stats.QUANTILES)} FROM c""")
def cosine_distribution(spark, d):
    c = _consecutive_vectors(spark, d).select(V.cosine(F.col("v"), F.col("w")).alias("x"))
    out = stats.described(c, "x")
    return out.select("n", *(r6(x).alias(x) for x in out.columns[1:]))


@query("""WITH x AS (SELECT unnest(embedding::DOUBLE[]) v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)
SELECT dim::INT AS dim, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM x GROUP BY dim""")
def dimension_stats(spark, d):
    return stats.dimension_stats(table(spark, d, "embeddings"), "embedding").select("dim", r6("mean").alias("mean"), r6("std").alias("std"))


@query(f"""WITH e AS (SELECT vec_id, list_transform(embeddings::DOUBLE[], lambda x: CASE WHEN isnan(x) THEN 0.0 ELSE x END) v FROM (SELECT DISTINCT vec_id, embeddings FROM sentence_vectors WHERE embeddings IS NOT NULL))
SELECT vec_id, round({NORM.format("v")}, 6) AS norm, round({NORM.format("list_transform(v, lambda x: x / greatest(" + NORM.format("v").replace("lambda x: x * x", "lambda y: y * y") + ", 1e-12))").replace("lambda x: x * x", "lambda z: z * z")}, 6) AS unit_norm FROM e""")
def normalised_vectors(spark, d):
    e = table(spark, d, "sentence_vectors").where("embeddings is not null").select("vec_id", "embeddings").distinct()
    v = V.finite(V.as_doubles("embeddings"))
    return e.select("vec_id", r6(V.norm(v)).alias("norm"), r6(V.norm(V.unit(v))).alias("unit_norm"))


@query()
def cluster_pairs(spark, d):
    return sampling.cluster_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", 10, 400, SEED)


@query()
def whitened_vectors(spark, d):
    e = table(spark, d, "embeddings")
    mean, w = stats.whitening(e, "embedding")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            x = (np.array(b.column("embedding").to_pylist(), np.float64) - mean) @ w
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["vec_id", "white"])

    return e.select("vec_id", "embedding").mapInArrow(run, "vec_id long, white array<double>")


@query()
def label_sets(spark, d):
    e = table(spark, d, "embeddings")
    near = knn.top_k(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 60)
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    return sampling.label_sets(near, texts, "vec_id", "text", 5, 5, 20, 5)


# ---- text ----------------------------------------------------------------------------------------------------------


@query(f"""WITH c AS (SELECT seg_no, {CLEAN.format("Segmented_Text_EWTS")} t FROM segments WHERE Segmented_Text_EWTS IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY seg_no) k FROM c WHERE t <> '') SELECT seg_no, t AS sentence FROM r WHERE k = 1""")
def clean_sentences(spark, d):
    s = table(spark, d, "segments").select("seg_no", F.col("Segmented_Text_EWTS").alias("sentence"))
    return cleaning.clean_sentences(s, "sentence", ["seg_no"])


@query(f"""SELECT ID, regexp_replace(SentenceA, '\\t+', ' ', 'g') AS a, regexp_replace(SentenceB, '\\t+', ' ', 'g') AS b FROM selected_pairs
WHERE {STRIP.format("SentenceA")} <> '' AND {STRIP.format("SentenceB")} <> ''""")
def clean_pairs(spark, d):
    return cleaning.clean_pairs(table(spark, d, "selected_pairs").select("ID", F.col("SentenceA").alias("a"), F.col("SentenceB").alias("b")), "a", "b")


_WORDS = f"list_filter(string_split_regex(replace({{0}}, '/', ' '), '{BLANK}+'), lambda w: w <> '')"
_CODED = "list_aggregate(list_transform({0}, lambda w: chr((33 + list_position(k, w))::INT)), 'string_agg', '')"


@query(f"""WITH w AS (SELECT DISTINCT ID, {_WORDS.format("SentenceA")} a, {_WORDS.format("SentenceB")} b FROM selected_pairs), k AS (SELECT ID, a, b, list_distinct(list_concat(a, b)) k FROM w)
SELECT ID, levenshtein({_CODED.format("a")}, {_CODED.format("b")})::INT AS distance FROM k WHERE len(a) > 0 AND len(b) > 0""")
def word_distances(spark, d):
    p = table(spark, d, "selected_pairs").select("ID", T.words("SentenceA").alias("a"), T.words("SentenceB").alias("b"), "SentenceA", "SentenceB").where("size(a) > 0 and size(b) > 0")
    return p.select("ID", T.word_distance("SentenceA", "SentenceB").alias("distance")).distinct()


@query("""SELECT DISTINCT s AS sentence FROM (SELECT SentenceA s FROM scored_pairs UNION ALL SELECT SentenceB FROM scored_pairs) WHERE s IS NOT NULL""")
def unique_sentences(spark, d):
    return cleaning.unique_sentences(table(spark, d, "scored_pairs"), "SentenceA", "SentenceB")


@query(f"""SELECT DISTINCT {CLEAN.format("Segmented_Text_EWTS")} AS text1, {CLEAN.format("Segmented_Text_EWTS")} AS text2 FROM segments WHERE {CLEAN.format("Segmented_Text_EWTS")} <> ''""")
def self_pairs(spark, d):
    return cleaning.self_pairs(table(spark, d, "segments"), "Segmented_Text_EWTS", clean=True)


@query("""WITH l AS (SELECT Source_Line_Number, Sentence_Order, seg_no, Segmented_Text_EWTS a, lead(Segmented_Text_EWTS) OVER (PARTITION BY Source_Line_Number ORDER BY Sentence_Order, seg_no) b FROM segments WHERE Source_Line_Number IS NOT NULL)
SELECT Source_Line_Number, Sentence_Order, seg_no, a AS SentenceA, b AS SentenceB FROM l WHERE a IS NOT NULL AND b IS NOT NULL""")
def consecutive_pairs(spark, d):
    return cleaning.consecutive_pairs(table(spark, d, "segments"), "Source_Line_Number", ["Sentence_Order", "seg_no"], "Segmented_Text_EWTS")


@query("""WITH k AS (SELECT Segmented_Text_EWTS t, Segmented_Text u, row_number() OVER (PARTITION BY Segmented_Text_EWTS ORDER BY seg_no, Segmented_Text) n FROM segments WHERE Segmented_Text_EWTS IS NOT NULL AND Segmented_Text IS NOT NULL)
SELECT s.seg_no, coalesce(k.u, s.Segmented_Text_EWTS) AS script FROM segments s LEFT JOIN k ON s.Segmented_Text_EWTS = k.t AND k.n = 1""")
def script_fallback(spark, d):
    s = table(spark, d, "segments")
    return cleaning.in_other_script(s, "Segmented_Text_EWTS", s, "Segmented_Text_EWTS", "Segmented_Text", ["seg_no"], "script").select("seg_no", "script")


@query("""SELECT DISTINCT s AS sentence FROM (SELECT SentenceA s FROM scored_pairs UNION ALL SELECT SentenceB FROM scored_pairs) WHERE s IS NOT NULL AND s NOT IN (SELECT Segmented_Text_EWTS FROM segments WHERE Segmented_Text_EWTS IS NOT NULL)""")
def unresolved_sentences(spark, d):
    need = cleaning.unique_sentences(table(spark, d, "scored_pairs"), "SentenceA", "SentenceB")
    return need.join(table(spark, d, "segments").select(F.col("Segmented_Text_EWTS").alias("sentence")), "sentence", "left_anti")


@query("""SELECT DISTINCT ID, array_to_string(list_slice(string_split(ID, '_'), 1, 2), '_') AS batch, CASE WHEN is_unicode_score = false THEN 'emr' ELSE 'bws' END AS kind FROM merged_trainset""")
def batch_and_type(spark, d):
    t = table(spark, d, "merged_trainset")
    return t.select("ID", T.batch_key("ID").alias("batch"), T.score_type("is_unicode_score").alias("kind")).distinct()


@query("""SELECT doc_id, sha1(concat_ws('␞', coalesce(source, ''), coalesce(lang, ''), text)) AS uid FROM documents""")
def candidate_uids(spark, d):
    return table(spark, d, "documents").select("doc_id", T.candidate_uid("source", "lang", "text").alias("uid"))


@query(r"""WITH a AS (SELECT p_partkey, 'Thoughts: Most similar: P' || (p_partkey % 4 + 1) || chr(10) || 'LEAST SIMILAR - p' || (p_partkey % 7 + 1) t FROM part)
SELECT p_partkey, regexp_extract(t, '(?i)most\s*similar\s*[:\-]?\s*P([1-4])', 1) AS most, regexp_extract(t, '(?i)least\s*similar\s*[:\-]?\s*P([1-4])', 1) AS least FROM a""")
def parsed_answers(spark, d):
    a = table(spark, d, "part").select("p_partkey", F.concat(F.lit("Thoughts: Most similar: P"), F.col("p_partkey") % 4 + 1, F.lit("\nLEAST SIMILAR - p"), F.col("p_partkey") % 7 + 1).alias("t"))
    most, least = T.answer_labels("t")
    return a.select("p_partkey", F.coalesce(most.cast("string"), F.lit("")).alias("most"), F.coalesce(least.cast("string"), F.lit("")).alias("least"))


# ---- scores --------------------------------------------------------------------------------------------------------

_SCORED = f"(SELECT ID, any_value(SentenceA) SentenceA, any_value(SentenceB) SentenceB, min({NUM.format('score')}) score, min(lower(trim(split_name))) split, min(set_source) source FROM scored_pairs GROUP BY ID)"


def _scored(spark, d) -> DataFrame:
    s = table(spark, d, "scored_pairs")
    return s.groupBy("ID").agg(F.min("score").alias("score"), F.min(F.lower(F.trim("split_name"))).alias("split"), F.min("set_source").alias("source"))


@query(f"""SELECT p.ID, s.score FROM (SELECT DISTINCT ID FROM scored_pairs) p LEFT JOIN {_SCORED} s ON p.ID = s.ID""")
def score_left_join(spark, d):
    return cleaning.with_scores(table(spark, d, "scored_pairs").select("ID").distinct(), _scored(spark, d), "ID", "score", most_missing=0.5)


@query(f"""SELECT split, source, count(*) AS n, count(score) AS scored, round(avg(score), 9) AS mean, round(stddev_samp(score), 9) AS std, round(avg(CASE WHEN score IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing FROM {_SCORED} GROUP BY 1, 2""")
def trainset_stats(spark, d):
    return _scored(spark, d).groupBy("split", "source").agg(F.count("*").alias("n"), F.count("score").alias("scored"), F.round(F.avg("score"), 9).alias("mean"), F.round(F.stddev_samp("score"), 9).alias("std"), r6(cleaning.unmatched_share(None, "score")).alias("missing"))


@query(f"""SELECT CASE WHEN grouping(split) = 1 THEN 'aggregated' ELSE split END AS split, count(*) AS n, round(avg(score), 9) AS mean, round(max(score), 6) AS best FROM {_SCORED} GROUP BY GROUPING SETS ((split), ())""")
def metric_grouping_sets(spark, d):
    return results.metric_sets(_scored(spark, d), "split", {"n": F.count("*"), "mean": F.round(F.avg("score"), 9), "best": r6(F.max("score"))})


def _two_scores(spark, d) -> DataFrame:
    t = table(spark, d, "merged_trainset").select("ID", "FaissDistance", "score", "iteration_source").distinct()
    return t.where("FaissDistance is not null and score is not null")


_TWO = f"(SELECT DISTINCT ID, {NUM.format('FaissDistance')} x, {NUM.format('score')} y, iteration_source FROM merged_trainset WHERE NOT isnan(FaissDistance) AND NOT isnan(score))"


@query(f"""SELECT iteration_source, count(*) AS n, CASE WHEN stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN round(corr(x, y), 6) END AS pearson FROM {_TWO} GROUP BY 1""")
def pearson(spark, d):
    return stats.pearson(_two_scores(spark, d), ["iteration_source"], "FaissDistance", "score").select("iteration_source", "n", r6("pearson").alias("pearson"))


_RANK = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"


@query(f"""WITH r AS (SELECT {_RANK.format("x")} a, {_RANK.format("y")} b FROM {_TWO}) SELECT count(*) AS n, round(corr(a, b), 6) AS spearman FROM r""")
def spearman(spark, d):
    return stats.spearman(_two_scores(spark, d), [], "FaissDistance", "score").select("n", r6("spearman").alias("spearman"))


_GOLD = f"""(SELECT ID, -levenshtein({_CODED.format("a")}, {_CODED.format("b")})::DOUBLE x, y FROM (SELECT *, list_distinct(list_concat(a, b)) k FROM (SELECT ID, {_WORDS.format("SentenceA")} a, {_WORDS.format("SentenceB")} b, score y FROM gold_pairs WHERE NOT isnan(score))))"""


def _predicted(spark, d) -> DataFrame:
    return table(spark, d, "gold_pairs").select("ID", (-T.word_distance("SentenceA", "SentenceB")).cast("double").alias("predicted"))


@query(f"""WITH p AS (SELECT a.x ax, a.y ay, b.x bx, b.y b2, a.i, b.i j FROM (SELECT *, row_number() OVER () i FROM {_GOLD}) a, (SELECT *, row_number() OVER () i FROM {_GOLD}) b WHERE (a.x, a.y, a.i) <> (b.x, b.y, b.i))
SELECT round(sum(sign(ax - bx) * sign(ay - b2)) / sqrt(count(*) FILTER (ax <> bx) * count(*) FILTER (ay <> b2)), 6) AS kendall FROM p""")
def kendall(spark, d):
    g = table(spark, d, "gold_pairs").join(_predicted(spark, d), "ID").select(F.col("predicted").alias("x"), F.col("score").alias("y"))
    return stats.kendall(g, [], "x", "y").select(r6("kendall").alias("kendall"))


@query(f"""SELECT count(*) AS n, round(corr(x, y), 6) AS pearson FROM {_GOLD}""")
def gold_evaluation(spark, d):
    gold = table(spark, d, "gold_pairs")
    both = gold.join(_predicted(spark, d), "ID").where("score is not null and predicted is not null")
    return stats.pearson(both, [], "predicted", "score").select("n", r6("pearson").alias("pearson"))


@query(f"""WITH b AS (SELECT ID, array_to_string(list_slice(string_split(ID, '_'), 1, 2), '_') batch, {NUM.format('score')} s, is_unicode_score u FROM (SELECT DISTINCT ID, score, is_unicode_score FROM merged_trainset)),
m AS (SELECT batch, min(s) lo, max(s) hi FROM b WHERE u = false GROUP BY 1)
SELECT ID, b.batch, s AS unnormalized_score, CASE WHEN u = false THEN round(CASE WHEN hi - lo < 1e-9 THEN 0.0 ELSE (s - lo) / (hi - lo) END, 6) ELSE round(s, 6) END AS score FROM b LEFT JOIN m ON b.batch = m.batch""")
def minmax_by_batch(spark, d):
    t = table(spark, d, "merged_trainset").select("ID", "score", "is_unicode_score").distinct().withColumn("batch", T.batch_key("ID"))
    out = results.minmax(t, "score", ["batch"], "scaled", T.score_type("is_unicode_score") == "emr")
    return out.select("ID", "batch", F.col("score").alias("unnormalized_score"), r6("scaled").alias("score"))


@query(f"""WITH t AS (SELECT ID, min({NUM.format('FaissDistance')}) x, min({NUM.format('score')}) y FROM merged_trainset GROUP BY ID), m AS (SELECT min(x) xl, max(x) xh, min(y) yl, max(y) yh FROM t)
SELECT ID, round(0.3 * (x - xl) / (xh - xl) + 0.7 * (y - yl) / (yh - yl), 6) AS ensemble FROM t, m""")
def weighted_ensemble(spark, d):
    t = table(spark, d, "merged_trainset").groupBy("ID").agg(F.min("FaissDistance").alias("x"), F.min("score").alias("y"))
    return results.ensemble(t, ["x", "y"], [0.3, 0.7]).select("ID", r6("ensemble").alias("ensemble"))


@query(f"""WITH s AS (SELECT segment_no, v FROM (SELECT seg_no segment_no, noise_score v FROM segments)) SELECT count(*) AS n, round(avg(v) FILTER (NOT isnan(v) AND NOT isinf(v)), 6) AS mean, count(*) FILTER (isinf(v)) AS infinite, count(*) FILTER (isnan(v) OR v IS NULL) AS missing FROM s""")
def noise_summary(spark, d):
    s = table(spark, d, "segments").select(F.col("noise_score").alias("v"))
    inf = F.abs("v") == float("inf")
    return s.agg(F.count("*").alias("n"), r6(F.avg(F.when(~inf, F.col("v")))).alias("mean"), F.count_if(inf).alias("infinite"), F.count_if(F.col("v").isNull()).alias("missing"))


@query("""WITH p AS (SELECT DISTINCT ID, score, FaissDistance, set_source, iteration_source FROM (SELECT m.ID, m.score, m.FaissDistance, 'merged' set_source, m.iteration_source FROM merged_trainset m) WHERE NOT isnan(score) AND NOT isnan(FaissDistance))
SELECT iteration_source, count(*) AS times, round(avg(abs(FaissDistance - score)), 6) AS mean_error, round(count(*) * avg(abs(FaissDistance - score)), 6) AS disagreement, round(avg(score), 6) AS mean_label, string_agg(DISTINCT set_source, ',') AS sources FROM p WHERE abs(FaissDistance - score) > 0.3 GROUP BY 1""")
def wrong_pairs(spark, d):
    p = _two_scores(spark, d).withColumns({"error": F.col("FaissDistance") - F.col("score"), "set": F.lit("merged")}).where(F.abs("error") > 0.3)
    out = results.wrong_pairs(p, ["iteration_source"], "error", "score", "set")
    return out.select("iteration_source", "times", r6("mean_error").alias("mean_error"), r6("disagreement").alias("disagreement"), r6("mean_label").alias("mean_label"), "sources")


# ---- sampling ------------------------------------------------------------------------------------------------------


def _distances(spark, d) -> DataFrame:
    return table(spark, d, "selected_pairs").groupBy("ID").agg(F.min("FaissDistance").alias("x")).where("x is not null")


_DIST = "(SELECT ID, min(FaissDistance) x FROM selected_pairs WHERE NOT isnan(FaissDistance) GROUP BY ID)"
_BIN = f"(SELECT ID, x, {' + '.join(f'(x >= lo + (hi - lo) * {k} / 10)::INT' for k in range(1, 10))} AS bin FROM {_DIST}, (SELECT min(x) lo, max(x) hi FROM {_DIST}))"


@query(f"SELECT bin::INT AS bin, count(*) AS count, min(x) AS min, max(x) AS max FROM {_BIN} GROUP BY 1")
def equal_width_bins(spark, d):
    return sampling.bin_stats(sampling.minmax_bins(_distances(spark, d), "x", 10), "x")


_QCUT = f"(SELECT ID, x, (SELECT count(DISTINCT q) FROM (SELECT unnest(qs) q, unnest(range(11)) i FROM (SELECT quantile_cont(x, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]) qs FROM {_DIST})) WHERE i BETWEEN 1 AND 9 AND q < t.x) AS bin FROM {_DIST} t)"


@query(f"SELECT bin::INT AS bin, count(*) AS count, min(x) AS min, max(x) AS max FROM {_QCUT} GROUP BY 1")
def quantile_bins(spark, d):
    return sampling.bin_stats(sampling.quantile_bins(_distances(spark, d), "x", 10), "x")


_HASH = "md5('42|' || {0})"


@query(f"""WITH b AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY {_HASH.format("ID")}, ID) n FROM {_BIN}), f AS (SELECT * FROM b WHERE n <= 25),
r AS (SELECT *, row_number() OVER (ORDER BY {_HASH.format("ID")}, ID) m FROM b WHERE n > 25) SELECT ID, bin::INT AS bin FROM f UNION ALL SELECT ID, bin::INT FROM r WHERE m <= 250 - (SELECT count(*) FROM f)""")
def balanced_pick(spark, d):
    return sampling.balanced_pick(sampling.minmax_bins(_distances(spark, d), "x", 10), 250, 10, "bin", SEED, "ID").select("ID", "bin")


@query(f"""WITH b AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY {_HASH.format("ID")}, ID) n FROM {_QCUT}) SELECT ID, n <= 20 AS selected FROM b""")
def distribution_split(spark, d):
    x = _distances(spark, d)
    picked = sampling.quota_pick(sampling.quantile_bins(x, "x", 10), 200, "bin", SEED, "ID")
    return sampling.split_by_pick(x, picked, "ID").select("ID", "selected")


@query(f"""WITH r AS (SELECT ID, x, row_number() OVER (ORDER BY x, ID) - 1 p, count(*) OVER () n FROM {_DIST}), w AS (SELECT DISTINCT floor(i * (n - 1) / 99.0) p FROM (SELECT DISTINCT n FROM r), range(100) t(i)) SELECT ID, r.p AS place FROM r JOIN w ON r.p = w.p""")
def spread_pick(spark, d):
    return sampling.spread_pick(_distances(spark, d), 100, "x", "ID").select("ID", "place")


@query(f"SELECT ID FROM (SELECT DISTINCT ID FROM selected_pairs) ORDER BY {_HASH.format('ID')}, ID LIMIT 200")
def hash_sample(spark, d):
    return sampling.sample(table(spark, d, "selected_pairs").select("ID").distinct(), 200, SEED, "ID")


@query()
def random_pairs(spark, d):
    return sampling.random_pairs(table(spark, d, "documents"), "doc_id", "text", 250, 5, SEED)


# ---- best-worst scaling --------------------------------------------------------------------------------------------


def _tuples(spark, d) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    k = [F.concat(F.lit("c"), F.pmod(F.col("o_custkey") * m + F.col("o_orderkey"), F.lit(1009)).cast("string")) for m in (1, 3, 7, 11)]
    t = o.select(F.col("o_orderkey").alias("tuple_index"), *(c.alias(s) for c, s in zip(k, bws.SLOTS)))
    return t.where("id_1 <> id_2 and id_1 <> id_3 and id_1 <> id_4 and id_2 <> id_3 and id_2 <> id_4 and id_3 <> id_4")


_TUP = f"(SELECT * FROM (SELECT o_orderkey tuple_index, {', '.join(f'''concat('c', (o_custkey * {m} + o_orderkey) % 1009) id_{i + 1}''' for i, m in enumerate((1, 3, 7, 11)))} FROM orders) WHERE id_1 <> id_2 AND id_1 <> id_3 AND id_1 <> id_4 AND id_2 <> id_3 AND id_2 <> id_4 AND id_3 <> id_4)"
_LONG = f"(SELECT tuple_index, unnest([id_1, id_2, id_3, id_4]) id, unnest([0, 1, 2, 3]) slot FROM {_TUP})"
_ANN = f"(SELECT tuple_index, arg_min(id, (-s, slot)) best_pair, arg_min(id, (s, slot)) worst_pair FROM (SELECT *, substr(id, 2)::INT % 97 s FROM {_LONG}) GROUP BY 1)"


def _annotated(spark, d) -> DataFrame:
    t = _tuples(spark, d)
    scores = bws.slots_of(t).select("id").distinct().withColumn("s", F.substring("id", 2, 9).cast("int") % 97)
    return bws.annotated(t, scores, "id", "s")


@query(f"SELECT tuple_index, best_pair, worst_pair FROM {_ANN}")
def bws_annotate(spark, d):
    return _annotated(spark, d).select("tuple_index", "best_pair", "worst_pair")


@query(f"""WITH a AS {_ANN}, n AS (SELECT id, count(*) n FROM {_LONG} GROUP BY 1), b AS (SELECT best_pair id, count(*) b FROM a GROUP BY 1), w AS (SELECT worst_pair id, count(*) w FROM a GROUP BY 1)
SELECT n.id AS ID, coalesce(b, 0)::BIGINT AS best_count, coalesce(w, 0)::BIGINT AS worst_count, n::BIGINT AS appearances, round((coalesce(b, 0) - coalesce(w, 0)) / n, 6) AS raw_score, round(((coalesce(b, 0) - coalesce(w, 0)) / n + 1) / 2, 6) AS score FROM n LEFT JOIN b ON n.id = b.id LEFT JOIN w ON n.id = w.id""")
def bws_score(spark, d):
    s = bws.counting_scores(_annotated(spark, d))
    return s.select("ID", "best_count", "worst_count", "appearances", r6("raw_score").alias("raw_score"), r6("score").alias("score"))


@query("""WITH ids AS (SELECT DISTINCT ID id FROM selected_pairs WHERE ID IS NOT NULL), n AS (SELECT greatest(1, least(256, count(*) // 64)) cells FROM ids),
p AS (SELECT id, r, md5('42-' || r || '|' || id) h FROM ids, range(2) t(r)), k AS (SELECT id, r, h, ('0x' || substr(h, 1, 8))::BIGINT % cells AS cell FROM p, n),
w AS (SELECT *, row_number() OVER (PARTITION BY r, cell ORDER BY h, id) - 1 AS k, count(*) OVER (PARTITION BY r, cell) AS n FROM k),
x AS (SELECT id, r, cell, k FROM w WHERE n >= 4 UNION ALL SELECT id, r, cell, n + k FROM w WHERE n >= 4 AND k < (4 - n % 4) % 4)
SELECT printf('%02d_%04d_%06d', r, cell, k // 4) AS tuple_index, max(id) FILTER (k % 4 = 0) AS id_1, max(id) FILTER (k % 4 = 1) AS id_2, max(id) FILTER (k % 4 = 2) AS id_3, max(id) FILTER (k % 4 = 3) AS id_4 FROM x GROUP BY r, cell, k // 4""")
def bws_tuples(spark, d):
    return bws.four_tuples(table(spark, d, "selected_pairs"), "ID")


@query()
def bws_tuple_texts(spark, d):
    p = table(spark, d, "selected_pairs")
    return bws.with_texts(bws.four_tuples(p, "ID"), p, "ID", "SentenceA", "SentenceB")


@query(f"""WITH x AS (SELECT tuple_index, [id_1, id_2, id_3, id_4] f, (tuple_index % 5)::INT m, (tuple_index % 4 + 1)::INT l FROM {_TUP}),
y AS (SELECT *, m BETWEEN 1 AND 4 AND m <> l ok, list_transform(list_sort(list_transform(f, lambda i: md5('42|' || tuple_index || '|' || i) || i)), lambda z: substr(z, 33)) h FROM x)
SELECT tuple_index, CASE WHEN ok THEN f[m] ELSE h[1] END AS best_pair, CASE WHEN ok THEN f[l] ELSE h[2] END AS worst_pair, CASE WHEN ok THEN '1' ELSE '*' END AS trials FROM y""")
def bws_answers(spark, d):
    t = _tuples(spark, d).withColumn("answer", F.concat(F.lit("Most similar: P"), F.col("tuple_index") % 5, F.lit(" Least similar: P"), F.col("tuple_index") % 4 + 1))
    return bws.resolved_answers(t, "answer", SEED).select("tuple_index", "best_pair", "worst_pair", "trials")


@query(f"SELECT tuple_index FROM {_TUP} WHERE tuple_index NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def bws_resume(spark, d):
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("tuple_index"))
    return bws.still_open(_tuples(spark, d), done).select("tuple_index")


# ---- results algebra -----------------------------------------------------------------------------------------------


def _log(spark, d) -> DataFrame:
    """Line items as a log of runs: model, set, epoch and two metrics."""
    li = table(spark, d, "lineitem")
    return li.select(F.concat(F.lit("lab/m"), F.col("l_suppkey") % 7).alias("model"), F.concat(F.lit("set_"), F.element_at(F.array(*map(F.lit, "ABCD")), F.col("l_linenumber") % 4 + 1), F.lit("_"), F.lower("l_returnflag")).alias("file"), F.format_string("epoch_%d", F.col("l_linenumber")).alias("epoch"), F.col("l_discount").cast("double").alias("m1"), F.col("l_tax").cast("double").alias("m2"), F.col("l_orderkey").alias("run"), "l_linenumber")


_LOG = "(SELECT concat('lab/m', l_suppkey % 7) model, concat('set_', ['A','B','C','D'][(l_linenumber % 4 + 1)::INT], '_', lower(l_returnflag)) file, concat('epoch_', l_linenumber) epoch, l_discount::DOUBLE m1, l_tax::DOUBLE m2, l_orderkey run, l_linenumber FROM lineitem)"
_ONESET = r"regexp_replace(file, '_[ABCD]_', '_X_', 'g')"


@query(f"""SELECT string_split(model, '/')[-1] AS model_short, {_ONESET} AS file_x, round(avg(m1), 6) AS m1_mean, round(stddev_samp(m1), 6) AS m1_std, round(avg(m2), 6) AS m2_mean, round(stddev_samp(m2), 6) AS m2_std, count(*) AS n_rows FROM {_LOG} GROUP BY 1, 2""")
def kfold_aggregate(spark, d):
    rows = _log(spark, d).select(T.short_name("model").alias("model_short"), T.one_set_letter("file").alias("file_x"), "m1", "m2")
    out = results.fold_means(rows, ["model_short", "file_x"], ["m1", "m2"])
    return out.select("model_short", "file_x", *(r6(c).alias(c) for c in ("m1_mean", "m1_std", "m2_mean", "m2_std")), "n_rows")


_EPOCHS = f"(SELECT model, {_ONESET} file_x, epoch, round(avg(m1), 9) m1, count(*) n_rows FROM {_LOG} WHERE regexp_matches(epoch, '^epoch_\\d+$') GROUP BY 1, 2, 3)"


def _epochs(spark, d) -> DataFrame:
    rows = _log(spark, d).where(F.col("epoch").rlike(r"^epoch_\d+$"))
    return rows.groupBy("model", T.one_set_letter("file").alias("file_x"), "epoch").agg(F.round(F.avg("m1"), 9).alias("m1"), F.count("*").alias("n_rows"))


@query(f"""SELECT model, file_x, epoch, round(m1, 6) AS m1, n_rows FROM (SELECT *, row_number() OVER (PARTITION BY model, file_x ORDER BY m1 DESC NULLS LAST, epoch) k FROM {_EPOCHS}) WHERE k = 1""")
def best_epoch(spark, d):
    return results.best_rows(_epochs(spark, d), ["model", "file_x"], "m1", ["epoch"]).select("model", "file_x", "epoch", r6("m1").alias("m1"), "n_rows")


@query(f"""SELECT model, file_x, epoch, n_rows FROM {_EPOCHS} WHERE n_rows <> 4""")
def incomplete_folds(spark, d):
    return results.incomplete(_epochs(spark, d)).select("model", "file_x", "epoch", "n_rows")


@query(f"""WITH a AS (SELECT model, substr(file, 7) setting, avg(m1) m FROM {_LOG} GROUP BY 1, 2) SELECT model, {", ".join(f"round(max(m) FILTER (setting = '{s}'), 6) AS {s}_m" for s in "anr")} FROM a GROUP BY 1""")
def setting_pivot(spark, d):
    a = _log(spark, d).groupBy("model", F.substring("file", 7, 9).alias("setting")).agg(r6(F.avg("m1")).alias("m"))
    return results.pivoted(a, "model", "setting", list("anr"), ["m"])


@query(f"""WITH a AS (SELECT model, round(avg(m1), 9) m1, round(avg(m2), 9) m2 FROM {_LOG} GROUP BY 1) SELECT model, abs(m1 - max(m1) OVER ()) < 1e-9 AS m1_best, abs(m2 - max(m2) OVER ()) < 1e-9 AS m2_best FROM a""")
def best_flags(spark, d):
    a = _log(spark, d).groupBy("model").agg(F.round(F.avg("m1"), 9).alias("m1"), F.round(F.avg("m2"), 9).alias("m2"))
    return results.best_flags(a, ["m1", "m2"]).select("model", "m1_best", "m2_best")


@query(f"""SELECT model, file_x, CASE WHEN n_rows >= 400 THEN round(m1, 6) END AS m1, n_rows FROM (SELECT model, {_ONESET} file_x, avg(m1) m1, count(*) n_rows FROM {_LOG} GROUP BY 1, 2)""")
def masked_means(spark, d):
    a = _log(spark, d).groupBy("model", T.one_set_letter("file").alias("file_x")).agg(F.avg("m1").alias("m1"), F.count("*").alias("n_rows"))
    return results.masked(a, ["m1"], 400).select("model", "file_x", r6("m1").alias("m1"), "n_rows")


@query("""WITH o AS (SELECT o_custkey k, o_orderstatus s, o_orderkey n, o_totalprice v FROM orders), new AS (SELECT c_custkey k, 'F' s, c_acctbal v FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY k, s ORDER BY n) i FROM o) SELECT k, s, round(v, 2) AS v, true AS fresh FROM new UNION ALL SELECT k, s, round(v, 2), NULL FROM r WHERE NOT (i = 1 AND s = 'F' AND k IN (SELECT k FROM new))""")
def log_upsert(spark, d):
    log = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_orderkey").alias("n"), F.col("o_totalprice").alias("v"))
    new = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lit("F").alias("s"), F.col("c_acctbal").alias("v"), F.lit(True).alias("fresh"))
    return results.upsert(log, new, ["k", "s"], ["n"]).select("k", "s", F.round("v", 2).alias("v"), "fresh")


@query("""SELECT ID, SentenceA, SentenceB, 'gold' AS origin FROM gold_pairs UNION ALL SELECT ID, SentenceA, SentenceB, 'scored' FROM scored_pairs UNION ALL SELECT ID, SentenceA, SentenceB, 'selected' FROM selected_pairs""")
def united_sets(spark, d):
    frames = {n: table(spark, d, t).select("ID", "SentenceA", "SentenceB") for n, t in (("gold", "gold_pairs"), ("scored", "scored_pairs"), ("selected", "selected_pairs"))}
    return results.united(frames, "origin")


@query(f"""SELECT coalesce(a.model, b.model) AS model, round(a.m, 6) AS first_m, round(b.m, 6) AS second_m FROM (SELECT model, avg(m1) m FROM {_LOG} WHERE file LIKE 'set_A%' GROUP BY 1) a FULL JOIN (SELECT model, avg(m1) m FROM {_LOG} WHERE file LIKE 'set_B%' AND model <> 'lab/m3' GROUP BY 1) b ON a.model = b.model""")
def side_by_side(spark, d):
    log = _log(spark, d)
    mean = lambda rows: rows.groupBy("model").agg(r6(F.avg("m1")).alias("m"))
    return results.side_by_side({"first": mean(log.where("file like 'set_A%'")), "second": mean(log.where("file like 'set_B%' and model <> 'lab/m3'"))}, "model")


@query("SELECT n_name AS model, l AS lr, e AS epochs FROM nation, (VALUES (0.1), (0.01)) a(l), (VALUES (1), (2), (4)) b(e)".replace("(0.1), (0.01)", "(0.1::DOUBLE), (0.01::DOUBLE)"))
def settings_grid(spark, d):
    return results.settings_grid(spark, {"lr": [0.1, 0.01], "epochs": [1, 2, 4]}, table(spark, d, "nation").select(F.col("n_name").alias("model")))


# ---- hooks and stream ----------------------------------------------------------------------------------------------


@query()
def encoded_pairs(spark, d):
    encode = hooks.encoder(hooks.hash_embedding)
    p = table(spark, d, "gold_pairs").select("ID", "SentenceA", "SentenceB", "score")
    both = hooks.encode_distinct(hooks.encode_distinct(p, "SentenceA", encode, "ea"), "SentenceB", encode, "eb")
    return both.select("ID", V.cosine(V.as_doubles("ea"), V.as_doubles("eb")).alias("cosine"), "score")


@query("""SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def event_windows(spark, d):
    out = windows.windowed(table(spark, d, "events"), "ts", "event_type", "value")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))
