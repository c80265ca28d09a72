"""Problem 9: mixing sources to target weights by Poisson replication.

Every document's tokens are counted with a public tokenizer, and a hash of its number and the seed gives it a uniform
number.  A source's documents are repeated as often as a Poisson variable of the source's mean says at that number, at
most ``max_repeats`` times.  The mean is found by bisection on a histogram of the source's tokens over the uniform
number, taken in one pass over all documents, and of the means about it the one whose documents really come closest is
taken in a second; shares are met up to about one document.  The mixture
is as large as the scarcest source allows at its cap.  Copies are then shuffled globally by a hash.

Cases: a missing or blank source is 'unknown' and, like any source without a target, left out of the mixture and
reported with target 0; a target without documents is reported with 0 tokens and its share is missed; null and empty
texts count 0 tokens and are left out; repeated document numbers are one document (of the smallest source, then the
fewest tokens, then the smallest hash of the text); ties of hashes go to
the smaller number.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import stage

TOKENIZERS = os.environ.get("SIMLOOM_TOKENIZERS", "/opt/tokenizers")
TOKENIZER = "byte_bpe_50k.tiktoken"
SEED = 20_240_607
STEPS = 4096  # of the uniform number, in the histogram
MOST_TARGETS = 1000
# Fixed value: how the vocabulary's authors cut text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("mixing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


_encoders: dict[str, object] = {}


def _counted(batches, path: str):
    enc = _encoders.get(path) or _encoders.setdefault(path, _encoder(path))
    for batch in batches:
        n = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("source"), batch.column("h"), pa.array(n, pa.int64())], ["id", "source", "h", "tokens"])


def sizes(docs: DataFrame, doc_id: str, text: str, source: Column, tokenizer: str = TOKENIZER, folder: str = TOKENIZERS) -> DataFrame:
    """(id, source, tokens, h, u): h hashes the text; u in (0, 1) by a hash of the number and the seed."""
    path = os.path.join(folder, tokenizer)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), source.alias("source"), F.col(text).cast("string").alias("text")).where("id is not null and length(text) > 0")
    counted = rows.withColumn("h", F.xxhash64("text")).mapInArrow(lambda it: _counted(it, path), "id long, source string, h long, tokens long")
    once = counted.groupBy("id").agg(F.min(F.struct("source", "tokens", "h")).alias("x")).select("id", "x.source", "x.tokens", "x.h")
    u = (F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return once.where("tokens > 0").withColumn("u", u)


def poisson_steps(mean: float, cap: int) -> list[float]:
    """P(X <= k) for k below the cap: a document is repeated once for each step that its uniform number passes."""
    p, total, out = float(np.exp(-mean)), 0.0, []
    for k in range(cap):
        total += p
        out.append(min(total, 1.0))
        p *= mean / (k + 1)
    return out


def _repeats(u: Column, steps: list[float]) -> Column:
    out = F.lit(0)
    for s in steps:
        out = out + F.when(u >= s, 1).otherwise(0)
    return out


def tokens_at(histogram: np.ndarray, mean: float, cap: int) -> float:
    """Tokens that come out at a mean, from a source's tokens by equal steps of the uniform number."""
    above = np.append(histogram[::-1].cumsum()[::-1], 0.0)  # tokens from each step's lower edge on
    at = np.array(poisson_steps(mean, cap)) * len(histogram)
    low = np.minimum(at.astype(int), len(histogram) - 1)
    return float((above[low] - (at - low) * histogram[low]).sum())


def means_for(sized: DataFrame, goals: dict[str, float], caps: dict[str, int]) -> dict[str, float]:
    """Per source the Poisson mean whose capped tokens come closest to the goal.

    One pass: the driver gets each source's tokens by STEPS equal steps of the uniform number, and inverts the sum.
    """
    rows = sized.where(F.col("source").isin([*goals])).groupBy("source", F.floor(F.col("u") * STEPS).cast("int").alias("step")).agg(F.sum("tokens").alias("t"))
    histograms = {s: np.zeros(STEPS) for s in goals}
    for s, step, t in rows.collect():
        histograms[s][step] = t
    means = {}
    for s, goal in goals.items():
        lo, hi = 0.0, caps[s] + 12 * float(np.sqrt(caps[s])) + 40  # at the upper end all documents are at the cap
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if tokens_at(histograms[s], mid, caps[s]) < goal else (lo, mid)
        means[s] = hi
    return _nearest_means(sized, goals, caps, means)


def _nearest_means(sized: DataFrame, goals: dict[str, float], caps: dict[str, int], means: dict[str, float]) -> dict[str, float]:
    """Of means near those found the ones whose realised tokens, document by document, come closest to the goals."""
    shifts = [0.0, *(sign * 2.0**k / 4096 for k in range(9) for sign in (-1, 1))]
    tried = [(s, [poisson_steps(m * (1 + x), caps[s]) for x in shifts]) for s, m in means.items()]
    cuts = F.broadcast(sized.sparkSession.createDataFrame(tried, "s string, cuts array<array<double>>"))  # a row for each target
    repeats = lambda k: F.size(F.filter(F.get("cuts", F.lit(k)), lambda c: F.col("u") >= c))
    sums = sized.join(cuts, F.col("source") == F.col("s")).groupBy("s").agg(*(F.sum(F.col("tokens") * repeats(k)).alias(f"t{k}") for k in range(len(shifts))))
    out = dict(means)
    for s, *got in sums.collect():
        best = min(range(len(shifts)), key=lambda k: (abs(got[k] - goals[s]), abs(shifts[k])))
        out[s] = means[s] * (1 + shifts[best])
    return out


def plan(sized: DataFrame, targets: list[tuple[str, float, int]]):
    """Available tokens, goals and Poisson means by source."""
    have = {r[0]: (r[1], r[2]) for r in sized.groupBy("source").agg(F.sum("tokens"), F.count("*")).where(F.col("source").isin([t[0] for t in targets])).collect()}
    usable = [(s, share, cap) for s, share, cap in targets if s in have and share and share > 0 and cap and cap > 0]
    total = min((have[s][0] * cap / share for s, share, cap in usable), default=0.0)
    goals = {s: total * share for s, share, _ in usable}
    caps = {s: cap for s, _, cap in usable}
    return have, goals, caps, means_for(sized, goals, caps) if goals else {}


def mixture(docs: DataFrame, doc_id: str, text: str, source: Column, targets: list[tuple[str, float, int]], **kw) -> tuple[DataFrame, DataFrame, dict]:
    """The documents' repeats (id, source, tokens, n), the sizes they are of, and the goals by source."""
    sized = stage(sizes(docs, doc_id, text, source, **kw), "sizes")
    have, goals, caps, means = plan(sized, targets)
    n = F.lit(0)
    for s, m in means.items():
        n = F.when(F.col("source") == s, _repeats(F.col("u"), poisson_steps(m, caps[s]))).otherwise(n)
    return sized.select("id", "source", "tokens", "h", n.cast("int").alias("n")), sized, goals


def mixed(docs: DataFrame, doc_id: str, text: str, source: Column, targets, seed: int = SEED, **kw) -> DataFrame:
    """(place, id, copy, source, tokens, text): all copies, shuffled globally; place is the hash that orders them."""
    repeats = mixture(docs, doc_id, text, source, targets, **kw)[0].where("n > 0")
    texts = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).cast("string").alias("text")).where("d is not null")
    each = repeats.join(texts, (F.col("id") == F.col("d")) & (F.col("h") == F.xxhash64("text"))).groupBy("id", "source", "tokens", "n").agg(F.min("text").alias("text"))
    copies = each.select("id", "source", "tokens", "text", F.explode(F.sequence(F.lit(1), "n")).alias("copy"))
    placed = copies.select(F.xxhash64("id", "copy", F.lit(seed)).alias("place"), "id", "copy", "source", "tokens", "text")
    return placed.repartitionByRange("place").sortWithinPartitions("place", "id", "copy")


def shares(docs: DataFrame, doc_id: str, text: str, source: Column, targets, **kw) -> DataFrame:
    """Per source: documents, tokens there are, tokens in the mixture, and the share reached against the target."""
    repeats = mixture(docs, doc_id, text, source, targets, **kw)[0]
    spark = docs.sparkSession
    want = spark.createDataFrame([(s, float(p), int(c)) for s, p, c in targets], "w string, target_share double, max_repeats int")
    per = repeats.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens_available"), F.sum(F.col("tokens") * F.col("n")).alias("tokens_mixed"), F.max("n").alias("most_repeats"))
    both = per.join(want, F.col("source") == F.col("w"), "full")
    zero = F.lit(0).cast("long")
    rows = both.select(F.coalesce("source", "w").alias("source"), F.coalesce("documents", zero).alias("documents"), F.coalesce("tokens_available", zero).alias("tokens_available"), F.coalesce("tokens_mixed", zero).alias("tokens_mixed"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), "max_repeats", F.coalesce("target_share", F.lit(0.0)).alias("target_share"))
    return rows.withColumn("share", F.try_divide(F.col("tokens_mixed").cast("double"), F.sum("tokens_mixed").over(Window.partitionBy())))
