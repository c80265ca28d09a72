"""Problem 4: similarity clusters by a Gaussian mixture.

Unit vectors are standardised and reduced to their leading principal features; a mixture of full, regularised Gaussians
is fitted by expectation-maximisation over all rows, for several numbers of components at once, and the Bayesian
information criterion chooses among them.  Every pass sends one row of sums per component from each task.

A vector is at home in the component of its best posterior and is sent as well to every component whose posterior is
within ``margin`` (log units) of that.  A component's own vectors are compared with all that were sent to it (in
tiles), vectors of cosine at or above the threshold are linked, and links are joined into clusters.  The README has
the measured loss of pairs by margin.  A cluster's most typical members are those of the
highest density under the mixture.

Cases: missing, zero, short and non-finite vectors are in no cluster; equal vectors are one class until the end;
ties in density go to the smaller number; repeated rows are one row; an empty table gives no cluster.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .frames import drop, stage
from .neighbours import runs
from .vectors import dimension, equal_classes, stack, unit

FEATURES, COMPONENTS, ROUNDS = 32, (16, 32, 64), 6
SHRINK, PRIOR = 0.05, 4.0  # ridge; rows per dimension that the whole table's covariance weighs in each component's
LEAST, MARGIN, TILE, ROWS = 0.75, 8.0, 40_000, 1024
MOST_CHUNKS = 4095
UNSURE = 6e-5  # cosines of 16-bit directions that are nearer to the bar are computed again


def _moments(batches, dim: int):
    n, s, q = 0, np.zeros(dim), np.zeros((dim, dim))
    for batch in batches:
        if batch.num_rows:
            u = unit(stack(batch, dim))
            n, s, q = n + len(u), s + u.sum(0), q + u.T @ u
    yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([n], pa.float64()), pa.array([np.concatenate([s, q.ravel()]).tolist()], pa.list_(pa.float64()))], ["part", "n", "sums"])


def _added(batches):
    total: dict[int, list] = {}
    for batch in batches:
        for part, n, sums in zip(batch.column("part").to_pylist(), batch.column("n").to_pylist(), batch.column("sums")):
            v = sums.values.to_numpy()
            if part in total:
                total[part][0] += n
                total[part][1] += v
            else:
                total[part] = [n, v.copy()]
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([t[0] for t in total.values()], pa.float64()), pa.array([t[1].tolist() for t in total.values()], pa.list_(pa.float64()))], ["part", "n", "sums"])


SUMS = "part long, n double, sums array<double>"


def _gather(sums: DataFrame) -> dict[int, tuple[float, np.ndarray]]:
    """Sums by part: added up by part in executors; the driver gets a row for each part."""
    rows = sums.repartition("part").mapInArrow(_added, SUMS).collect()
    out: dict[int, tuple[float, np.ndarray]] = {}
    for part, n, v in rows:
        m = out.get(part)
        out[part] = (n, np.array(v)) if m is None else (m[0] + n, m[1] + np.array(v))
    return out


class Mixture:
    """Weights, means and covariances of one mixture, with what densities need."""

    def __init__(self, weights, means, covariances):
        self.w, self.m, self.c = weights, means, covariances
        d = means.shape[1]
        low = np.linalg.cholesky(covariances)
        self.inv = np.linalg.inv(low)
        self.const = np.log(weights) - np.log(np.diagonal(low, axis1=1, axis2=2)).sum(1) - 0.5 * d * np.log(2 * np.pi)
        self.wide = self.inv.reshape(-1, d).T.astype(np.float32)
        self.shift32 = np.einsum("kij,kj->ki", self.inv, means).ravel().astype(np.float32)

    def log_parts(self, z: np.ndarray) -> np.ndarray:
        """log(weight x density) of every row under every component."""
        k, d = self.m.shape
        out = np.empty((len(z), k))
        for s in range(0, len(z), ROWS):
            y = z[s : s + ROWS].astype(np.float32) @ self.wide - self.shift32
            y *= y
            out[s : s + ROWS] = y.reshape(len(y), k, d).sum(2)
        return self.const - 0.5 * out


def log_sum(parts: np.ndarray) -> np.ndarray:
    top = parts.max(1)
    return top + np.log(np.exp(parts - top[:, None]).sum(1))


def _expect(batches, mixtures: list[Mixture], d: int):
    """Per component: posterior mass, first and second moments; per mixture (part -1, -2, ...) the log likelihood."""
    sums: dict[int, list] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        z = np.frombuffer(b"".join(batch.column("z").to_pylist()), np.float32).reshape(-1, d)
        start = 0
        for i, m in enumerate(mixtures):
            parts = m.log_parts(z)
            whole = log_sum(parts)
            r = np.exp(parts - whole[:, None])
            mass, first = r.sum(0), r.T @ z.astype(np.float64)
            for k in range(len(mass)):
                near = r[:, k] > 1e-7
                zk = z[near]
                second = (zk * r[near, k, None].astype(np.float32)).T @ zk
                s = sums.setdefault(start + k, [0.0, 0.0])
                s[0] += mass[k]
                s[1] = s[1] + np.concatenate([first[k], second.ravel()])
            s = sums.setdefault(-1 - i, [0.0, np.zeros(1)])
            s[0] += len(z)
            s[1] = s[1] + whole.sum()
            start += len(mass)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([s[0] for s in sums.values()], pa.float64()), pa.array([np.atleast_1d(s[1]).tolist() for s in sums.values()], pa.list_(pa.float64()))], ["part", "n", "sums"])


def _reduced(batches, dim: int, mean, scale, axes):
    for batch in batches:
        if batch.num_rows:
            z = ((unit(stack(batch, dim)) - mean) / scale @ axes).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([r.tobytes() for r in z], pa.binary())], ["id", "z"])


def _start(z: np.ndarray, k: int, seed: int) -> Mixture:
    """Means spread over a sample: each next one far from those before."""
    rng = np.random.default_rng(seed)
    k = min(k, len(np.unique(z, axis=0)))
    means = [z[rng.integers(len(z))]]
    far = ((z - means[0]) ** 2).sum(1)
    for _ in range(k - 1):
        means.append(z[rng.choice(len(z), p=far / far.sum())] if far.sum() > 0 else z[rng.integers(len(z))])
        far = np.minimum(far, ((z - means[-1]) ** 2).sum(1))
    cov = np.cov(z.T).reshape(z.shape[1], -1) if len(z) > 1 else np.eye(z.shape[1])
    cov = cov * 0.5 + SHRINK * np.eye(z.shape[1])
    return Mixture(np.full(k, 1 / k), np.array(means), np.repeat(cov[None], k, 0))


class Model:
    def __init__(self, mean, scale, axes, mixture: Mixture, bic: dict[int, float]):
        self.mean, self.scale, self.axes, self.mixture, self.bic = mean, scale, axes, mixture, bic


def fit(vectors: DataFrame, dim: int, sample: int = 4096, features: int = FEATURES, choices=COMPONENTS, rounds: int = ROUNDS) -> Model | None:
    """The mixture over all rows of (id, v); the sample only spreads the first means."""
    moments = _gather(vectors.mapInArrow(lambda it: _moments(it, dim), SUMS))
    n, sums = moments.get(0, (0, None))
    if not n:
        return None
    mean = sums[:dim] / n
    cov = sums[dim:].reshape(dim, dim) / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    values, axes = np.linalg.eigh(cov / np.outer(scale, scale))
    d = min(features, dim)
    axes = axes[:, ::-1][:, :d]
    whole = np.diag(np.maximum(values[::-1][:d], 1e-9))
    reduced = stage(vectors.mapInArrow(lambda it: _reduced(it, dim, mean, scale, axes), "id long, z binary"), "features")
    some = reduced.orderBy(F.xxhash64("id")).limit(sample).toArrow().column("z").to_pylist()
    z = np.frombuffer(b"".join(some), np.float32).reshape(-1, d).astype(np.float64)
    mixtures = [_start(z, k, seed=k) for k in choices if k * 8 <= n or k == min(choices)]
    bic: dict[int, float] = {}
    for step in range(rounds + 1):
        now = mixtures
        sums = _gather(reduced.mapInArrow(lambda it, m=now: _expect(it, m, d), SUMS))
        if step == rounds:
            break
        start, mixtures = 0, []
        for m in now:
            k = len(m.w)
            w, mu, c = np.empty(k), np.empty((k, d)), np.empty((k, d, d))
            for j in range(k):
                mass, v = sums[start + j]
                mass = max(mass, 1e-6)
                w[j], mu[j] = mass / n, v[:d] / mass
                own = v[d:].reshape(d, d) - mass * np.outer(mu[j], mu[j])
                c[j] = (own + PRIOR * d * whole) / (mass + PRIOR * d) + SHRINK * np.eye(d)
            start += k
            mixtures.append(Mixture(w / w.sum(), mu, c))
    for i, m in enumerate(mixtures):
        k = len(m.w)
        free = k - 1 + k * d + k * d * (d + 1) / 2
        bic[k] = free * np.log(n) - 2 * float(sums[-1 - i][1][0])
    drop(reduced)
    best = min(range(len(mixtures)), key=lambda i: bic[len(mixtures[i].w)])
    return Model(mean, scale, axes, mixtures[best], bic)


def _parts(x: np.ndarray, model: Model) -> np.ndarray:
    return model.mixture.log_parts((unit(x) - model.mean) / model.scale @ model.axes)


def _shipped(batches, dim: int, model: Model, margin: float, chunks: dict[int, tuple[int, int]] | None):
    """Each vector to the tiles of its component and of those it is near; or, without chunks, the components' sizes.

    A tile (i, j) of a component has chunk i of its own vectors (flag 1) and chunk j of its own and near ones (flag 2).
    Vectors travel as directions in 16-bit numbers.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        x = stack(batch, dim)
        parts = _parts(x, model)
        home = parts.argmax(1)
        rows, comp = np.nonzero(parts >= parts.max(1)[:, None] - margin)
        own = comp == home[rows]
        if chunks is None:
            k = parts.shape[1]
            n, h = np.bincount(comp, minlength=k), np.bincount(home, minlength=k)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(n), pa.array(h)], ["block", "n", "h"])
            continue
        u = unit(x)
        u = np.round(u / np.abs(u).max(1)[:, None] * 32767).astype(np.int16)
        ids = batch.column("id").to_numpy()
        mix = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        cut = np.array([chunks.get(k, (1, 1)) for k in range(parts.shape[1])]).astype(np.uint64)
        i, j = (mix[rows] % cut[comp, 0]).astype(np.int64), (mix[rows] // cut[comp, 0] % cut[comp, 1]).astype(np.int64)
        at, block, flag = [], [], []
        for c in range(int(cut[:, 0].max())):
            has = cut[comp, 0] > c
            at.append(rows[has])
            block.append((comp[has].astype(np.int64) << 24) + (c << 12) + j[has])
            flag.append(2 + (own[has] & (i[has] == c)))
        for c in range(int(cut[:, 1].max())):
            has = own & (cut[comp, 1] > c) & (j != c)
            at.append(rows[has])
            block.append((comp[has].astype(np.int64) << 24) + (i[has] << 12) + c)
            flag.append(np.ones(int(has.sum()), np.int64))
        at, block, flag = np.concatenate(at), np.concatenate(block), np.concatenate(flag)
        flat = pa.py_buffer(np.ascontiguousarray(u[at]))
        packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * dim), len(at), [None, flat]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(flag.astype(np.int32)), batch.column("id").take(pa.array(at)), packed], ["block", "flag", "id", "d"])


def _joined(label: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Labels (each row's smallest known relative) after the links p-q, by hooking and shortcutting arrays."""
    while True:
        a, b = label[p], label[q]
        apart = a != b
        if not apart.any():
            return label
        p, q = p[apart], q[apart]
        lo, hi = np.minimum(a[apart], b[apart]), np.maximum(a[apart], b[apart])
        up = label.copy()
        np.minimum.at(up, hi, lo)
        while not np.array_equal(jumped := up[up], up):
            up = jumped
        label = up[label]


def tile_links(x: np.ndarray, flag: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Each row's label, the first row that it is linked to directly or through others; and pairs too near the bar to tell."""
    u = unit(x).astype(np.float32)
    label = np.arange(len(x))
    mine, all_ = np.flatnonzero(flag & 1), np.flatnonzero(flag & 2)
    other, unsure = u[all_].T.copy(), []
    for s in range(0, len(mine), 512):
        c = u[mine[s : s + 512]] @ other
        p, q = np.nonzero(c >= least - UNSURE)
        near = c[p, q] < least + UNSURE
        p, q = mine[p + s], all_[q]
        label = _joined(label, p[~near], q[~near])
        unsure.append(np.stack([p[near], q[near]]))
    pairs = np.concatenate(unsure, axis=1) if unsure else np.zeros((2, 0), np.int64)
    return label, pairs[:, label[pairs[0]] != label[pairs[1]]]


def _linked(batches, dim: int, least: float):
    for t in runs(batches, "block"):
        ids, flag = t.column("id").to_numpy(), t.column("flag").to_numpy()
        ids, once = np.unique(ids, return_index=True)  # a repeated row has the same flag
        x = np.frombuffer(b"".join(t.column("d").take(pa.array(once)).to_pylist()), np.int16).reshape(-1, dim)
        label, unsure = tile_links(x, flag[once], least)
        hung = np.flatnonzero(label != np.arange(len(label)))
        a, b = np.concatenate([ids[label[hung]], ids[unsure[0]]]), np.concatenate([ids[hung], ids[unsure[1]]])
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.arange(len(a)) < len(hung))], ["a", "b", "sure"])


def _close(batches, dim: int, least: float):
    for batch in batches:
        if batch.num_rows:
            ok = pa.array((unit(stack(batch, dim, "va")) * unit(stack(batch, dim, "vb"))).sum(1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], ["a", "b"])


def clusters(df: DataFrame, id_col: str, col: str, least: float = LEAST, margin: float = MARGIN, tile: int = TILE):
    """(node, root) for every vector that is in a cluster of two and more; and the model, with the vectors it is of."""
    dim = dimension(df, col)
    spark = df.sparkSession
    if not dim:
        return spark.createDataFrame([], "node long, root long"), None, None, 0
    vectors, members = equal_classes(df, id_col, col, dim)
    model = fit(vectors, dim)
    if model is None:
        return spark.createDataFrame([], "node long, root long"), None, None, dim
    sizes = vectors.mapInArrow(lambda it: _shipped(it, dim, model, margin, None), "block long, n long, h long").groupBy("block").agg(F.sum("n"), F.sum("h"))
    chunks = {r[0]: (max(1, -(-r[2] // tile)), max(1, -(-r[1] // tile))) for r in sizes.collect()}  # a row for each component
    if max(max(c) for c in chunks.values()) > MOST_CHUNKS:
        raise ValueError(f"a component has more than {MOST_CHUNKS} chunks of {tile} vectors: give more components or larger tiles")
    shipped = vectors.mapInArrow(lambda it: _shipped(it, dim, model, margin, chunks), "block long, flag int, id long, d binary")
    links = stage(shipped.repartition("block").sortWithinPartitions("block").mapInArrow(lambda it: _linked(it, dim, least), "a long, b long, sure boolean"), "links")
    unsure = links.where("not sure").select("a", "b").distinct()
    va, vb = vectors.toDF("a", "va").dropDuplicates(["a"]), vectors.toDF("b", "vb").dropDuplicates(["b"])
    told = unsure.join(va, "a").join(vb, "b").select("a", "b", "va", "vb").mapInArrow(lambda it: _close(it, dim, least), "a long, b long")
    copies = members.where("rep <> id").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    edges = stage(links.where("sure").select("a", "b").unionByName(told).unionByName(copies), "edges")
    drop(links)
    return components(edges), model, vectors, dim


def _density(batches, dim: int, model: Model):
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(log_sum(_parts(stack(batch, dim), model)))], ["id", "density"])


def described(df: DataFrame, id_col: str, col: str, text: str, typical: int = 3) -> DataFrame:
    """(cluster_first, size, rank, member, density, text): every cluster's most typical members; single vectors too."""
    joined, model, vectors, dim = clusters(df, id_col, col)
    if model is None:
        return df.sparkSession.createDataFrame([], "cluster_first long, size long, rank int, member long, density double, typical_text string")
    of = stage(joined, "clusters")
    dense = vectors.mapInArrow(lambda it: _density(it, dim, model), "id long, density double").dropDuplicates(["id"])
    each = dense.join(of, F.col("id") == F.col("node"), "left").select("id", "density", F.coalesce("root", "id").alias("cluster_first"))
    sizes = of.groupBy("root").agg(F.count("*").alias("size"))
    top = each.select("*", F.row_number().over(Window.partitionBy("cluster_first").orderBy(F.desc("density"), "id")).alias("rank")).where(F.col("rank") <= typical)
    texts = df.select(F.col(id_col).cast("long").alias("t_id"), F.col(text).alias("typical_text")).groupBy("t_id").agg(F.min("typical_text").alias("typical_text"))
    out = top.join(sizes, F.col("cluster_first") == F.col("root"), "left").join(texts, F.col("id") == F.col("t_id"), "left")
    return out.select("cluster_first", F.coalesce("size", F.lit(1)).alias("size"), "rank", F.col("id").alias("member"), "density", "typical_text")
