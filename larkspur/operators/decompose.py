"""Dimensionality reduction, clustering, densities and encodings."""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators.batches import map_vectors, reduce_batches, sum_batches, to_lists, to_numpy
from larkspur.operators.learn import CPU, MEMORY, NETWORK, LinearMapper


def sign_convention(m: np.ndarray) -> np.ndarray:
    """Each column's entry of largest magnitude made positive."""
    at = np.abs(m).argmax(0)
    return m * np.where(m[at, np.arange(m.shape[1])] < 0, -1, 1)


def pca_local(x: np.ndarray, dims: int) -> np.ndarray:
    return sign_convention(np.linalg.svd(x - x.mean(0), full_matrices=False)[2].T[:, :dims])


def pca(df: DataFrame, v: Column, d: int, dims: int) -> np.ndarray:
    """Leading directions (d x dims) from the covariance, summed in one pass."""
    cov, _ = covariance(df, v, d)
    values, vectors = np.linalg.eigh(cov)
    return sign_convention(vectors[:, np.argsort(-values)[:dims]])


def covariance(df: DataFrame, v: Column, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Sample covariance and mean; products are taken about the mean, in a second pass."""
    s = sum_batches(df, [v], lambda x: np.append(x.sum(0), len(x)), (d + 1,))
    mean = s[:-1] / max(s[-1], 1)
    return sum_batches(df, [v], lambda x: (x - mean).T @ (x - mean), (d, d)) / max(s[-1] - 1, 1), mean


def pca_tall_skinny(df: DataFrame, v: Column, d: int, dims: int) -> np.ndarray:
    """Leading directions by a tree of QR factorisations of the centred rows: of each batch, then of pairs of triangles."""
    s = sum_batches(df, [v], lambda x: np.append(x.sum(0), len(x)), (d + 1,))
    mean = s[:-1] / max(s[-1], 1)
    r = reduce_batches(
        df, [v], lambda r, x: np.linalg.qr(np.vstack([r, x - mean]), mode="r"), lambda a, b: np.linalg.qr(np.vstack([a, b]), mode="r"), np.zeros((0, d))
    )
    return sign_convention(np.linalg.svd(r)[2].T[:, :dims])


def pca_approximate(x: np.ndarray, dims: int, rounds: int = 10, extra: int = 5, seed: int = 0) -> np.ndarray:
    """Randomised range finder with power iterations; rows are not centred."""
    q = np.linalg.qr(x @ np.random.default_rng(seed).normal(size=(x.shape[1], min(dims + extra, x.shape[1]))))[0]
    for _ in range(rounds):
        q = np.linalg.qr(x @ np.linalg.qr(x.T @ q)[0])[0]
    return sign_convention(np.linalg.svd(q.T @ x, full_matrices=False)[2].T[:, :dims])


def choose_pca(n: int, d: int, machines: int, cpu: float = CPU, memory: float = MEMORY, network: float = NETWORK) -> str:
    """Cheaper of gathering the rows and of the distributed factorisation."""
    local = max(cpu * n * d * d, memory * n * d) + network * n * d
    tree = log2(max(machines, 2))
    spread = max(cpu * (n * d * d / machines + d**3 * tree), memory * n * d) + network * d * d * tree
    return "local" if local < spread else "distributed"


def project(v: Column, directions: np.ndarray) -> Column:
    """Directions' transpose times the vector; nothing is subtracted."""
    return LinearMapper(directions).apply(v)


@dataclass(frozen=True)
class Whitener:
    matrix: np.ndarray
    mean: np.ndarray

    def of(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.matrix


def zca(x: np.ndarray, eps: float = 0.1) -> Whitener:
    mean = x.mean(0)
    _, s, vt = np.linalg.svd(x - mean, full_matrices=False)
    return Whitener(vt.T @ np.diag((s * s / max(len(x) - 1, 1) + eps) ** -0.5) @ vt, mean)


def zca_of(df: DataFrame, v: Column, d: int, eps: float = 0.1) -> Whitener:
    """The whitener of all rows, from their covariance."""
    cov, mean = covariance(df, v, d)
    values, vectors = np.linalg.eigh(cov)
    return Whitener(vectors @ np.diag((np.maximum(values, 0) + eps) ** -0.5) @ vectors.T, mean)


def pca_approximate_of(df: DataFrame, v: Column, d: int, dims: int, rounds: int = 10, extra: int = 5, seed: int = 0) -> np.ndarray:
    """pca_approximate over all rows: each power iteration is a pass that sums x (x' q), d x (dims + extra)."""
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, min(dims + extra, d))))[0]
    for _ in range(rounds + 1):
        q = np.linalg.qr(sum_batches(df, [v], lambda x, q=q: x.T @ (x @ q), q.shape))[0]
    values, vectors = np.linalg.eigh(sum_batches(df, [v], lambda x: (x @ q).T @ (x @ q), (q.shape[1], q.shape[1])))
    return sign_convention(q @ vectors[:, np.argsort(-values)[:dims]])


def columns_of(df: DataFrame, matrix: Column) -> DataFrame:
    """Matrices (arrays of their columns) as rows of vectors v."""
    return df.select(F.explode(matrix).alias("v"))


def project_columns(matrix: Column, directions: np.ndarray) -> Column:
    """Every column of each matrix projected: a batch of matrices is one product."""
    return map_columns(lambda x: x @ directions, matrix)


def map_columns(fn, matrix: Column) -> Column:
    """fn of the columns of all matrices of a batch, as rows; the matrices are put together again."""

    @F.arrow_udf("array<array<double>>")
    def run(col: pa.Array) -> pa.Array:
        inner = col.flatten()
        rows = to_lists(fn(to_numpy(inner))) if len(inner) else pa.array([], pa.list_(pa.float64()))
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.diff(col.offsets.to_numpy()))), pa.int32()), rows)

    return run(matrix)


def column_sample(matrix: Column, n: int, seed: int = 0) -> Column:
    """n columns of each matrix, drawn with replacement by the matrix's content."""
    size = F.size(matrix)
    draw = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.get(matrix, F.pmod(F.xxhash64(F.to_json(F.array(F.get(matrix, F.lit(0)))), size, k, F.lit(seed)), F.greatest(size, F.lit(1))).cast("int")))
    return F.when(size > 0, draw).otherwise(matrix)


def column_pca(df: DataFrame, matrix: Column, d: int, dims: int, how: str | None = None, machines: int = 16) -> np.ndarray:
    """Directions of the columns of all matrices; how: local (for few columns), distributed, or by cost."""
    v = columns_of(df, matrix)
    how = how or choose_pca(v.count(), d, machines)
    if how == "distributed":
        return pca_tall_skinny(v, F.col("v"), d, dims)
    return pca_local(to_numpy(v.toArrow().column("v").combine_chunks()), dims)


def discriminants(df: DataFrame, v: Column, label: Column, d: int, classes: int, dims: int) -> LinearMapper:
    """Linear discriminant analysis: leading eigenvectors of within^-1 between, from sums by class."""

    def part(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        m = np.hstack([np.ones((len(x), 1)), x])
        return np.stack([m[c == k].T @ m[c == k] for k in range(classes)])

    s = sum_batches(df, [v, label], part, (classes, d + 1, d + 1))
    n, total = s[:, 0, 0], s.sum(0)
    mean = total[0, 1:] / total[0, 0]
    within, between = np.zeros((d, d)), np.zeros((d, d))
    for k in np.flatnonzero(n):
        m = s[k, 0, 1:] / n[k]
        within += s[k, 1:, 1:] - n[k] * np.outer(m, m)
        between += n[k] * np.outer(m - mean, m - mean)
    values, vectors = np.linalg.eig(np.linalg.pinv(within) @ between)
    return LinearMapper(np.real(vectors[:, np.argsort(-np.abs(values))[:dims]]))


def kmeans_local(x: np.ndarray, k: int, rounds: int, tolerance: float = 1e-3, seed: int = 0) -> np.ndarray:
    """k-means++ seeds and Lloyd's iterations."""
    rng = np.random.default_rng(seed)
    centers = x[[rng.integers(len(x))]]
    while len(centers) < k:
        far = ((x[:, None] - centers) ** 2).sum(2).min(1)
        p = far / far.sum() if far.sum() > 0 else np.full(len(x), 1 / len(x))
        centers = np.vstack([centers, x[rng.choice(len(x), p=p)]])
    cost = None
    for _ in range(rounds):
        dist = ((x[:, None] - centers) ** 2).sum(2)
        near, new = dist.argmin(1), dist.min(1).sum()
        centers = np.stack([x[near == j].mean(0) if (near == j).any() else centers[j] for j in range(k)])
        if cost is not None and cost - new < tolerance * abs(cost):
            break
        cost = new
    return centers


def kmeans_seeds(df: DataFrame, v: Column, d: int, k: int, seed: int = 0) -> np.ndarray:
    """k-means++ seeds over all rows: each is a row drawn in proportion to the squared distance to those before, in one pass.

    The draw is a race: of the times -log(u) / distance, u being a number made from the row's, the least wins.
    """
    rows = df.select(v.alias("v"), F.xxhash64(v, F.monotonically_increasing_id(), F.lit(seed)).alias("h"))
    centers = np.zeros((0, d))
    for turn in range(k):

        def race(best: np.ndarray, x: np.ndarray, h: np.ndarray, c: np.ndarray = centers, turn: int = turn) -> np.ndarray:
            z = h.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (turn + 1) % (1 << 64))
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            u = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2**53
            far = np.maximum(((x[:, None] - c) ** 2).sum(2).min(1), 1e-300) if len(c) else np.ones(len(x))
            time = -np.log(np.maximum(u, 1e-300)) / far
            at = time.argmin()
            return best if best[0] <= time[at] else np.append(time[at], x[at])

        best = reduce_batches(rows, [F.col("v"), F.col("h")], race, lambda a, b: a if a[0] <= b[0] else b, np.append(np.inf, np.zeros(d)))
        centers = np.vstack([centers, best[1:]])
    return centers


def kmeans(df: DataFrame, v: Column, d: int, start: np.ndarray, rounds: int, tolerance: float = 1e-3) -> np.ndarray:
    """Lloyd's iterations over all rows, one pass each, from given centers."""
    centers, cost, k = start.copy(), None, len(start)
    for _ in range(rounds):

        def part(x: np.ndarray, c: np.ndarray = centers) -> np.ndarray:
            dist = (x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T
            near = dist.argmin(1)
            out = np.zeros((k, d + 2))
            np.add.at(out, near, np.hstack([x, np.ones((len(x), 1)), dist.min(1)[:, None]]))
            return out

        s = sum_batches(df, [v], part, (k, d + 2))
        centers = np.where(s[:, d : d + 1] > 0, s[:, :d] / np.maximum(s[:, d : d + 1], 1), centers)
        if cost is not None and cost - s[:, -1].sum() < tolerance * abs(cost):
            break
        cost = s[:, -1].sum()
    return centers


@dataclass(frozen=True)
class Mixture:
    """Diagonal Gaussian mixture: means, variances (k x d) and weights."""

    means: np.ndarray
    variances: np.ndarray
    weights: np.ndarray
    least: float = 1e-4

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        """Those below least are dropped and the rest made to sum to one."""
        log = -0.5 * (((x[:, None] - self.means) ** 2 / self.variances).sum(2) + np.log(self.variances).sum(1) + x.shape[1] * np.log(2 * np.pi)) + np.log(self.weights)
        p = np.exp(log - log.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p = np.where(p < self.least, 0, p)
        return p / p.sum(1, keepdims=True)

    def apply(self, v: Column) -> Column:
        return map_vectors(self.posteriors, v)

    def fisher(self, x: np.ndarray) -> np.ndarray:
        """d x 2k gradients by means and variances of n descriptors (n x d)."""
        n, q = max(len(x), 1), self.posteriors(x)
        s0, s1, s2 = q.mean(0), q.T @ x / n, q.T @ (x * x) / n
        by_mean = (s1 - self.means * s0[:, None]) / (np.sqrt(self.variances) * np.sqrt(self.weights)[:, None])
        by_var = (s2 - 2 * self.means * s1 + (self.means**2 - self.variances) * s0[:, None]) / (self.variances * np.sqrt(2 * self.weights)[:, None])
        return np.hstack([by_mean.T, by_var.T])


def gaussian_mixture(df: DataFrame, v: Column, d: int, start: np.ndarray, rounds: int = 100, least_mass: float = 40, tolerance: float = 1e-4, small: float = 1e-2, floor: float = 1e-9) -> Mixture:
    """Expectation maximisation from given means, a pass over the rows each round; a round that leaves a cluster too little mass is undone."""
    k = len(start)
    cov, _ = covariance(df, v, d)
    bound = np.maximum(small * np.diag(cov), floor)
    model, last = Mixture(start.copy(), np.tile(np.maximum(np.diag(cov), bound), (k, 1)), np.full(k, 1 / k)), None
    for _ in range(rounds):

        def part(x: np.ndarray, m: Mixture = model) -> np.ndarray:
            log = -0.5 * (((x[:, None] - m.means) ** 2 / m.variances).sum(2) + np.log(m.variances).sum(1) + d * np.log(2 * np.pi)) + np.log(m.weights)
            top = log.max(1)
            q = m.posteriors(x)
            out = np.zeros((k, 2 * d + 2))
            out[:, :d], out[:, d : 2 * d], out[:, -2] = q.T @ x, q.T @ (x * x), q.sum(0)
            out[0, -1] = (top + np.log(np.exp(log - top[:, None]).sum(1))).sum()
            return out

        s = sum_batches(df, [v], part, (k, 2 * d + 2))
        mass, likelihood = s[:, -2], s[0, -1] / max(s[:, -2].sum(), 1)
        if (mass < least_mass).any():
            break
        means = s[:, :d] / mass[:, None]
        model = Mixture(means, np.maximum(s[:, d : 2 * d] / mass[:, None] - means**2, bound), mass / mass.sum())
        if last is not None and abs(likelihood - last) < tolerance * abs(last):
            break
        last = likelihood
    return model


def mixture_of(df: DataFrame, v: Column, d: int, k: int, init: str = "kmeans", seed: int = 0, **em) -> Mixture:
    """Expectation maximisation from k-means++ centers (one of Lloyd's rounds) or from random rows."""
    if init == "kmeans":
        start = kmeans(df, v, d, kmeans_seeds(df, v, d, k, seed), 1)
    else:
        t = df.select(v.alias("v")).orderBy(F.xxhash64("v", F.lit(seed)), "v").limit(k).toArrow()
        start = to_numpy(t.column("v").combine_chunks())
    return gaussian_mixture(df, v, d, start, **em)


def fisher_vectors(matrix: Column, mixture: Mixture) -> Column:
    """Fisher vector of each matrix (an array of descriptors): the d x 2k gradients, column by column."""

    @F.arrow_udf("array<double>")
    def run(col: pa.Array) -> pa.Array:
        return pa.array([mixture.fisher(to_numpy(m.values)).T.ravel().tolist() if m.is_valid and len(m.values) else [0.0] * (2 * mixture.means.size) for m in col], pa.list_(pa.float64()))

    return run(matrix)


def fisher_encoder(df: DataFrame, matrix: Column, d: int, k: int, seed: int = 0, **em) -> Mixture:
    """The mixture of the columns of all matrices, whose fisher_vectors encode them."""
    return mixture_of(columns_of(df, matrix), F.col("v"), d, k, seed=seed, **em)
