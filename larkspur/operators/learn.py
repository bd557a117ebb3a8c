"""Linear, kernel and probabilistic learners.

Rows stay in DataFrames; sums over them (Gram matrices, gradients) are
numpy kernels on Arrow batches; parameters are small arrays on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators.batches import map_vectors, packed, reduce_batches, sum_batches, sum_packed, to_numpy
from larkspur.operators.lineage import cut


@dataclass(frozen=True)
class Scaler:
    """(v - mean) / std by element."""

    mean: np.ndarray
    std: np.ndarray | None = None

    def of(self, x: np.ndarray) -> np.ndarray:
        return x - self.mean if self.std is None else (x - self.mean) / self.std

    def apply(self, v: Column) -> Column:
        return map_vectors(self.of, v)


def standard_scaler(df: DataFrame, v: Column, width: int, scale: bool = True, eps: float = 1e-12) -> Scaler:
    """Mean and sample deviation; a deviation that is not a number or below eps counts as 1."""
    s = sum_batches(df, [v], lambda x: np.stack([x.sum(0), (x * x).sum(0), np.full(width, len(x))]), (3, width))
    n = s[2, 0]
    mean = s[0] / max(n, 1)
    if not scale:
        return Scaler(mean)
    # A second pass about the mean, so that large means lose no digits.
    var = sum_batches(df, [v], lambda x: ((x - mean) ** 2).sum(0), (width,)) / max(n - 1, 1)
    std = np.sqrt(var)
    return Scaler(mean, np.where(np.isfinite(std) & (std >= eps), std, 1.0))


@dataclass(frozen=True)
class LinearMapper:
    """(x - mean) W + b."""

    weights: np.ndarray
    intercept: np.ndarray | None = None
    scaler: Scaler | None = None

    def of(self, x: np.ndarray) -> np.ndarray:
        y = (self.scaler.of(x) if self.scaler else x) @ self.weights
        return y if self.intercept is None else y + self.intercept

    def apply(self, v: Column) -> Column:
        return map_vectors(self.of, v)

    def apply_by_block(self, x: np.ndarray, block: int, see) -> np.ndarray:
        """Running sums after each block of features, shown to see()."""
        x = self.scaler.of(x) if self.scaler else x
        out = np.zeros((len(x), self.weights.shape[1])) + (0 if self.intercept is None else self.intercept)
        for i in range(0, x.shape[1], block):
            out = out + x[:, i : i + block] @ self.weights[i : i + block]
            see(out)
        return out


def sparse_linear(entries: DataFrame, weights: DataFrame, key: str = "row") -> DataFrame:
    """(row, k, y) of sparse rows (row, idx, value) times weights (idx, k, w): a join and a sum."""
    return entries.join(weights, "idx").groupBy(key, "k").agg(F.sum(F.col("value") * F.col("w")).alias("y"))


def gram(df: DataFrame, x: Column, y: Column, d: int, k: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, means of x and y, and the centred products xx and xy, in one pass."""

    def part(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        m = np.hstack([np.ones((len(a), 1)), a, b])
        return m[:, : d + 1].T @ m

    s = sum_batches(df, [x, y], part, (d + 1, d + k + 1))
    n = s[0, 0]
    mx, my = s[0, 1 : d + 1] / max(n, 1), s[0, d + 1 :] / max(n, 1)
    return n, mx, my, s[1:, 1 : d + 1] - n * np.outer(mx, mx), s[1:, d + 1 :] - n * np.outer(mx, my)


def _solve(a: np.ndarray, b: np.ndarray, ridge: float) -> np.ndarray:
    a = a + ridge * np.eye(len(a))
    try:
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(a, b, rcond=None)[0]


def least_squares(df: DataFrame, x: Column, y: Column, d: int, k: int, ridge: float = 0.0) -> LinearMapper:
    """Exact ridge regression by the normal equations; the penalty is not scaled by the rows."""
    _, mx, my, xx, xy = gram(df, x, y, d, k)
    return LinearMapper(_solve(xx, xy, ridge), my, Scaler(mx))


def local_least_squares(x: np.ndarray, y: np.ndarray, ridge: float) -> LinearMapper:
    """Ridge regression in the dual, for few rows of many features."""
    mx, my = x.mean(0), y.mean(0)
    a = x - mx
    return LinearMapper(a.T @ _solve(a @ a.T, y - my, ridge), my, Scaler(mx))


#: Bytes of a product of features that a task may hold.
GRAM_BYTES = 256 << 20


def means(df: DataFrame, x: Column, y: Column, d: int, k: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Rows, and means of x and y."""
    s = sum_batches(df, [x, y], lambda a, b: np.concatenate([a.sum(0), b.reshape(len(b), -1).sum(0), [len(a)]]), (d + k + 1,))
    return s[-1], s[:d] / max(s[-1], 1), s[d:-1] / max(s[-1], 1)


def block_least_squares(df: DataFrame, x: Column, y: Column, d: int, k: int, block: int, passes: int, ridge: float = 0.0, gram_bytes: int = GRAM_BYTES) -> LinearMapper:
    """Block coordinate descent: in turn each block of features is solved against what the others leave.

    While the product of all features fits into gram_bytes, the rows are read once for all passes. Beyond,
    they are read for each block: a task then holds the product of one block, and the residual follows from
    the row and the weights so far, so it is never stored. Products of blocks are kept on the driver for later passes.
    """
    w, n_blocks = np.zeros((d, k)), -(-d // block)
    if (d + 1) * (d + k + 1) * 8 <= gram_bytes:
        _, mx, my, xx, xy = gram(df, x, y, d, k)
        for _ in range(max(1, passes)):
            for i in range(0, d, block):
                b = slice(i, min(i + block, d))
                left = xy[b] - xx[b] @ w + xx[b, b] @ w[b]
                w[b] = _solve(xx[b, b], left, ridge)
        return LinearMapper(w, my, Scaler(mx))
    blocks = cut(packed(df, x, y))  # read once more for every block and pass
    s = sum_packed(blocks, lambda m: np.append(m.sum(0), len(m)), (d + k + 1,))
    mx, my = s[:d] / max(s[-1], 1), s[d:-1] / max(s[-1], 1)
    products: list[np.ndarray | None] = [None] * n_blocks
    for _ in range(max(1, passes)):
        for j in range(n_blocks):
            b = slice(j * block, min((j + 1) * block, d))
            first, width = products[j] is None, min((j + 1) * block, d) - j * block

            def part(m: np.ndarray, b: slice = b, w: np.ndarray = w, first: bool = first) -> np.ndarray:
                a = m[:, :d] - mx
                residual = m[:, d:] - my - a @ w
                return np.hstack([a[:, b].T @ a[:, b], a[:, b].T @ residual]) if first else a[:, b].T @ residual

            s = sum_packed(blocks, part, (width, width + k) if first else (width, k))
            if first:
                products[j], s = s[:, :width], s[:, width:]
            w = w.copy()
            w[b] = _solve(products[j], s + products[j] @ w[b], ridge)
    return LinearMapper(w, my, Scaler(mx))


def class_weighted_least_squares(
    df: DataFrame, x: Column, label: Column, d: int, classes: int, ridge: float, mix: float, block: int | None = None, passes: int = 1, gram_bytes: int = GRAM_BYTES
) -> LinearMapper:
    """A weighted ridge regression on +-1 for each class; a row weighs (1 - mix) / n, and mix / n_c more in the class.

    Weighted products of every class come from those of the classes, as many of which are gathered in a pass over the rows as
    fit into gram_bytes. With block, each regression is by block coordinate descent, which needs products of one
    block only; the residual follows from the row and the weights so far.
    """
    sums = sum_batches(df, [x, label], lambda a, c: np.stack([np.append(a[c == k].sum(0), (c == k).sum()) for k in range(classes)]), (classes, d + 1))
    count, n = sums[:, -1], max(sums[:, -1].sum(), 1)
    own = np.divide(mix, count, out=np.zeros(classes), where=count > 0)
    mass = (1 - mix) + own * count
    mean = ((1 - mix) / n * sums[:, :-1].sum(0) + own[:, None] * sums[:, :-1]) / mass[:, None]
    ym = ((1 - mix) / n * (2 * count - n) + own * count) / mass

    def products(cols: slice, width: int) -> np.ndarray:
        """Weighted centred products of the columns, a matrix for each class."""
        at_once = max(1, gram_bytes // (8 * width * width))
        each, total = [], None
        for lo in range(0, classes, at_once):
            these = range(lo, min(lo + at_once, classes))

            def part(a: np.ndarray, c: np.ndarray, these: range = these, whole: bool = total is None) -> np.ndarray:
                a = a[:, cols]
                return np.stack([a[c == k].T @ a[c == k] for k in these] + ([a.T @ a] if whole else []))

            s = sum_batches(df, [x, label], part, (len(these) + (total is None), width, width))
            if total is None:
                total, s = s[-1], s[:-1]
            each.append(s)
        g = np.concatenate(each) * own[:, None, None] + (1 - mix) / n * total
        return g - mass[:, None, None] * mean[:, cols, None] * mean[:, None, cols]

    def gradient(cols: slice, w: np.ndarray, width: int) -> np.ndarray:
        """Weighted products of the columns with the residuals of each class."""

        def part(a: np.ndarray, c: np.ndarray) -> np.ndarray:
            r = np.where(c[:, None] == np.arange(classes), 1.0, -1.0) - ym - (a @ w - (mean * w.T).sum(1))
            out = (1 - mix) / n * a[:, cols].T @ r
            for k in range(classes):
                out[:, k] += own[k] * a[c == k][:, cols].T @ r[c == k, k]
            return out

        return sum_batches(df, [x, label], part, (width, classes))

    w, size = np.zeros((d, classes)), block or d
    if classes * d * d * 8 <= gram_bytes:  # all products at once: the rows are read once for all passes
        xx, xy = products(slice(0, d), d), gradient(slice(0, d), w, d)
        for _ in range(max(1, passes) if block else 1):
            for i in range(0, d, size):
                b = slice(i, min(i + size, d))
                for c in range(classes):
                    w[b, c] = _solve(xx[c][b, b], xy[b, c] - xx[c][b] @ w[:, c] + xx[c][b, b] @ w[b, c], ridge)
        return LinearMapper(w, ym - (mean * w.T).sum(1))
    kept: list[np.ndarray] = []
    for turn in range(max(1, passes) if block else 1):
        for j, i in enumerate(range(0, d, size)):
            b = slice(i, min(i + size, d))
            width = b.stop - i
            if turn == 0:
                kept.append(products(b, width))
            s = gradient(b, w, width)
            w = w.copy()
            for c in range(classes):
                w[b, c] = _solve(kept[j][c], s[:, c] + kept[j][c] @ w[b, c], ridge)
    return LinearMapper(w, ym - (mean * w.T).sum(1))


def lbfgs(value_and_gradient, start: np.ndarray, corrections: int = 10, tolerance: float = 1e-4, rounds: int = 100) -> np.ndarray:
    """Limited-memory BFGS with backtracking on flat parameters."""
    x = start.copy()
    f, g = value_and_gradient(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        q, alphas = g.copy(), []
        for s, y, rho in reversed(past):
            a = rho * (s @ q)
            alphas.append(a)
            q -= a * y
        if past:
            s, y, _ = past[-1]
            q *= (s @ y) / (y @ y)
        for (s, y, rho), a in zip(past, reversed(alphas)):
            q += s * (a - rho * (y @ q))
        slope = -(g @ q)
        if slope >= 0:
            q, slope, past = g.copy(), -(g @ g), []
        step = 1.0 if past else 1.0 / max(1.0, np.abs(g).sum())
        while True:
            new = x - step * q
            fn, gn = value_and_gradient(new)
            if fn <= f + 1e-4 * step * slope or step < 1e-12:
                break
            step /= 2
        s, y = new - x, gn - g
        done = abs(f - fn) <= tolerance * max(abs(f), abs(fn), 1e-12) or np.linalg.norm(gn) < 1e-10
        if s @ y > 1e-12:
            past = [*past[-(corrections - 1) :], (s, y, 1 / (s @ y))]
        x, f, g = new, fn, gn
        if done:
            break
    return x


def lbfgs_least_squares(df: DataFrame, x: Column, y: Column, d: int, k: int, ridge: float = 0.0, rounds: int = 100, tolerance: float = 1e-4, intercept: bool = True) -> LinearMapper:
    """Least squares by L-BFGS: half the mean squared error plus ridge / 2 |W|^2; one job for each evaluation, no products of features."""
    n, mx, my = means(df, x, y, d, k) if intercept else (df.count(), np.zeros(d), np.zeros(k))

    def of(flat: np.ndarray) -> tuple[float, np.ndarray]:
        w = flat.reshape(d, k)

        def part(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            a = a - mx
            r = a @ w - (b - my)
            return np.concatenate([(a.T @ r).ravel(), [0.5 * (r * r).sum()]])

        s = sum_batches(df, [x, y], part, (d * k + 1,)) / max(n, 1)
        return s[-1] + 0.5 * ridge * (flat @ flat), s[:-1] + ridge * flat

    return LinearMapper(lbfgs(of, np.zeros(d * k), tolerance=tolerance, rounds=rounds).reshape(d, k), my if intercept else None, Scaler(mx) if intercept else None)


def sparse_lbfgs_least_squares(entries: DataFrame, targets: DataFrame, d: int, ridge: float = 0.0, rounds: int = 50, tolerance: float = 1e-4) -> tuple[np.ndarray, float]:
    """(weights, intercept) from (row, idx, value) and (row, y): a row's entries are gathered once; the intercept is not penalised."""
    rows = entries.groupBy("row").agg(F.collect_list(F.struct("idx", "value")).alias("e")).join(targets, "row", "right").select(
        F.coalesce(F.col("e.idx"), F.array().cast("array<int>")).alias("i"), F.coalesce(F.col("e.value"), F.array().cast("array<double>")).alias("v"), F.col("y").cast("double").alias("y")
    )
    return sparse_lbfgs_of_rows(rows, d, ridge, rounds, tolerance)


def sparse_lbfgs_of_rows(rows: DataFrame, d: int, ridge: float = 0.0, rounds: int = 50, tolerance: float = 1e-4) -> tuple[np.ndarray, float]:
    """sparse_lbfgs_least_squares() of rows (i, v, y): arrays of indices and values, and the target."""
    rows = rows.select("i", "v", "y").persist()
    n = max(rows.count(), 1)

    def of(flat: np.ndarray) -> tuple[float, np.ndarray]:
        def add(s: np.ndarray, i: np.ndarray, v: np.ndarray, many: np.ndarray, y: np.ndarray) -> np.ndarray:
            i, v = np.concatenate(i).astype(np.int64), np.concatenate(v)
            row = np.repeat(np.arange(len(y)), many)
            r = np.bincount(row, weights=v * flat[i], minlength=len(y)) + flat[d] - y
            return s + np.concatenate([np.bincount(i, weights=v * r[row], minlength=d), [r.sum(), 0.5 * (r * r).sum()]])

        s = reduce_batches(rows, [F.col("i"), F.col("v"), F.size("i").alias("m"), F.col("y")], add, np.add, np.zeros(d + 2)) / n
        w = np.append(flat[:d], 0.0)
        return s[-1] + 0.5 * ridge * (w @ w), s[:-1] + ridge * w

    out = lbfgs(of, np.zeros(d + 1), tolerance=tolerance, rounds=rounds)
    rows.unpersist()
    return out[:d], float(out[d])


CPU, MEMORY, NETWORK = 3.8e-4, 2.9e-1, 1.32


def solver_costs(n: int, d: int, k: int, sparsity: float, machines: int, cpu: float = CPU, memory: float = MEMORY, network: float = NETWORK) -> dict[str, float]:
    """Estimated cost of each least-squares solver."""
    m, tree = machines, log2(max(machines, 2))
    one = lambda flops, size, sent, times=1, heavy=1: times * (heavy * max(cpu * flops, memory * size) + network * sent)
    b = 1000
    return {
        "dense_lbfgs": one(n * d * k / m, n * d / m, 2 * d * k * tree, 20),
        "sparse_lbfgs": one(n * sparsity * d * k / m, n * d * sparsity / m, 2 * d * k * tree, 20, 8),
        "block": one(n * d * (b + k) / m, n * d / m + d * k, 2 * d * (b + k) * tree, 3),
        "exact": one(n * d * (d + k) / m, n * d / m + d * d, d * (d + k)),
    }


def choose_solver(n: int, d: int, k: int, sparsity: float, machines: int, **weights: float) -> str:
    costs = solver_costs(n, d, k, sparsity, machines, **weights)
    return min(costs, key=costs.__getitem__)


def gaussian_kernel(x: np.ndarray, z: np.ndarray, gamma: float) -> np.ndarray:
    k = x @ z.T
    k *= 2
    k -= (x * x).sum(1)[:, None]
    k -= (z * z).sum(1)
    np.minimum(k, 0, out=k)
    k *= gamma
    return np.exp(k, out=k)


#: Rows on either side of a piece of a kernel matrix.
KERNEL_ROWS = 512, 1024


def kernel_product(x: np.ndarray, z: np.ndarray, w: np.ndarray, gamma: float) -> np.ndarray:
    """The kernels of x with z, times w; only a piece of them is held at a time, and rows without weight are left out."""
    some = (w != 0).any(1)
    if not some.all():
        z, w = z[some], w[some]
    out = np.zeros((len(x), w.shape[1]))
    for i in range(0, len(x), KERNEL_ROWS[0]):
        for j in range(0, len(z), KERNEL_ROWS[1]):
            out[i : i + KERNEL_ROWS[0]] += gaussian_kernel(x[i : i + KERNEL_ROWS[0]], z[j : j + KERNEL_ROWS[1]], gamma) @ w[j : j + KERNEL_ROWS[1]]
    return out


#: Training rows that a task holds at a time to score others.
MODEL_ROWS = 1 << 16


@dataclass(frozen=True)
class KernelModel:
    """Training rows (block, x, w) with their weights; a row's scores are its kernel with all of them times the weights, some blocks at a time."""

    rows: DataFrame
    blocks: int
    width: int
    classes: int
    gamma: float
    at_once: int = 1

    def scores(self, df: DataFrame, v: Column, name: str = "scores") -> DataFrame:
        """df with a column of scores. at_once blocks of training rows are in a task at a time; after them the plan is cut."""
        out = df.withColumn(name, F.array_repeat(F.lit(0.0), self.classes))
        for b in range(0, self.blocks, self.at_once):
            if b:
                out = cut(out)
            x, w = _rows_of(self.rows.where(F.col("block").between(b, b + self.at_once - 1)), "x", "w")
            if len(x):
                out = out.withColumn(name, map_vectors(lambda a, s, x=x, w=w, g=self.gamma: s + kernel_product(a, x, w, g), v, F.col(name)))
        return out


def _rows_of(df: DataFrame, *columns: str) -> tuple[np.ndarray, ...]:
    """Vectors of a block's rows, in the order of their numbers."""
    t = df.orderBy("id").select(*columns).toArrow()
    return tuple(to_numpy(t.column(c).combine_chunks()) for c in columns)


#: Bytes of new weights that travel with a plan.
WEIGHT_BYTES = 16 << 20


def kernel_ridge(df: DataFrame, x: Column, y: Column, d: int, k: int, gamma: float, ridge: float, block: int, epochs: int, seed: int | None = None, every: int = 32) -> KernelModel:
    """(K + ridge I) W = Y over all rows of df by block Gauss-Seidel, a row's weights being a column beside it.

    For every blocks at a time their rows (block of them at most in each) reach the driver and every task, where their kernels with the
    rows of other blocks are made, multiplied by the weights and summed, and never kept; those among themselves follow
    on the driver, block after block. So there is one pass over the rows for every blocks, with the weights that a pass for each block
    would find. New weights travel with the plan; when they come to WEIGHT_BYTES they are written beside the rows.
    """
    flat = cut(df.select(x.alias("x"), y.alias("y"), F.array_repeat(F.lit(0.0), k).alias("w")).withColumn("id", F.monotonically_increasing_id()))
    per_part = flat.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.min("id").alias("low")).orderBy("p").collect()
    n, starts = 0, []
    for r in per_part:  # a row for each partition
        starts.append((r.low, n))
        n += r.n
    blocks = max(1, -(-n // block))
    lows, offsets = np.array([a for a, _ in starts] or [0]), np.array([b for _, b in starts] or [0])

    @F.arrow_udf("long")
    def number(ids: pa.Array) -> pa.Array:
        ids = ids.to_numpy()
        at = np.searchsorted(lows, ids, side="right") - 1
        return pa.array(offsets[at] + ids - lows[at])

    # Rows of a block come from all over the table.
    rows = cut(flat.withColumn("id", number("id")).withColumn("block", F.pmod("id", F.lit(blocks)).cast("int")).withColumn("pos", F.floor(F.col("id") / blocks)))
    recent: dict[int, np.ndarray] = {}
    rng = np.random.default_rng(seed)

    def packed(new: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Weights of several blocks one after another, and where those of each block begin (-1: not there)."""
        begin, size = np.full(blocks, -1), 0
        for j, v in new.items():
            begin[j], size = size, size + len(v)
        return begin, np.concatenate([*new.values(), np.zeros((0, k))])

    def current(b: np.ndarray, pos: np.ndarray, w: np.ndarray, begin: np.ndarray, new: np.ndarray) -> np.ndarray:
        at = begin[b]
        return np.where((at >= 0)[:, None], new[(at + pos) * (at >= 0)], w) if len(new) else w

    def written() -> DataFrame:
        begin, new = packed(recent)
        return cut(rows.withColumn("w", map_vectors(lambda b, pos, w: current(b, pos, w, begin, new), F.col("block"), F.col("pos"), F.col("w")))) if recent else rows

    for _ in range(epochs):
        order = list(range(blocks)) if seed is None else rng.permutation(blocks).tolist()
        for lo in range(0, blocks, every):
            turn = order[lo : lo + every]
            a, t, w, of = _rows_of(rows.where(F.col("block").isin(turn)), "x", "y", "w", "block")
            if not len(a):
                continue
            where = {b: np.flatnonzero(of == b) for b in turn}
            w = w.copy()
            for b in turn:
                if b in recent:
                    w[where[b]] = recent[b]
            begin, new = packed(recent)
            mine = np.isin(np.arange(blocks), turn)

            def part(c: np.ndarray, j: np.ndarray, pos: np.ndarray, v: np.ndarray, a: np.ndarray = a, begin: np.ndarray = begin, new: np.ndarray = new, mine: np.ndarray = mine) -> np.ndarray:
                other = ~mine[j]
                return kernel_product(a, c[other], current(j[other], pos[other], v[other], begin, new), gamma)

            product = sum_batches(rows, [F.col("x"), F.col("block"), F.col("pos"), F.col("w")], part, (len(a), k))
            for b in turn:
                at = where[b]
                if len(at):
                    own = gaussian_kernel(a[at], a[at], gamma)
                    rest = kernel_product(a[at], a, w, gamma)
                    w[at] = _solve(own, t[at] - product[at] - rest + own @ w[at], ridge)
                    recent[b] = w[at]
            if sum(v.nbytes for v in recent.values()) > WEIGHT_BYTES:
                rows = written()
                recent.clear()
    return KernelModel(written().select("id", "block", "x", "w"), blocks, d, k, gamma, max(1, MODEL_ROWS // block))


def logistic_regression(df: DataFrame, features: str, label: str, ridge: float = 0.0, rounds: int = 100, tolerance: float = 1e-4):
    """Multinomial logistic regression without intercept or scaling, by pyspark.ml."""
    from pyspark.ml.classification import LogisticRegression

    return LogisticRegression(featuresCol=features, labelCol=label, regParam=ridge, maxIter=rounds, tol=tolerance, fitIntercept=False, standardization=False, family="multinomial").fit(df)


def naive_bayes_fit(entries: DataFrame, labels: DataFrame, smoothing: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Multinomial naive Bayes from (row, term, value) and (row, class): (class, pi) and (class, term, theta).

    Terms that a class lacks have the theta of a zero count, given by the row of a null term.
    """
    classes = labels.groupBy("class").agg(F.count("*").alias("n"))
    total = classes.agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    pi = classes.crossJoin(total).select("class", (F.log(F.col("n") + smoothing) - F.log(F.col("total") + F.col("k") * smoothing)).alias("pi"))
    sums = entries.join(labels, "row").groupBy("class", "term").agg(F.sum("value").alias("s"))
    terms = entries.select("term").distinct().agg(F.count("*").alias("v"))
    norm = sums.groupBy("class").agg(F.sum("s").alias("all")).crossJoin(terms).select("class", F.log(F.col("all") + F.col("v") * smoothing).alias("norm"))
    theta = sums.join(norm, "class").select("class", "term", (F.log(F.col("s") + smoothing) - F.col("norm")).alias("theta"))
    rest = norm.select("class", F.lit(None).cast("string").alias("term"), (F.log(F.lit(float(smoothing))) - F.col("norm")).alias("theta"))
    return pi, theta.unionByName(rest)


def naive_bayes_scores(entries: DataFrame, rows: DataFrame, pi: DataFrame, theta: DataFrame) -> DataFrame:
    """(row, class, score): pi + theta x for every row of rows; unknown terms count for nothing.

    A term that a class lacks adds that class's base; so the sum is base times all known
    values, plus what the class's own terms have over the base. Classes are few
    (one row each), terms are joined.
    """
    base = theta.where("term IS NULL").select("class", F.col("theta").alias("base"))
    own = theta.where("term IS NOT NULL").join(base, "class").select("class", "term", (F.col("theta") - F.col("base")).alias("over"))
    known = entries.join(own.select("term").distinct(), "term", "left_semi")
    mass = known.groupBy("row").agg(F.sum("value").alias("mass"))
    over = known.join(own, "term").groupBy("row", "class").agg(F.sum(F.col("value") * F.col("over")).alias("over"))
    return (
        rows.select("row").crossJoin(pi.join(base, "class")).join(mass, "row", "left").join(over, ["row", "class"], "left")
        .select("row", "class", (F.col("pi") + F.coalesce("mass", F.lit(0.0)) * F.col("base") + F.coalesce("over", F.lit(0.0))).alias("score"))
    )
