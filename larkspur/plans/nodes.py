"""Steps and estimators for pipelines, made of the library's functions and operators.

A step is named and has plain arguments, so equal steps are equal, and fitted pipelines can be kept in files.
Rows carry a key, labels and features side by side; a step reads the column source and writes target.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import text, vectors
from larkspur.operators import decompose, images, learn, sparse, terms
from larkspur.operators.batches import map_vectors
from larkspur.operators.lineage import cut
from larkspur.plans import pipeline as P


class Array:
    """A numpy array that is equal to those of the same values."""

    def __init__(self, values):
        self.values = np.asarray(values)
        self._key = (self.values.shape, self.values.tobytes())

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Array) and self._key == other._key

    def __hash__(self) -> int:
        return hash(self._key)


def padded_fft(m: np.ndarray) -> np.ndarray:
    """Real part of the first half of the transform, padded to a power of two."""
    size = 1 << max(m.shape[1] - 1, 0).bit_length()
    return np.fft.fft(m, size, axis=1)[:, : max(size // 2, 1)].real


def cosine_features(d: int, n: int, gamma: float, seed: int, distribution: str = "gaussian") -> tuple[Array, Array]:
    """Weights (d x n) and offsets of n random cosine features; gaussian ones approximate the RBF kernel, cauchy ones the Laplacian."""
    rng = np.random.default_rng(seed)
    w = rng.normal(size=(d, n)) if distribution == "gaussian" else rng.standard_cauchy((d, n))
    return Array(gamma * w), Array(rng.uniform(0, 2 * np.pi, n))


#: Functions of arrays of images; those that end a row of steps give descriptors or vectors.
IMAGE_STEPS: dict[str, Callable[..., np.ndarray]] = {
    "pixel_scale": images.scaled_pixels, "gray": images.gray, "rectify": images.rectified, "crop": images.crop, "pool": images.pool,
    "convolve": lambda m, f, size, white, mean, normalize: images.convolve(m, f.values, size, decompose.Whitener(white.values, mean.values), normalize),
    "convolve_plain": lambda m, f, size, normalize: images.convolve(m, f.values, size, None, normalize),
    "sift": images.dense_sift, "lcs": images.local_color_statistics, "hog": images.hog, "daisy": images.daisy, "image_vector": lambda m: m,
}
ENDS = {"sift": images.descriptors, "lcs": images.descriptors, "hog": images.descriptors, "daisy": images.descriptors, "image_vector": images.vector_of}


def _composed(parts: tuple[tuple, ...]) -> Callable[[np.ndarray], np.ndarray]:
    def run(m: np.ndarray) -> np.ndarray:
        for name, *args in parts:
            m = IMAGE_STEPS[name](m, *args)
        return m

    return run


def _image_steps(c: Column, *parts: tuple) -> Column:
    """Steps of IMAGE_STEPS one after another in one Python function."""
    return ENDS.get(parts[-1][0], images.map_images)(c, _composed(parts))


STEPS: dict[str, Callable[..., Column]] = {
    "trim": text.trim, "lower": text.lower, "tokenize": text.tokenize, "ngrams": text.ngrams,
    "random_sign": lambda c, signs: vectors.multiply(c, vectors.array_of(signs.values.tolist())),
    "fft": lambda c: map_vectors(padded_fft, c), "rectify_vector": vectors.linear_rectifier,
    "cosine": lambda c, w, b: map_vectors(lambda m: np.cos(m @ w.values + b.values), c),
    "normalize": vectors.normalize, "signed_hellinger": vectors.signed_hellinger, "argmax": vectors.argmax, "top_k": vectors.top_k,
    "double": vectors.to_double, "indicators": vectors.indicators, "multi_indicators": vectors.multi_indicators,
    "flatten": vectors.vectorize_matrix, "image_steps": _image_steps,
    "column_sample": decompose.column_sample, "project_columns": lambda c, m: decompose.project_columns(c, m.values),
    "hellinger_columns": lambda c: decompose.map_columns(lambda x: np.sign(x) * np.sqrt(np.abs(x)), c),
}
STEPS |= {name: (lambda c, *args, name=name: _image_steps(c, (name, *args))) for name in IMAGE_STEPS if name != "image_vector"} | {"image_vector": images.vectorize}


def computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once for each row: later expressions see its values, so that they neither repeat it nor get a Python function into a lambda."""
    return df.select(*[F.col(c) for c in df.columns if c != name], F.explode_outer(F.array(value)).alias(name))


@dataclass(frozen=True)
class Step(P.Transformer):
    """One of STEPS on a column."""

    name: str
    args: tuple = ()
    source: str = "x"
    target: str = "x"

    def transform(self, df: DataFrame) -> DataFrame:
        parts = self.args if self.name == "image_steps" else ((self.name, *self.args),)
        if ENDS.get(parts[-1][0]) is images.descriptors:
            return images.with_descriptors(df, self.source, self.target, _composed(parts))
        return computed(df, self.target, STEPS[self.name](F.col(self.source), *self.args))


def steps(*names: str | tuple, source: str = "x", target: str = "x") -> P.Pipeline:
    """Steps one after another: names, or (name, argument ...). Steps of images that follow each other are one, so that pixels go to Python once."""
    parts: list[tuple] = []
    for n in [(n,) if isinstance(n, str) else tuple(n) for n in names]:
        if n[0] in IMAGE_STEPS and parts and parts[-1][0] == "image_steps" and parts[-1][-1][0] not in ENDS:
            parts[-1] += (n,)
        else:
            parts.append(("image_steps", n) if n[0] in IMAGE_STEPS and n[0] != "image_vector" else n)
    out = None
    for n, *args in parts:
        s = Step(n, tuple(args), source if out is None else target, target)
        out = s.pipeline() if out is None else out.and_then(s)
    return out


@dataclass(frozen=True)
class Combine(P.Transformer):
    """Vectors of several columns one after another."""

    sources: tuple[str, ...]
    target: str = "x"

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.target, vectors.combine(*[F.col(c) for c in self.sources]))


@dataclass(frozen=True)
class Explode(P.Transformer):
    """A row for each of an image's windows, patches or copies."""

    kind: str
    args: tuple = ()
    source: str = "x"

    def transform(self, df: DataFrame) -> DataFrame:
        cut = {"windows": images.windows, "center_corner": images.center_corner_patches}
        if self.kind == "random":
            n, px, py, seed = self.args
            return df.withColumn(self.source, F.explode_outer(images.random_patches_of(F.col(self.source), n, px, py, F.xxhash64(F.col(self.source)["data"], F.lit(seed)))))
        fn, args = cut[self.kind], self.args
        return df.withColumn(self.source, F.explode_outer(images.map_images(F.col(self.source), lambda m: fn(m, *args), many=True)))


@dataclass(frozen=True)
class Sample(P.Transformer):
    """The size rows of smallest hash."""

    size: int
    source: str = "x"
    seed: int = 42

    def transform(self, df: DataFrame) -> DataFrame:
        return df.orderBy(F.xxhash64(F.col(self.source), F.lit(self.seed))).limit(self.size)


@dataclass(frozen=True, eq=False)
class Model(P.Transformer):
    """A fitted model with apply(column), on a column."""

    model: Any
    source: str = "x"
    target: str = "x"

    def transform(self, df: DataFrame) -> DataFrame:
        return computed(df, self.target, self.model.apply(F.col(self.source)))


def width(df: DataFrame, column: str) -> int:
    """Length of the vectors of a column, from one of them."""
    row = df.select(F.size(column)).first()
    return row[0] if row else 0


@dataclass(frozen=True)
class Scale(P.Estimator):
    weight = 2
    scale: bool = True
    source: str = "x"

    def fit(self, df: DataFrame) -> P.Transformer:
        df = cut(df.select(self.source))  # read twice
        return Model(learn.standard_scaler(df, F.col(self.source), width(df, self.source), self.scale), self.source, self.source)


@dataclass(frozen=True)
class Solve(P.LabelEstimator):
    """Least squares by one solver; y is a column of target vectors."""

    solver: str
    ridge: float = 0.0
    block: int = 4096
    passes: int = 1
    source: str = "x"
    label: str = "y"
    target: str = "scores"

    @property
    def weight(self) -> int:
        return {"exact": 1, "block": 3 * self.passes + 1}.get(self.solver, 20)

    def fit(self, df: DataFrame) -> P.Transformer:
        x, y, d, k = F.col(self.source), F.col(self.label), width(df, self.source), width(df, self.label)
        if self.solver == "exact":
            m = learn.least_squares(df, x, y, d, k, self.ridge)
        elif self.solver == "block":
            m = learn.block_least_squares(df, x, y, d, k, self.block, self.passes, self.ridge)
        else:
            m = learn.lbfgs_least_squares(df, x, y, d, k, self.ridge, 20)
        return Model(m, self.source, self.target)


@dataclass(frozen=True)
class LeastSquares(P.Optimizable, Solve):
    """Chooses the solver by its cost for the rows, features, targets and sparsity of the input."""

    solver: str = "lbfgs"
    machines: int = 16

    def choose(self, sample: DataFrame) -> P.Estimator:
        few = sample.select(F.size(self.source).alias("d"), F.size(self.label).alias("k"), F.size(F.filter(self.source, lambda v: v != 0)).alias("s")).collect()
        if not few:
            return Solve("lbfgs", self.ridge, self.block, self.passes, self.source, self.label, self.target)
        d = max(few[0].d, 1)
        best = learn.choose_solver(self.rows, d, few[0].k, sum(r.s for r in few) / (d * len(few)), self.machines)
        return Solve({"dense_lbfgs": "lbfgs", "sparse_lbfgs": "lbfgs"}.get(best, best), self.ridge, self.block, self.passes, self.source, self.label, self.target)

    rows: int = 1_000_000


@dataclass(frozen=True)
class ClassWeighted(P.LabelEstimator):
    """Class-weighted least squares on an integer label."""

    classes: int
    ridge: float
    mix: float
    block: int | None = None
    passes: int = 1
    source: str = "x"
    label: str = "label"
    target: str = "scores"

    def fit(self, df: DataFrame) -> P.Transformer:
        d = width(df, self.source)
        return Model(learn.class_weighted_least_squares(df, F.col(self.source), F.col(self.label), d, self.classes, self.ridge, self.mix, self.block, self.passes), self.source, self.target)


@dataclass(frozen=True, eq=False)
class KernelScores(P.Transformer):
    model: learn.KernelModel
    source: str = "x"
    target: str = "scores"

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.scores(df, F.col(self.source), self.target)


@dataclass(frozen=True)
class KernelRidge(P.LabelEstimator):
    gamma: float
    ridge: float
    block: int
    epochs: int
    source: str = "x"
    label: str = "y"
    target: str = "scores"

    def fit(self, df: DataFrame) -> P.Transformer:
        d, k = width(df, self.source), width(df, self.label)
        return KernelScores(learn.kernel_ridge(df, F.col(self.source), F.col(self.label), d, k, self.gamma, self.ridge, self.block, self.epochs), self.source, self.target)


@dataclass(frozen=True)
class ColumnPca(P.Estimator):
    """Principal directions of the columns of matrices; how: local or distributed."""

    dims: int
    how: str = "distributed"
    source: str = "x"

    def fit(self, df: DataFrame) -> P.Transformer:
        df = cut(df.select(self.source).where(F.size(self.source) > 0))  # read more than once
        d = df.select(F.size(F.get(self.source, F.lit(0)))).first()[0]
        return Step("project_columns", (Array(decompose.column_pca(df, F.col(self.source), d, self.dims, self.how)),), self.source, self.source)


@dataclass(frozen=True)
class OptimizableColumnPca(P.Optimizable, ColumnPca):
    """Local or distributed by cost."""

    machines: int = 16
    rows: int = 1_000_000

    def choose(self, sample: DataFrame) -> P.Estimator:
        few = sample.where(F.size(self.source) > 0).select(F.size(self.source).alias("n"), F.size(F.get(self.source, F.lit(0))).alias("d")).collect()
        each = sum(r.n for r in few) / max(len(few), 1)
        return ColumnPca(self.dims, decompose.choose_pca(int(each * self.rows), few[0].d if few else 1, self.machines), self.source)


@dataclass(frozen=True, eq=False)
class FisherEncode(P.Transformer):
    mixture: decompose.Mixture
    source: str = "x"

    def transform(self, df: DataFrame) -> DataFrame:
        return computed(df, self.source, decompose.fisher_vectors(F.col(self.source), self.mixture))


@dataclass(frozen=True)
class FisherEstimator(P.Estimator):
    """A mixture of the columns of matrices, whose Fisher vectors encode them."""

    k: int
    source: str = "x"
    rounds: int = 20
    least_mass: float = 40
    seed: int = 0

    def fit(self, df: DataFrame) -> P.Transformer:
        df = cut(df.select(self.source).where(F.size(self.source) > 0))  # read in every round
        d = df.select(F.size(F.get(self.source, F.lit(0)))).first()[0]
        return FisherEncode(decompose.fisher_encoder(df, F.col(self.source), d, self.k, self.seed, rounds=self.rounds, least_mass=self.least_mass), self.source)


@dataclass(frozen=True)
class OptimizableFisher(P.Optimizable, FisherEstimator):
    """From 32 centers up fewer rounds from k-means seeds do; below, rounds until it stands."""

    def choose(self, sample: DataFrame) -> P.Estimator:
        return FisherEstimator(self.k, self.source, self.rounds if self.k < 32 else min(self.rounds, 10), self.least_mass, self.seed)


@dataclass(frozen=True, eq=False)
class Vectorize(P.Transformer):
    """Arrays of terms as vectors over a space of (term, idx), in one column of arrays."""

    space: tuple[tuple[str, int], ...] = field(repr=False)
    presence: bool
    source: str = "x"

    def transform(self, df: DataFrame) -> DataFrame:
        at, n, presence = dict(self.space), len(self.space), self.presence

        @F.arrow_udf("array<double>")
        def run(col):
            import pyarrow as pa

            out = np.zeros((len(col), n))
            for i, terms in enumerate(col.to_pylist()):
                for t in terms or ():
                    k = at.get(t)
                    if k is not None:
                        out[i, k] = 1 if presence else out[i, k] + 1
            return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * n, pa.int32()), pa.array(out.ravel()))

        return computed(df, self.source, run(F.col(self.source)))


@dataclass(frozen=True)
class CommonFeatures(P.Estimator):
    """The size terms that occur most, size being what bounds the space that is kept."""

    size: int
    presence: bool = True
    key: str = "id"
    source: str = "x"

    def fit(self, df: DataFrame) -> P.Transformer:
        space = sparse.common_features(df, self.key, F.col(self.source), self.size)
        return Vectorize(tuple((r.term, r.idx) for r in space.collect()), self.presence, self.source)


@dataclass(frozen=True, eq=False)
class TextVectors(P.Transformer):
    """Texts as vectors over a space of the n-grams of their tokens; the texts themselves go no further."""

    space: tuple[tuple[str, int], ...] = field(repr=False)
    low: int
    high: int
    presence: bool
    source: str = "text"
    target: str = "x"

    def transform(self, df: DataFrame) -> DataFrame:
        keep = [c for c in df.columns if c not in (self.source, self.target)]
        return terms.vectors(df, keep, self.source, list(self.space), self.low, self.high, self.presence, name=self.target)


@dataclass(frozen=True)
class CommonTexts(P.Estimator):
    """CommonFeatures of the n-grams of texts, which are cut and counted without leaving Python."""

    size: int
    low: int = 1
    high: int = 1
    presence: bool = True
    key: str = "id"
    source: str = "text"

    def fit(self, df: DataFrame) -> P.Transformer:
        space = terms.most_common(df, self.key, self.source, self.size, self.low, self.high)
        return TextVectors(tuple(space), self.low, self.high, self.presence, self.source)
