"""Whole applications as pipelines: features, a learner and a classifier, to be fitted on rows of (id, x or text, label).

Each function gives a lazy pipeline; nothing is fitted before a result or fit() is asked for. Targets (y) are made
from labels here, so training data need the columns that the docstrings name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions import vectors
from larkspur.operators import decompose, evaluate, images, learn
from larkspur.operators.batches import sum_batches, to_numpy
from larkspur.operators.lineage import cut
from larkspur.plans import nodes as N
from larkspur.plans import pipeline as P


def with_targets(df: DataFrame, classes: int, label: str = "label") -> DataFrame:
    return df.withColumn("y", vectors.indicators(F.col(label), classes))


CLASS = N.Step("argmax", (), "scores", "class")


def _gathered(branches: list[P.Pipeline], key: str = "id") -> P.Pipeline:
    """Branches over x, joined by key and put one after another in x; labels come from the first."""
    gathered = P.Pipeline.gather(key, **{f"b{k}": b for k, b in enumerate(branches)})
    return gathered.and_then(N.Combine(tuple(f"b{k}_x" for k in range(len(branches)))))


def random_fft(train: DataFrame, classes: int, width: int, branches: int = 4, block: int = 2048, ridge: float = 1.0, seed: int = 0) -> P.Pipeline:
    """Digits: branches of random signs, padded FFT and rectifier; block least squares; the best class. train: id, x, label."""
    rng = np.random.default_rng(seed)
    made = [N.steps(("random_sign", N.Array(rng.integers(0, 2, width) * 2.0 - 1)), "fft", ("rectify_vector", 0.0)) for _ in range(branches)]
    return _classified(_gathered(made), train, classes, N.Solve("block", ridge, block))


def cosine_speech(train: DataFrame, classes: int, width: int, features: int = 4096, batches: int = 2, gamma: float = 0.0555, distribution: str = "gaussian", ridge: float = 0.0, passes: int = 5, seed: int = 0) -> P.Pipeline:
    """Speech frames: batches of random cosine features; block least squares over several passes; the best class. train: id, x, label."""
    made = [N.steps(("cosine", *N.cosine_features(width, features, gamma, seed + k, distribution))) for k in range(batches)]
    return _classified(_gathered(made), train, classes, N.Solve("block", ridge, features, passes))


def _classified(features: P.Pipeline, train: DataFrame, classes: int, estimator: P.Estimator) -> P.Pipeline:
    """features, then the estimator fitted on those of train, then the best class. The key joins targets to features."""
    targets = with_targets(train, classes).select(F.col("id").alias("id"), "y", "label")
    return features.and_then(_WithLabels(estimator, targets), train).and_then(CLASS)


@dataclass(frozen=True, eq=False)
class _WithLabels(P.LabelEstimator):
    """Fits on features joined to targets by id."""

    estimator: P.Estimator
    targets: DataFrame

    @property
    def weight(self) -> int:
        return self.estimator.weight

    def fit(self, df: DataFrame) -> P.Transformer:
        e = self.estimator
        joined = cut(df.select("id", e.source).join(self.targets, "id"))  # features are made once, however often the estimator reads them
        if isinstance(e, P.Optimizable):
            e = e.choose(joined.limit(3))
        return e.fit(joined)


# ---- text


@dataclass(frozen=True)
class Bayes(P.LabelEstimator):
    """Multinomial naive Bayes on vectors of counts; the scores are a linear map."""

    classes: int
    smoothing: float = 1.0
    source: str = "x"
    label: str = "label"

    def fit(self, df: DataFrame) -> P.Transformer:
        d = N.width(df, self.source)
        s = sum_batches(df, [F.col(self.source), F.col(self.label)], lambda x, c: np.stack([np.append(x[c == k].sum(0), (c == k).sum()) for k in range(self.classes)]), (self.classes, d + 1))
        pi = np.log(s[:, -1] + self.smoothing) - np.log(s[:, -1].sum() + self.classes * self.smoothing)
        theta = np.log(s[:, :-1] + self.smoothing) - np.log(s[:, :-1].sum(1, keepdims=True) + d * self.smoothing)
        return N.Model(learn.LinearMapper(theta.T, pi), self.source, "scores")


@dataclass(frozen=True)
class Logistic(P.LabelEstimator):
    ridge: float = 0.0
    rounds: int = 20
    source: str = "x"
    label: str = "label"

    def fit(self, df: DataFrame) -> P.Transformer:
        from pyspark.ml.functions import array_to_vector

        rows = df.select(array_to_vector(self.source).alias("features"), F.col(self.label).cast("double").alias("label"))
        m = learn.logistic_regression(rows, "features", "label", self.ridge, self.rounds)
        return N.Model(learn.LinearMapper(m.coefficientMatrix.toArray().T), self.source, "scores")


TERMS = N.steps("trim", "lower", "tokenize", source="text")


@dataclass(frozen=True)
class Grams(P.Transformer):
    """Tokens as the strings of their n-grams."""

    low: int
    high: int

    def transform(self, df: DataFrame) -> DataFrame:
        from larkspur.functions import text

        return N.computed(df, "x", F.col("x")).withColumn("x", F.flatten(text.ngram_strings(F.col("x"), self.low, self.high)))


def news_groups(train: DataFrame, classes: int, grams: int = 2, size: int = 1000) -> P.Pipeline:
    """Texts by class: n-grams up to grams, their presence, the commonest features, naive Bayes. train: id, text, label."""
    features = N.CommonTexts(size, 1, grams).with_data(train)
    return features.and_then(Bayes(classes), train).and_then(CLASS)


def reviews(train: DataFrame, grams: int = 2, size: int = 1000, ridge: float = 0.0, rounds: int = 20) -> P.Pipeline:
    """Good or bad reviews: n-grams, presence, common features, logistic regression. train: id, text, label."""
    features = N.CommonTexts(size, 1, grams).with_data(train)
    return features.and_then(Logistic(ridge, rounds), train).and_then(CLASS)


# ---- pictures


def linear_pixels(train: DataFrame, classes: int, ridge: float = 0.0) -> P.Pipeline:
    """Gray pixels, the exact linear map, the best class. train: id, x (image), label."""
    return _classified(N.steps("gray", "image_vector"), train, classes, N.Solve("exact", ridge))


def _convolved(filters: np.ndarray, size: int, whitener: decompose.Whitener | None, alpha: float, stride: int, pool: int, train: DataFrame) -> P.Pipeline:
    if whitener is None:
        conv = ("convolve_plain", N.Array(filters), size, True)
    else:
        conv = ("convolve", N.Array(filters), size, N.Array(whitener.matrix), N.Array(whitener.mean), True)
    return N.steps(conv, ("rectify", 0.0, alpha), ("pool", stride, pool), "image_vector").and_then(N.Scale(), train)


def random_filters(train: DataFrame, classes: int, filters: int = 100, size: int = 6, channels: int = 3, alpha: float = 0.25, stride: int = 13, pool: int = 14, ridge: float = 0.0, seed: int = 0) -> P.Pipeline:
    """Random filters, rectifier, pools, scaling, block least squares."""
    f = np.random.default_rng(seed).normal(size=(filters, size * size * channels))
    return _classified(_convolved(f, size, None, alpha, stride, pool, train), train, classes, N.Solve("block", ridge))


def patch_filters(train: DataFrame, filters: int, size: int, step: int = 1, sample: int = 100_000, eps: float = 0.1, seed: int = 0) -> tuple[np.ndarray, decompose.Whitener]:
    """Filters from the pictures themselves: a sample of patches (sample bounds it), normalised, whitened; some of them, of length one, whitened again."""
    patches = P.Pipeline.__call__(N.Explode("windows", (step, size)).and_then(N.Step("image_vector")).and_then(N.Sample(sample)), train).get()
    rows = images.normalize_rows(to_numpy(patches.select("x").toArrow().column("x").combine_chunks()), 10.0)
    whitener = decompose.zca(rows, eps)
    some = whitener.of(rows[np.random.default_rng(seed).permutation(len(rows))[:filters]])
    return some / (np.sqrt((some**2).sum(1, keepdims=True)) + 1e-10) @ whitener.matrix.T, whitener


def patch_classes(
    train: DataFrame, classes: int, filters: int = 100, size: int = 6, alpha: float = 0.25, stride: int = 13, pool: int = 14, ridge: float = 0.0, kernel: tuple[float, int, int] | None = None, seed: int = 0, sample: int = 100_000
) -> P.Pipeline:
    """Filters from patches, convolution, rectifier, pools, scaling; block least squares or, with (gamma, block, epochs), kernel ridge regression."""
    f, white = patch_filters(train, filters, size, sample=sample, seed=seed)
    features = _convolved(f, size, white, alpha, stride, pool, train)
    return _classified(features, train, classes, N.Solve("block", ridge) if kernel is None else N.KernelRidge(kernel[0], ridge, kernel[1], kernel[2]))


@dataclass(frozen=True)
class Numbered(P.Transformer):
    """Rows that an image was made into, each with an id of its own and the image's in name."""

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("name", F.col("id")).withColumn("id", F.xxhash64("id", F.col("x")["data"]))


def augmented_patches(train: DataFrame, patch: int, n: int, seed: int = 0, flip: float = 0.5) -> DataFrame:
    """Random crops of the training pictures, some of them flipped: more rows to learn from."""
    crops = train.withColumn("x", F.explode_outer(images.random_patches_of(F.col("x"), n, patch, patch, F.xxhash64("id", F.lit(seed)))))
    turned = N.computed(crops, "x", images.random_flips(F.col("x"), flip, F.xxhash64("id", F.col("x")["data"], F.lit(seed))))
    return turned.withColumn("name", F.col("id")).withColumn("id", F.xxhash64("id", F.col("x")["data"]))


def augmented_classes(pipe: P.Pipeline, test: DataFrame, patch: int, classes: int) -> DataFrame:
    """(name, class) of test pictures by the mean scores of their corners and center, as they are and flipped."""
    rows = N.Explode("center_corner", (patch, patch, True)).and_then(Numbered())
    return evaluate.augmented(rows.and_then(pipe)(test).get(), "name", F.col("scores"), classes)


def sift_fisher(
    train: DataFrame, classes: int, dims: int = 80, centers: int = 256, ridge: float = 0.5, block: int = 4096, samples: int = 10, sift: tuple = (3, 4, 4, 1), rows: int = 1_000_000, least_mass: float = 40, rounds: int = 20
) -> P.Pipeline:
    """Objects in pictures: SIFT, column PCA, Fisher vectors, block least squares. train: id, x (image), label; the scores rank the classes."""
    features = _encoded(N.steps("pixel_scale", "gray", ("sift", *sift)), train, dims, centers, samples, rows, least_mass, rounds)
    return _classified(features, train, classes, N.Solve("block", ridge, block))


def _encoded(descriptors: P.Pipeline, train: DataFrame, dims: int, centers: int, samples: int, rows: int, least_mass: float, rounds: int) -> P.Pipeline:
    """Descriptors reduced by a PCA of sampled columns and encoded by a mixture of sampled columns."""
    sampler = N.Step("column_sample", (samples, 1))
    pca = descriptors.and_then(N.OptimizableColumnPca(dims, rows=rows).with_data(descriptors.and_then(sampler)(train)))
    fisher = pca.and_then(N.OptimizableFisher(centers, rounds=rounds, least_mass=least_mass).with_data(pca.and_then(N.Step("column_sample", (samples, 2)))(train)))
    return fisher.and_then(N.steps("normalize", "signed_hellinger", "normalize"))


def sift_lcs_fisher(train: DataFrame, classes: int, dims: int = 64, centers: int = 16, ridge: float = 6e-5, mix: float = 0.25, block: int = 4096, samples: int = 10, sift: tuple = (3, 4, 4, 1), lcs: tuple = (4, 16, 6), rows: int = 1_000_000, least_mass: float = 40, rounds: int = 20) -> P.Pipeline:
    """Many classes of pictures: Fisher vectors of SIFT and of local color statistics side by side; class-weighted block least squares."""
    by_sift = _encoded(N.steps("pixel_scale", "gray", ("sift", *sift), "hellinger_columns"), train, dims, centers, samples, rows, least_mass, rounds)
    by_color = _encoded(N.steps(("lcs", *lcs)), train, dims, centers, samples, rows, least_mass, rounds)
    return _classified(_gathered([by_sift, by_color]), train, classes, N.ClassWeighted(classes, ridge, mix, block))
