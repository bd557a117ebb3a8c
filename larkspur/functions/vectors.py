"""Functions of dense vectors (array<double>) as Column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions.text import let

TINY = 2.2e-16


def array_of(values) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def linear_rectifier(v: Column, floor: float = 0.0, alpha: float = 0.0) -> Column:
    return F.transform(v, lambda x: F.greatest(F.lit(float(floor)), x - alpha))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def normalize(v: Column) -> Column:
    return let(v, lambda u: let(F.greatest(norm(u), F.lit(TINY)), lambda n: F.transform(u, lambda x: x / n)))


def signed_hellinger(v: Column) -> Column:
    return F.transform(v, lambda x: F.signum(x) * F.sqrt(F.abs(x)))


def multiply(v: Column, w: Column) -> Column:
    return F.zip_with(v, w, lambda a, b: a * b)


def random_signs(size: int, seed: int) -> Column:
    return array_of(np.random.default_rng(seed).integers(0, 2, size) * 2 - 1)


def dot(v: Column, w: Column) -> Column:
    return F.aggregate(multiply(v, w), F.lit(0.0), lambda s, x: s + x)


def squared_distance(v: Column, w: Column) -> Column:
    return F.aggregate(F.zip_with(v, w, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)


def argmax(v: Column) -> Column:
    """Index of the largest value, the first of equal ones."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def top_k(v: Column, k: int) -> Column:
    """Indices of the k largest values, descending, lower index first; all if there are fewer."""
    pairs = F.transform(v, lambda x, i: F.struct((-x).alias("x"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: p["i"])


def indicators(label: Column, classes: int) -> Column:
    """1 at the label and -1 elsewhere; a label out of range is an error."""
    if classes < 2:
        raise ValueError("two classes or more")
    hot = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: F.when(i == label, 1.0).otherwise(-1.0))
    return F.when(label.between(0, classes - 1), hot).otherwise(F.raise_error(F.lit("label out of range")).cast("array<double>"))


def multi_indicators(labels: Column, classes: int) -> Column:
    if classes < 2:
        raise ValueError("two classes or more")
    hot = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: F.when(F.array_contains(labels, i), 1.0).otherwise(-1.0))
    fine = F.forall(labels, lambda x: x.between(0, classes - 1))
    return F.when(fine, hot).otherwise(F.raise_error(F.lit("label out of range")).cast("array<double>"))


def split(v: Column, block: int) -> Column:
    """Blocks of so many elements, the last one short."""

    def cut(u: Column) -> Column:
        at = F.sequence(F.lit(0), F.ceil(F.size(u) / block).cast("int") - 1)
        return F.when(F.size(u) > 0, F.transform(at, lambda b: F.slice(u, b * block + 1, F.lit(block)))).otherwise(F.array().cast("array<array<double>>"))

    return let(v, cut)


def combine(*vectors: Column) -> Column:
    return F.concat(*vectors)


def to_double(v: Column) -> Column:
    return v.cast("array<double>")


def sparsify(v: Column) -> Column:
    """(size, indices, values) of the entries that are not zero."""
    some = F.filter(F.transform(v, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda p: p["x"] != 0)
    return F.struct(F.size(v).alias("size"), F.transform(some, lambda p: p["i"]).alias("indices"), F.transform(some, lambda p: p["x"]).alias("values"))


def densify(s: Column) -> Column:
    def fill(p: Column) -> Column:
        entries = F.map_from_arrays(p["indices"], p["values"])
        return let(entries, lambda m: F.transform(F.sequence(F.lit(0), p["size"] - 1), lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0.0))))

    return let(s, fill)


def one_hot_nearest(v: Column, centers: list[list[float]]) -> Column:
    """1 at the nearest center, the first of equally near ones."""
    far = F.array(*[squared_distance(v, array_of(c)) for c in centers])
    nearest = let(far, lambda f: F.array_position(f, F.array_min(f)) - 1)
    return let(nearest, lambda n: F.transform(F.sequence(F.lit(0), F.lit(len(centers) - 1)), lambda i: F.when(i == n, 1.0).otherwise(0.0)))


def row_statistics_normalize(v: Column, alpha: float = 1.0) -> Column:
    """(v - mean) / sqrt(sample variance + alpha)."""

    def scaled(u: Column, mean: Column) -> Column:
        var = F.aggregate(u, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / F.greatest(F.size(u) - 1, F.lit(1))
        return let(F.sqrt(var + alpha), lambda d: F.transform(u, lambda x: (x - mean) / d))

    return let(v, lambda u: let(F.aggregate(u, F.lit(0.0), lambda s, x: s + x) / F.size(u), lambda mean: scaled(u, mean)))


def about_equal(a, b, within: float = 1e-8) -> bool:
    """Whether two numbers, vectors or matrices differ by less than within everywhere; differing shapes never do."""
    import numpy as np

    a, b = np.asarray(a, float), np.asarray(b, float)
    return a.shape == b.shape and bool((np.abs(a - b) < within).all())


def vectorize_matrix(matrix: Column) -> Column:
    """A matrix (array of its columns) as one vector, column after column."""
    return F.flatten(matrix)
