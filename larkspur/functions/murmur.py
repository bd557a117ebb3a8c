"""Hashes of n-grams by rolling 32-bit murmur mixing over the hashes of their terms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = 83007  # string hash of "Seq"


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint32(r)) | (x >> np.uint32(32 - r))


def mix(h: np.ndarray, data: np.ndarray) -> np.ndarray:
    k = _rotl(data * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
    return _rotl(h ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)


def finish(h: np.ndarray, n: int) -> np.ndarray:
    h = h ^ np.uint32(n)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return h ^ (h >> np.uint32(16))


def ngram_hashes(terms: np.ndarray, low: int, high: int) -> np.ndarray:
    """Signed hashes of all n-grams of a sequence of signed term hashes, by length."""
    t = terms.astype(np.int64).astype(np.uint32)
    h, out = np.full(len(t), SEED, np.uint32), []
    for n in range(1, high + 1):
        m = max(len(t) - n + 1, 0)
        h = mix(h[:m], t[n - 1 :][:m])
        if n >= low:
            out.append(finish(h, n))
    return np.concatenate(out).astype(np.int32) if out else np.zeros(0, np.int32)


def ngram_hashes_of(terms: np.ndarray, row: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and signed hashes of the n-grams of many rows' term hashes, which lie one row after another."""
    t, h, rows, out = terms.astype(np.uint32), np.full(len(terms), SEED, np.uint32), [], []
    start = np.arange(len(t))
    for n in range(1, high + 1):
        some = start + n - 1 < len(t)
        some[some] = row[start[some]] == row[start[some] + n - 1]
        start, h = start[some], h[some]
        h = mix(h, t[start + n - 1])
        if n >= low:
            rows.append(row[start])
            out.append(finish(h, n).view(np.int32).astype(np.int64))
    return np.concatenate(rows), np.concatenate(out)


def ngram_buckets(hashes: Column, low: int, high: int, buckets: int) -> Column:
    """Bucket numbers of all n-grams of an array of term hashes."""

    @F.arrow_udf("array<int>")
    def run(col: pa.Array) -> pa.Array:
        rows = [np.mod(ngram_hashes(np.asarray(r.values.to_numpy(zero_copy_only=False)), low, high).astype(np.int64), buckets) if r.is_valid else None for r in col]
        return pa.array([None if r is None else r.astype(np.int32) for r in rows], pa.list_(pa.int32()))

    return run(hashes)
