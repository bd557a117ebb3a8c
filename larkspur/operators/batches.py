"""numpy kernels over Arrow batches: row maps and distributed sums."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_numpy(col: pa.Array) -> np.ndarray:
    """Rows x width of equally long lists, an array of arrays of others, or a vector of numbers."""
    if pa.types.is_list(col.type) or pa.types.is_large_list(col.type):
        size = np.diff(col.offsets.to_numpy())
        if len(size) and (size != size[0]).any():
            return np.array([*(x.values.to_numpy(zero_copy_only=False) for x in col), None], object)[:-1]
        return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1) if len(col) else np.zeros((0, 0))
    return col.to_numpy(zero_copy_only=False)


def to_lists(m: np.ndarray) -> pa.Array:
    m = np.ascontiguousarray(m, np.float64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel()))


def map_vectors(fn: Callable[[np.ndarray], np.ndarray], *vectors: Column) -> Column:
    """A column of vectors from columns of vectors, a batch of rows at a time."""

    @F.arrow_udf("array<double>")
    def run(*cols: pa.Array) -> pa.Array:
        return to_lists(fn(*[to_numpy(c) for c in cols])) if len(cols[0]) else pa.array([], pa.list_(pa.float64()))

    return run(*vectors)


#: Partial results that one task merges, and those that the driver does.
FAN, LAST = 32, 8


def reduce_batches(df: DataFrame, columns: list[Column], add: Callable[..., np.ndarray], merge: Callable[[np.ndarray, np.ndarray], np.ndarray], zero: np.ndarray) -> np.ndarray:
    """Tree reduction: add(state, *batch columns) over the batches of a partition, then merge(state, state) in levels of FAN on executors.

    All partitions of a level run side by side; LAST states at most reach the driver, whatever the number of partitions.
    """
    if df.isStreaming:
        raise ValueError("fitting needs a bounded DataFrame")

    def keep(state: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(state, protocol=5)], pa.binary())], names=["s"])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, some = zero, False
        for b in batches:
            if b.num_rows:
                state, some = add(state, *[to_numpy(c) for c in b.columns]), True
        if some:
            yield keep(state)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, some = zero, False
        for b in batches:
            for s in b.column(0):
                state, some = merge(state, pickle.loads(s.as_buffer())), True
        if some:
            yield keep(state)

    states = df.select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).mapInArrow(part, "s binary")
    n = states.rdd.getNumPartitions()
    while n > LAST:
        n = -(-n // FAN)
        states = states.repartition(n).mapInArrow(join, "s binary")
    state = zero
    for row in states.collect():
        state = merge(state, pickle.loads(row[0]))
    return state


def sum_batches(df: DataFrame, columns: list[Column], fn: Callable[..., np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """Sum of fn(batch columns) over all batches."""
    return reduce_batches(df, columns, lambda s, *c: s + fn(*c), np.add, np.zeros(shape))


#: Bytes of rows in a block of packed().
PACKED = 1 << 16


def packed(df: DataFrame, *columns: Column) -> DataFrame:
    """Vectors or numbers of rows side by side as blocks of bytes (m, and the number of rows n), for passes that would unpack and convert row by row again."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m = np.hstack([to_numpy(c).reshape(b.num_rows, -1) for c in b.columns]).astype(np.float64)
                step = max(1, PACKED // max(1, m.shape[1] * 8))
                parts = [m[i : i + step] for i in range(0, len(m), step)]
                yield pa.RecordBatch.from_arrays([pa.array([p.tobytes() for p in parts], pa.binary()), pa.array([len(p) for p in parts], pa.int32())], names=["m", "n"])

    return df.select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).mapInArrow(pack, "m binary, n int")


def sum_packed(blocks: DataFrame, fn: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """Sum of fn(rows) over the blocks of packed()."""
    return sum_batches(blocks, [F.col("m"), F.col("n")], lambda m, n: sum(fn(np.frombuffer(x).reshape(k, -1)) for x, k in zip(m, n)), shape)
