"""Helpers that the pipeline operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share, as the cluster names it in spark.checkpoint.dir.

    Unset, a temporary folder is made for a local session; on a cluster that
    is an error, because executors could not read each other's files there.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="larkspur-")
    spark.sparkContext.setCheckpointDir(own)
    return own


class Scratch:
    """Tables written in the shared folder to cut lineage; each can be dropped once its successor is written."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def write(self, df: DataFrame) -> DataFrame:
        """df, computed once and read back from the shared folder."""
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._scratch = path  # type: ignore[attr-defined]
        return back

    def drop(self, df: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(df._scratch)  # type: ignore[attr-defined]
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def free_name(df: DataFrame, wanted: str) -> str:
    """wanted, or wanted with underscores before it, so that no column of df (in any case) has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def raw_text(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (one more than rows) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    if off is None or len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int, rows: int = 8192) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows of about limit bytes each (one row at least), so that working arrays stay small."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(max(b, a + 1), n, a + rows)
        yield a, b
        a = b


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_P = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i up to n at least."""
    size = max([1 << 16, *(k for k in _POW)])
    while size < n + 1:
        size *= 2
    if size not in _POW:
        up, down = np.full(size, _P, U64), np.full(size, pow(_P, -1, 1 << 64), U64)
        up[0] = down[0] = 1
        _POW.clear()
        _POW[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POW[size]


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each raw[start:end], by differences of one running polynomial sum."""
    up, down = _powers(len(raw))
    total = np.zeros(len(raw) + 1, U64)
    np.cumsum((raw.astype(U64) + U64(1)) * up[: len(raw)], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


def words(raw: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the runs of member bytes; a run ends where its row does."""
    mask = member[raw]
    edge = np.zeros(len(raw) + 1, np.int8)
    edge[1:-1] = mask[1:] != mask[:-1]
    edge[0] = edge[-1] = 1
    edge[offsets] = 1
    cut = np.flatnonzero(edge)
    starts, ends = cut[:-1], cut[1:]
    own = mask[starts] if len(raw) else np.zeros(0, bool)
    starts, ends = starts[own], ends[own]
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def row_key(*cols: str):
    """64-bit content key of a row; rows of equal content share it."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0null")) for c in cols])


#: Bytes of words: ASCII letters and digits, and every byte of a character beyond ASCII.
WORD_BYTES = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
#: Bytes other than ASCII white space.
SOLID_BYTES = np.array([b not in b" \t\n\r\v\f" for b in range(256)])
