"""Best-fit-decreasing packing of documents into sequences of fixed capacity.

Documents are counted in byte tokens, one for each UTF-8 byte and an end mark.
Those longer than a sequence give full sequences and a remainder. Rows are
dealt by a content hash, or as they follow each other in their files (in_order), to
shards of about shard_tokens, a size that is independent of the corpus; in a shard, pieces go from long to short (ties by
doc_id, then content) into the open bin that they fill most tightly (of equally
tight ones the oldest), which a segment tree over the remaining capacities
finds in logarithmic time.

Nulls: a null text counts as empty, an end mark alone; a null doc_id is kept
and orders last. Repeated rows are packed each. An empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.llm.common import row_key

CAPACITY = 16384
#: Tokens that a shard packs by itself. At least a thousand sequences, so that its last bins weigh little.
SHARD_TOKENS = 1 << 25


class Capacities:
    """Open bins by remaining capacity; a segment tree of counts finds the smallest that is large enough."""

    def __init__(self, capacity: int):
        self.leaves = 1
        while self.leaves <= capacity:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)
        self.bins: dict[int, list[int]] = {}

    def add(self, room: int, at: int) -> None:
        heapq.heappush(self.bins.setdefault(room, []), at)
        i = room + self.leaves
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Room and number of the tightest bin with need or more left, or None."""
        count, i = self.count, need + self.leaves
        while not count[i]:
            while i & 1:  # a right child: its successors lie under an ancestor's sibling
                i >>= 1
            if not i:
                return None
            i += 1
        while i < self.leaves:
            i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.leaves
        at = heapq.heappop(self.bins[room])
        while i:
            count[i] -= 1
            i >>= 1
        return room, at


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of every piece, sizes being in the order of packing; and the number of bins."""
    open_bins, bins, offsets, n = Capacities(capacity), np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), 0
    for k, size in enumerate(sizes.tolist()):
        found = open_bins.take(size)
        room, at = found if found else (capacity, n)
        n += found is None
        bins[k], offsets[k] = at, capacity - room
        if room > size:
            open_bins.add(room - size, at)
    return bins, offsets, n


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text", in_order: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, shard, bin, offset): where each piece of each row's tokens lies.

    in_order: docs are read from files, whose names and rows give the order of the shards.
    """
    meta = docs.metadataColumn("_metadata") if in_order else None
    place = [meta["file_path"].alias("file"), meta["row_index"].alias("at")] if in_order else []
    sized = docs.select(*place, F.col(id_col).alias("doc"), row_key(id_col, text_col).alias("rk"), (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("n"))
    if in_order:
        # A row per file is numbered in one task; the rows of a file are summed in theirs.
        files = sized.groupBy("file").agg(F.sum("n").alias("all")).withColumn("before", F.sum("all").over(W.orderBy("file")) - F.col("all"))
        row = F.sum("n").over(W.partitionBy("file").orderBy("at")) - F.col("n")
        dealt = sized.withColumn("row", row).join(files.drop("all"), "file").withColumn("shard", F.floor((F.col("before") + F.col("row")) / shard_tokens).cast("long")).select("doc", "rk", "n", "shard")
    else:
        total = sized.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        dealt = sized.withColumn("shard", F.pmod("rk", F.lit(max(1, -(-total // shard_tokens)))).cast("long"))
    kind = docs.schema[id_col].dataType.simpleString()

    def fill(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("n", "descending"), ("doc", "ascending"), ("rk", "ascending")])
        n = rows.column("n").to_numpy()
        full, rest = n // capacity, n % capacity
        many = int(full.sum())
        whole = np.repeat(np.arange(len(n)), full)
        order = np.flatnonzero(rest)
        order = order[np.argsort(-rest[order], kind="stable")]
        bins, offsets, _ = best_fit(rest[order], capacity)
        row = np.concatenate((whole, order))
        piece = np.concatenate((np.arange(many) - np.repeat(np.cumsum(full) - full, full), full[order]))
        cols = [
            rows.column("doc").take(pa.array(row)), piece, piece * capacity,
            np.concatenate((np.full(many, capacity), rest[order])), np.full(len(row), key[0].as_py()),
            np.concatenate((np.arange(many), many + bins)), np.concatenate((np.zeros(many, np.int64), offsets)),
        ]
        return pa.table([c if isinstance(c, pa.ChunkedArray) else pa.array(c, pa.int64()) for c in cols], names=["doc", "piece", "start", "length", "shard", "bin", "offset"])

    packed = (
        dealt.groupBy("shard")
        .applyInArrow(fill, f"doc {kind}, piece long, start long, length long, shard long, bin long, offset long")
    )
    return packed.withColumnRenamed("doc", id_col)
