"""Mixing sources to target weights by Pfair scheduling.

Every source's documents, in the order of doc_id, are cut into blocks of
block_chars characters (a document belongs to the block in which it
starts). A source with q of resolution parts of the mix gets, for its i-th
block (from 0), the release time floor(i * R / q) and the deadline
ceil((i + 1) * R / q); in each slot, of the released blocks that with the earliest
deadline goes (ties by name). On one processor this keeps every deadline, so
after any number t of slots each source has had t * q / R blocks give or take
less than one. The parts sum to R, so the schedule repeats every R slots: only
one period, whose length is a parameter, is worked out on the driver, and
a block's slot follows in closed form on the executors.

At the first slot whose source has no block left an epoch ends. The sources that
still have blocks share the next epoch, their weights made whole parts anew, until
every block has its slot; all rows stay.

The order within a source is found by ranges: rows are split by (source, doc_id) at bounds that Spark samples, so any
ids that have an order will do, dense or not, numbers or strings; characters are summed by chunk first
and the running sum is that of a chunk's rows added to those of the chunks before it.

Weights are given, whole or fractional, or else in proportion to the square root of the sources'
characters; a source without a weight counts as one of weight 0, and each has one part of the mix at least.
Nulls: a null source is a source of its own; null and empty
texts have no characters and lie in the block that is open at their place; a
null doc_id (or one that is not a number in a column of floats) comes last in its source; rows that tie in doc_id are
ordered by content, and repeated rows follow each other. A very long text starts in one block and the next text in a later one,
the blocks between having slots without rows. An empty table gives an empty result. Columns pass through.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right
from fractions import Fraction
from math import isqrt, lcm

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.llm.common import Scratch, free_name, row_key

#: Slots in a period: weights are kept to one part in so many. With more sources than that, a period has PARTS slots for each.
RESOLUTION = 1000
PARTS = 4
#: Characters in a block.
BLOCK_CHARS = 16384
#: Chunks, the unit of the distributed running sum, for each partition of a shuffle; a row for each reaches the driver.
CHUNKS = 4


def quotas(weights: dict[str, int], resolution: int = RESOLUTION) -> dict[str, int]:
    """Whole parts of resolution in proportion to weights, one at least, by largest remainders."""
    if len(weights) > resolution:
        raise ValueError("more sources than slots in a period; raise resolution")
    if not weights:
        return {}
    rest, total = resolution - len(weights), max(1, sum(weights.values()))
    parts = {s: 1 + w * rest // total for s, w in weights.items()}
    order = sorted(weights, key=lambda s: (-(weights[s] * rest % total), s))
    for k in range(resolution - sum(parts.values())):
        parts[order[k % len(order)]] += 1
    return parts


def period(parts: dict[str, int], left: dict[str, int] | None = None) -> dict[str, list[int]]:
    """Slots of each source's blocks in one period, by earliest deadline first among released blocks; up to the first slot whose source has none left."""
    length = sum(parts.values())
    slots: dict[str, list[int]] = {s: [] for s in parts}
    coming, ready = [(0, -(-length // q), s) for s, q in parts.items()], []
    heapq.heapify(coming)
    for t in range(length):
        while coming and coming[0][0] <= t:
            heapq.heappush(ready, heapq.heappop(coming)[1:])
        s = heapq.heappop(ready)[1]
        n = len(slots[s])
        if left is not None and n == left[s]:
            break
        slots[s].append(t)
        if n + 1 < parts[s]:
            heapq.heappush(coming, ((n + 1) * length // parts[s], -(-(n + 2) * length // parts[s]), s))
    return slots


def epochs(blocks: dict[str, int], weights: dict[str, int], resolution: int = RESOLUTION) -> list[tuple[str, int, int, int, int, int, list[int]]]:
    """(source, first block, last block, first slot, parts, parts of all, slots in a period) of every source in every epoch in which it has blocks."""
    out, done, start = [], dict.fromkeys(blocks, 0), 0
    while left := {s: n - done[s] for s, n in blocks.items() if n > done[s]}:
        parts = quotas({s: weights[s] for s in left}, resolution)
        length, plan = sum(parts.values()), period(parts, left)
        planned = sum(map(len, plan.values()))
        # A period broken off is the whole epoch; else the first slot that some source can't fill ends it.
        end = planned if planned < length else min(n // parts[s] * length + plan[s][n % parts[s]] for s, n in left.items())
        for s, q in parts.items():
            n = end // length * q + bisect_left(plan[s], end % length)
            if n:
                out.append((s, done[s], done[s] + n - 1, start, q, length, plan[s][:n]))
            done[s] += n
        start += end
    return out


def whole_weights(sources, weights: dict) -> dict[str, int]:
    """Whole numbers in the proportions of weights (by source, None for the null source); those that lack one have 0."""
    given = {s: Fraction(weights.get(s[1:] if s[0] == "=" else None, 0)) for s in sources}
    if any(w < 0 for w in given.values()):
        raise ValueError("weights must not be negative")
    scale = lcm(*(w.denominator for w in given.values()))
    return {s: int(w * scale) for s, w in given.items()}


def mix(docs: DataFrame, weights: dict | None = None, resolution: int = RESOLUTION, block_chars: int = BLOCK_CHARS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs in the mix, with the columns block and slot (with underscores before them where docs has such names)."""
    spark = docs.sparkSession
    key = F.nanvl(F.col(id_col), F.lit(None)) if docs.schema[id_col].dataType.typeName() in ("float", "double") else F.col(id_col)
    added = {
        "name": F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null")), "none": key.isNull(), "id": key,
        "tie": row_key(id_col, text_col), "size": F.coalesce(F.length(text_col), F.lit(0)).cast("long"),
    }
    flat, (name, none, ident, tie, size) = docs, (free_name(docs, f"mix_{c}") for c in added)
    flat = docs.withColumns(dict(zip((name, none, ident, tie, size), added.values())))
    scratch = Scratch(spark, "mix")
    slim = scratch.write(flat.select(*[F.col(c).alias(a) for c, a in zip((name, none, ident, tie, size), added)]))
    chunks = slim.repartitionByRange(CHUNKS * int(spark.conf.get("spark.sql.shuffle.partitions")), "name", "none", "id", "tie").groupBy(
        F.spark_partition_id().alias("part"), "name"
    )
    # A row for each chunk, and one more for each source at most.
    found = chunks.agg(F.min(F.struct("none", "id", "tie")).alias("first"), F.sum("size").alias("n")).collect()
    scratch.drop(slim)
    totals: dict[str, int] = {}
    bounds, before = [], []
    for k, n in sorted((_place(r["name"], *r["first"]), r.n) for r in found):
        bounds.append(k)
        before.append(totals.get(k[0], 0))
        totals[k[0]] = before[-1] + n
    if len(totals) > resolution:
        resolution = PARTS * len(totals)
    wanted = {s: isqrt(n) for s, n in totals.items()} if weights is None else whole_weights(totals, weights)
    blocks = {s: max(1, -(-n // block_chars)) for s, n in totals.items()}

    @F.arrow_udf("struct<chunk:int,before:long,last:long>")
    def locate(names: pa.Array, ids: pa.Array, ties: pa.Array) -> pa.Array:
        names = names.to_pylist()
        at = [bisect_right(bounds, _place(n, i is None, i, t)) - 1 for n, i, t in zip(names, ids.to_pylist(), ties.to_pylist())]
        cols = [pa.array(at, pa.int32()), pa.array([before[k] for k in at], pa.int64()), pa.array([blocks[n] - 1 for n in names], pa.int64())]
        return pa.StructArray.from_arrays(cols, ["chunk", "before", "last"])

    block, slot = free_name(docs, "block"), free_name(docs, "slot")
    at, chunk, of, first, last_block, start, q, length, slots, nth = (free_name(docs, f"mix_{c}") for c in ("at", "chunk", "of", "first", "last", "start", "q", "length", "slots", "nth"))
    table = spark.createDataFrame(epochs(blocks, wanted, resolution), f"`{of}` string, `{first}` long, `{last_block}` long, `{start}` long, `{q}` int, `{length}` int, `{slots}` array<int>")
    within = W.partitionBy(chunk).orderBy(none, ident, tie).rowsBetween(W.unboundedPreceding, -1)
    placed = (
        flat.withColumn(at, locate(name, ident, tie)).withColumn(chunk, F.col(f"{at}.chunk"))
        .withColumn(size, F.coalesce(F.sum(size).over(within), F.lit(0)))
        .withColumn(block, F.least(F.floor((F.col(f"{at}.before") + F.col(size)) / block_chars), F.col(f"{at}.last")).cast("long"))
        # As many rows as sources have epochs and as many slots as there are blocks at most.
        .join(F.broadcast(table), (F.col(name) == F.col(of)) & F.col(block).between(F.col(first), F.col(last_block)))
        .withColumn(nth, F.col(block) - F.col(first))
        .withColumn(slot, F.col(start) + F.floor(F.col(nth) / F.col(q)) * F.col(length) + F.element_at(slots, (F.col(nth) % F.col(q) + 1).cast("int")))
    )
    return placed.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(block), F.col(slot))


def _place(name: str, none: bool, ident, tie: int) -> tuple:
    """Order of a row among all rows."""
    return (name, 1, tie) if none else (name, 0, ident, tie)
