"""Near-duplicate detection: SimHash fingerprints compared per anchor of a covering code.

Fingerprint: BLOCKS blocks of 31 bits, a weighted vote of the hashes of a
document's distinct words (letters and digits, lower case), each weighing the
square root of its count. Word order does not matter.

Anchors: the codewords of the (31, 26) Hamming code in every block. The code
is perfect: each block value is within the covering radius 1 of exactly one
anchor, its home. Two fingerprints that differ in MAX_BITS = 31 bits or fewer
differ in NEAR = 3 or fewer in some of the 8 blocks, and there the
second lies within radius + NEAR = 4 of the home of the first. So
fingerprints visit all anchors within 4 (1136 or more of them) and meet those at home
there, and all pairs up to MAX_BITS are found for certain. Where a pair differs in 3 bits of the block, one of the two has an
even number of ones there, and that one's visit is enough; pairs that differ in 2 are within 3 of each other's
homes. So those with an odd number visit only the anchors within 3 (156 or so).

Of those that meet, most are far apart. Of the four columns of two blocks, one has MAX_BITS // 4 = 7 differing bits or fewer, and
one of its blocks 3 or fewer; so pairs are compared whole only where the block has 3 or fewer and its column 7 or fewer,
which one 64-bit number of each tells. Other pairs that meet there are near only if they also meet elsewhere.

Anchors whose numbers end in the same bits make a cell; there are as many cells as keep the homes of one
below TILE. A fingerprint is sent to its home's cell and to the cells that it visits, at most to all of them and never to more than it
has anchors, and the anchors themselves are looked up in memory, so the lookups grow with the fingerprints and
not with their square. Cells that are fuller are split by salts on both sides.

Of a group of near duplicates not all pairs are made: in a task, fingerprints of one home are first linked to the first of
them (a star), and stars are compared by their centers; members are compared only where the centers are too far for a link and
too near to rule one out. Every near pair ends up in one class, by links that are near pairs themselves.

Fingerprints that are equal are one node, so copies cost nothing. There is no
cap on the size of an anchor's bucket or of a class.

Nulls: a null or wordless text has no fingerprint, belongs to no group and
stays. A null doc_id orders after all others. Very long texts are read whole, their votes in parts. Repeated rows are copies of each
other. Empty tables give empty results; other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from operator import xor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import WORD_BYTES, Scratch, mix64, raw_text, row_key, slices, span_hashes, words

#: Blocks of 31 bits, two to a 64-bit column.
BLOCKS = 8
#: Largest number of differing bits, of 31 * BLOCKS, at which two documents are near duplicates.
MAX_BITS = 31
#: Differing bits at most, in the block that has the fewest, of a pair with MAX_BITS.
NEAR = MAX_BITS // BLOCKS
#: The same of a column of two blocks; NEAR is half of it, so that such a column has a block with NEAR.
NEAR_COLUMN = MAX_BITS // (BLOCKS // 2)
#: Fingerprints on either side of a task that compares them; a task of two such sides holds 580 MB of Python at 2.83 million fingerprints.
TILE = 1_000_000
#: Rounds of stars in a task.
STARS = 4
#: Anchors looked up at once, and pairs made of them at once.
LOOKUPS, PAIRS = 1 << 17, 1 << 19
COLUMNS = [f"f{k}" for k in range(BLOCKS // 2)]
_LOW = (1 << 31) - 1


def _offsets() -> list[list[int]]:
    """By syndrome, the patterns of weight NEAR + 1 or less that lead to an anchor; the first is the one to the home."""
    out: list[list[int]] = [[] for _ in range(32)]
    for weight in range(NEAR + 2):
        for at in combinations(range(1, 32), weight):
            out[reduce(xor, at, 0)].append(sum(1 << (p - 1) for p in at))
    return out


#: For bit k of the syndrome, the positions (1 to 31) whose number has that bit.
CHECKS = [sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1) for k in range(5)]
OFFSETS = _offsets()


def fingerprints(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints (rows x BLOCKS / 2, 62 bits each) of lower-case texts, and whether a row has words."""
    n, out = len(offsets) - 1, np.zeros((len(offsets) - 1, BLOCKS // 2), np.int64)
    has = np.zeros(n, bool)
    for a, b in slices(offsets, 400_000, 4096):
        start, end, row = words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], WORD_BYTES)
        if not len(start):
            continue
        # Row in the upper 13 bits, hash in the rest: sorting brings a row's equal words together.
        key = np.sort(span_hashes(raw[offsets[a] : offsets[b]], start, end) >> np.uint64(13) | row.astype(np.uint64) << np.uint64(51))
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        count = np.diff(np.concatenate((first, [len(key)])))
        word, doc = key[first] & np.uint64((1 << 51) - 1), (key[first] >> np.uint64(51)).astype(np.int64)
        weight = np.rint(4 * np.sqrt(count)).astype(np.float32)
        begin = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        # Few words at a time, so that the bits stay in the cache; a long row is voted for in parts.
        votes = np.zeros((len(begin), 64 * (BLOCKS // 2)), np.float32)
        total = np.add.reduceat(weight, begin)
        slot = np.repeat(np.arange(len(begin)), np.diff(np.concatenate((begin, [len(doc)]))))
        for i in range(0, len(word), 4096):
            w, s = word[i : i + 4096], slot[i : i + 4096]
            h = np.stack([mix64(w + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) % (1 << 64))) for k in range(BLOCKS // 2)], axis=1)
            bits = np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").astype(np.float32)
            bits *= weight[i : i + 4096, None]
            at = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
            votes[s[at]] += np.add.reduceat(bits, at, axis=0)
        ones = np.packbits(votes * 2 > total[:, None], axis=1, bitorder="little").view(np.uint64)
        rows = a + doc[begin]
        out[rows] = (ones & np.uint64((1 << 62) - 1)).astype(np.int64)
        has[rows] = True
    return out, has


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints, has = fingerprints(*raw_text(batch.column(batch.num_columns - 1)))
        keep = pa.array(has)
        cols = [*batch.columns[:-1], *(pa.array(prints[:, k]) for k in range(BLOCKS // 2))]
        yield pa.RecordBatch.from_arrays([c.filter(keep) for c in cols], names=["doc", "rk", *COLUMNS])


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, rk, f0...) of the rows that have words; rk is a content key of the row."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(
        F.col(id_col).alias("doc"), row_key(id_col, text_col).alias("rk"), F.lower(text_col).alias("text")
    ).mapInArrow(_fingerprint_batches, f"doc {kind}, rk long, " + ", ".join(f"{c} long" for c in COLUMNS))


def _data_bits(x: np.ndarray) -> np.ndarray:
    """The 26 bits of an anchor, or of a difference of anchors, that are no check bits (positions 1, 2, 4, 8, 16)."""
    return x >> 2 & 1 | (x >> 4 & 7) << 1 | (x >> 8 & 127) << 4 | (x >> 16 & 32767) << 11


def _syndrome(v: np.ndarray) -> np.ndarray:
    return sum((np.bitwise_count(v & m).astype(np.int64) & 1) << k for k, m in enumerate(CHECKS))


def _block(prints: np.ndarray, k: int) -> np.ndarray:
    return prints[:, k // 2] >> 31 * (k % 2) & _LOW


_HOME = np.array([x[0] for x in OFFSETS])
#: By syndrome, the way to the home in the data bits of anchors, and from there to every anchor within NEAR + 1.
_MOVES = [_data_bits(np.array(x) ^ x[0]) for x in OFFSETS]
#: Those of a fingerprint with an even, and with an odd number of ones in the block.
_VISITS = [_MOVES, [m[np.bitwise_count(np.array(x)) <= NEAR] for x, m in zip(OFFSETS, _MOVES)]]


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(1, dtype=np.int64)


class Classes:
    """Which nodes are known to be linked: a forest, each root the smallest node."""

    def __init__(self, of: np.ndarray):
        self.parent = of

    def roots(self, nodes: np.ndarray) -> np.ndarray:
        up = self.parent[nodes]
        while not np.array_equal(more := self.parent[up], up):
            up = more
        self.parent[nodes] = up
        return up

    def link(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Links pairs of nodes; which of them joined two classes."""
        x, y = self.roots(a), self.roots(b)
        _, one = np.unique(np.minimum(x, y) * len(self.parent) + np.maximum(x, y), return_index=True)
        one = one[x[one] != y[one]]
        parent, used = self.parent, []
        for k, i, j in zip(one.tolist(), x[one].tolist(), y[one].tolist()):
            while parent[i] != i:
                i = parent[i]
            while parent[j] != j:
                j = parent[j]
            if i != j:
                parent[max(i, j)] = min(i, j)
                used.append(k)
        return np.array(used, np.int64)


def _stars(prints: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Center of every node, within MAX_BITS of it and in its bucket; and the distance to it."""
    center, dist = np.arange(len(prints)), np.zeros(len(prints), np.int64)
    rest = np.argsort(bucket, kind="stable")
    for _ in range(STARS):
        if not len(rest):
            break
        new = np.concatenate(([True], bucket[rest][1:] != bucket[rest][:-1]))
        lead = rest[np.flatnonzero(new)[np.cumsum(new) - 1]]
        d = _far(prints[rest], prints[lead])
        near = d <= MAX_BITS
        center[rest[near]], dist[rest[near]] = lead[near], d[near]
        rest = rest[~near]
    return center, dist


def _expand(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of n items from first: the range of each item, and the item."""
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + first[of]


def close_links(left: np.ndarray, right: np.ndarray | None, k: int, mask: int = 0, cell: int = 0, stars: tuple[bool, bool] = (True, True)) -> tuple[np.ndarray, np.ndarray]:
    """Links (rows i, j of left, then right) that join all rows of left and right which differ in MAX_BITS or fewer, NEAR or fewer of them in block k and NEAR_COLUMN or fewer in its column.

    Of two that differ in an odd number of bits in block k, the one with an even number of ones must be among the visitors (right, or left if None).

    right None: left against itself. Only anchors whose bits under mask are cell are looked at; homes of left are such.
    stars: whether links within left, and within right, that are found before the two meet are told.
    """
    prints = left if right is None else np.concatenate((left, right))
    n, none = len(prints), np.zeros(0, np.int64)
    if not len(left) or n < 2:
        return none, none
    value = _block(prints, k)
    kind = _syndrome(value)
    home = _data_bits(value ^ _HOME[kind])
    side = (np.arange(n) >= len(left)).astype(np.int64)
    center, dist = _stars(prints, home * 2 + side)
    reach = np.zeros(n, np.int64)
    np.maximum.at(reach, center, dist)
    classes = Classes(center.copy())
    # Stars are the same wherever their members go together, so they are told in their home's cell alone, and there once.
    own = np.flatnonzero((center != np.arange(n)) & (home & mask == cell) & np.array(stars)[side])
    found = [(own, center[own])]
    # Homes by the low bits of their anchor; in a bucket, runs of one anchor, column and center.
    m, column, half = len(left), prints[:, k // 2], _LOW << 31 * (k % 2)
    low, wide = (1 << min(24, m.bit_length() + 2)) - 1, (1 << min(26, m.bit_length() + 8)) - 1
    order = np.lexsort((center[:m], column[:m], home[:m], home[:m] & low))
    h, w, c = home[order], column[order], center[order]
    lead = np.flatnonzero(np.concatenate(([True], (w[1:] != w[:-1]) | (c[1:] != c[:-1]))))
    size, h, w, c = np.diff(np.append(lead, m)), h[lead], w[lead], c[lead]
    begin = np.concatenate(([0], np.cumsum(np.bincount(h & low, minlength=low + 1)))).astype(np.int32)
    taken = np.zeros(wide + 1, bool)
    taken[h & wide] = True
    # Visitors of one column and center go together; in the order of their homes, so that lookups that follow each other are close.
    seen = np.arange(n) if right is None else np.arange(m, n)
    seen = seen[np.lexsort((center[seen], column[seen], home[seen]))]
    visit = np.flatnonzero(np.concatenate(([True], (column[seen][1:] != column[seen][:-1]) | (center[seen][1:] != center[seen][:-1]))))
    many, head = np.diff(np.append(visit, len(seen))), seen[visit]
    # By parity, syndrome and the bits that lead to the cell.
    group = (np.bitwise_count(value[head]).astype(np.int64) & 1) << 31 | kind[head] << 26 | (home[head] ^ cell) & mask

    def meetings() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Visitors and runs that meet and are near in the block and in its column."""
        by = np.argsort(group, kind="stable")
        for rows in np.split(by, np.flatnonzero(np.diff(group[by])) + 1) if len(by) else []:
            moves = _VISITS[group[rows[0]] >> 31][group[rows[0]] >> 26 & 31]
            moves = np.sort(moves[moves & mask == group[rows[0]] & mask])
            step = max(1, LOOKUPS // max(1, len(moves)))
            for i in range(0, len(rows) if len(moves) else 0, step):
                own = rows[i : i + step]
                at = (moves[:, None] ^ home[head[own]]).ravel()
                hit = np.flatnonzero(taken[at & wide])
                at, who = at[hit], own[hit % len(own)]
                first, count = begin[at & low], begin[(at & low) + 1] - begin[at & low]
                for x, y in slices(np.concatenate(([0], np.cumsum(count))), PAIRS, PAIRS):
                    ends = np.cumsum(count[x:y])
                    run = np.arange(ends[-1]) + np.repeat(first[x:y] - ends + count[x:y], count[x:y])
                    apart = w[run] ^ np.repeat(column[head[who[x:y]]], count[x:y])
                    good = np.flatnonzero(np.bitwise_count(apart) <= NEAR_COLUMN)
                    good = good[np.bitwise_count(apart[good] & half) <= NEAR]
                    to = x + np.searchsorted(ends, good, "right")
                    # Other anchors may share the bucket; their runs have their own turn.
                    same = h[run[good]] == at[to]
                    yield who[to[same]], run[good[same]]

    for row, run in meetings():
        a, b = center[head[row]], c[run]
        good = a != b
        a, b, row, run = a[good], b[good], row[good], run[good]
        d = _far(prints[a], prints[b])
        near = d <= MAX_BITS
        used = classes.link(a[near], b[near])
        found.append((a[near][used], b[near][used]))
        # Centers that are farther: members may be near as long as the triangle allows it.
        open_ = ~near & (d <= MAX_BITS + reach[a] + reach[b])
        row, run = row[open_], run[open_]
        for x, y in slices(np.concatenate(([0], np.cumsum(many[row] * size[run]))), 1 << 20, 1 << 20):
            r, q = row[x:y], run[x:y]
            apart = classes.roots(center[head[r]]) != classes.roots(c[q])
            r, q = r[apart], q[apart]
            of, member = _expand(visit[r], many[r])
            # A run that is long is gone through in parts too.
            for u, v in slices(np.concatenate(([0], np.cumsum(size[q][of]))), 1 << 20, 1 << 20):
                pair, other = _expand(lead[q[of[u:v]]], size[q[of[u:v]]])
                one, two = seen[member[u:v]][pair], order[other]
                near = _far(prints[one], prints[two]) <= MAX_BITS
                used = classes.link(one[near], two[near])
                found.append((one[near][used], two[near][used]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _spread(mask: int):
    """Rows (k, cell, visits, fid, f0...) of every fingerprint: at home in one cell of each block, and visiting all in reach."""
    reach = [np.unique(m & mask) for m in _MOVES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.stack([batch.column(c).to_numpy() for c in COLUMNS], axis=1)
            for k in range(BLOCKS):
                value = _block(prints, k)
                kind = _syndrome(value)
                home = _data_bits(value ^ _HOME[kind]) & mask
                rows, cells = [np.arange(len(home))], [home]
                for s in range(32):
                    of = np.flatnonzero(kind == s)
                    rows.append(np.repeat(of, len(reach[s])))
                    cells.append((home[of][:, None] ^ reach[s]).ravel())
                at, cell = np.concatenate(rows), np.concatenate(cells)
                own = batch.take(pa.array(at))
                visits = np.arange(len(at)) >= len(home)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(cell), pa.array(visits), *own.columns], names=["k", "cell", "visits", "fid", *COLUMNS])

    return run


def near_links(nodes: DataFrame, tile: int = TILE) -> DataFrame:
    """(a, b), a < b, of nodes (fid, f0...) that differ in MAX_BITS bits at most: links that join every such pair, a link once for each task in which its ends meet at most."""
    n = nodes.count()
    bits = min(20, max(0, -(-n // tile) - 1).bit_length())
    mask = (1 << bits) - 1
    slim = nodes.select("fid", *COLUMNS)

    def compare(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        k, cell = key[0].as_py(), key[1].as_py()
        fid = rows.column("fid").to_numpy()
        if bits:
            visits = rows.column("visits").to_numpy()
            own, guests = np.flatnonzero(~visits), np.flatnonzero(visits)
            fid = fid[np.concatenate((own, guests))]
            left, right = (np.stack([rows.column(c).to_numpy()[at] for c in COLUMNS], axis=1) for at in (own, guests))
            del own, guests, visits
            i, j = close_links(left, right, k, mask, cell, (key[3].as_py() == 0, key[2].as_py() == 0))
        else:
            i, j = close_links(np.stack([rows.column(c).to_numpy() for c in COLUMNS], axis=1), None, k)
        a, b = np.minimum(fid[i], fid[j]), np.maximum(fid[i], fid[j])
        return pa.table({"a": a[a != b], "b": b[a != b]})

    if not bits:
        spread = slim.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))).withColumn("cell", F.lit(0).cast("long"))
        # Among 5 * BLOCKS partitions every block has one of its own; among 4 * BLOCKS two blocks share one.
        return spread.repartition(5 * BLOCKS, "k").groupBy("k", "cell").applyInArrow(compare, "a long, b long")
    spread = slim.mapInArrow(_spread(mask), "k int, cell long, visits boolean, fid long, " + ", ".join(f"{c} long" for c in COLUMNS))
    # A row for each block and cell.
    full = spread.groupBy("k", "cell").agg(F.ceil(F.sum((~F.col("visits")).cast("long")) / tile).cast("int").alias("homes"), F.ceil(F.sum(F.col("visits").cast("long")) / tile).cast("int").alias("guests")).where("homes > 0 and guests > 0")
    split = spread.join(full, ["k", "cell"])
    to = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    own = lambda c: F.array(F.pmod("fid", F.col(c)).cast("int"))
    split = split.withColumn("i", F.explode(F.when(F.col("visits"), to("homes")).otherwise(own("homes")))).withColumn("j", F.explode(F.when(F.col("visits"), own("guests")).otherwise(to("guests"))))
    return split.drop("homes", "guests").repartition(8 * BLOCKS << bits, "k", "cell", "i", "j").groupBy("k", "cell", "i", "j").applyInArrow(compare, "a long, b long")


def components(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of all nodes of the pairs, by contracting every node onto its smallest neighbour until no pair is left."""
    edges = scratch.write(pairs.distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        onto = scratch.write(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        u, v = onto.select(F.col("a").alias("a"), F.col("m").alias("ma")), onto.select(F.col("a").alias("b"), F.col("m").alias("mb"))
        fewer = scratch.write(
            edges.join(u, "a").join(v, "b").where("ma <> mb").select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b")).distinct()
        )
        step = onto.select(F.col("a").alias("root"), "m")
        if labels is None:
            labels = onto.select(F.col("a").alias("node"), F.col("m").alias("root"))
        else:
            labels = scratch.write(labels.join(step, "root", "left").select("node", F.coalesce("m", "root").alias("root")))
        scratch.drop(edges)
        edges = fewer
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _members(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, rk, node, root) of every row in a group of two rows or more."""
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.write(with_fingerprints(docs, id_col, text_col).withColumn("fid", F.xxhash64(*COLUMNS)))
    nodes = scratch.write(prints.groupBy("fid").agg(*[F.min(c).alias(c) for c in COLUMNS], F.count("*").alias("n")))
    labels = components(near_links(nodes.drop("n")), scratch)
    several = nodes.where("n > 1").select(F.col("fid").alias("node"))
    roots = labels.join(several, "node", "full").select("node", F.coalesce("root", "node").alias("root"))
    return prints.select("doc", "rk", F.col("fid").alias("node")).join(roots, "node").select("doc", "rk", "node", "root")


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, members, links) of every row in a group of near duplicates.

    keep_id is the smallest doc_id of the group, members its rows, links the near pairs of different fingerprints that hold it together.
    """
    members = _members(docs, id_col, text_col)
    # First by node, since a third of all rows may be copies of one text.
    nodes = members.groupBy("root", "node").agg(F.min("doc").alias("least"), F.count("*").alias("n"))
    groups = nodes.groupBy("root").agg(F.min("least").alias("keep_id"), F.sum("n").alias("members"), (F.count("*") - 1).alias("links"))
    return members.join(groups, "root").select(F.col("doc").alias(id_col), "keep_id", "members", "links")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group: that of the smallest doc_id, of rows that share it the one of the smallest content key.

    Rows of the same doc_id and text have one content key; of those the one that is smallest by its other columns stays.
    """
    scratch = Scratch(docs.sparkSession, "neardrop")
    members = scratch.write(_members(docs, id_col, text_col))
    kept = members.groupBy("root").agg(F.min(F.struct(F.col("doc").isNull(), "doc", "rk")).getField("rk").alias("rk"))
    # Rows of equal content share a key: all rows of a lost key go, and all but one of a kept key.
    lost = members.select("rk").distinct().join(kept.select("rk").distinct(), "rk", "left_anti")
    repeated = members.groupBy("rk").count().where("count > 1").join(kept, "rk", "left_semi").select("rk")
    gone = scratch.write(lost.select("rk", F.lit(True).alias("lost")).union(repeated.select("rk", F.lit(False))))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), row_key(id_col, text_col).alias("rk"))
    rest = rows.join(gone, "rk", "left_anti").select("doc.*")
    # As text, since not every type has an order; a partial minimum first, so that a hot key is no hot task.
    one = rows.join(gone.where("not lost"), "rk", "left_semi").groupBy("rk").agg(F.min_by("doc", F.to_json("doc")).alias("doc")).select("doc.*")
    return rest.union(one)
