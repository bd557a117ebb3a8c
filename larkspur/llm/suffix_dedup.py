"""Repeated passages across documents by a distributed, two-stage-sorted suffix array.

Suffixes start at words (cut at ASCII white space). A suffix belongs to the bucket of the
smallest hash among the GRAM-word runs inside its first WORDS words, so
two suffixes that begin with the same WORDS words are always in the same
bucket, whatever documents they come from. Buckets that only one document
reaches hold no repeat and are left out. Consecutive suffixes of a
document mostly share a bucket and are sent there together, with the words
that they need.

In a bucket, equal pieces of text are sorted once. The suffix array is made
in two stages: suffixes that are smaller than their successor are
sorted directly (by their first WORDS words, all that matters here); the
others are induced by one scan over the buckets of first words. The lengths
of adjacent common prefixes, up to WORDS, then give the classes of suffixes that
begin alike; runs of repeated suffixes are the passages.

Nulls: a null text has no passages; a null doc_id is a document like others and
comes last in the order. Texts of fewer than WORDS words have none. Each row is
a document, so the passages of repeated rows repeat; of rows that tie in doc_id
the one of the smaller content key comes first. An empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.llm.common import SOLID_BYTES, Scratch, _powers, mix64, raw_text, row_key, slices, span_hashes, words

#: Words of the shortest passage, and of the runs whose hashes name the buckets.
WORDS, GRAM = 50, 10
#: Words that a task sorts at a time.
BUCKET_WORDS = 400_000


def bucket_runs(raw: np.ndarray, offsets: np.ndarray, least: int = WORDS, gram: int = GRAM):
    """Word starts, ends and rows; and of each run of suffixes of one row and bucket its first word, length and key."""
    start, end, row = words(raw, offsets, SOLID_BYTES)
    none = np.zeros(0, np.int64)
    if len(start) < least:
        return start, end, row, none, none, none
    h = span_hashes(raw, start, end)
    up, down = _powers(len(h))
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=total[1:])
    low = mix64((total[gram:] - total[:-gram]) * down[: len(h) - gram + 1])
    width, span = least - gram + 1, 1
    while span * 2 <= width:
        low, span = np.minimum(low[:-span], low[span:]), span * 2
    if width > span:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    whole = row[: len(low)] == row[least - 1 :]
    fresh = np.ones(len(low), bool)
    fresh[1:] = (low[1:] != low[:-1]) | (row[1 : len(low)] != row[: len(low) - 1])
    group = np.cumsum(fresh) - 1
    count = np.bincount(group, weights=whole).astype(np.int64)
    first = np.flatnonzero(fresh)
    some = count > 0  # the suffixes of a row that are long enough come first in it
    return start, end, row, first[some], count[some], low[first[some]].view(np.int64)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = raw_text(batch.column(1))
        for a, b in slices(offsets, 1_000_000):
            _, _, row, first, _, key = bucket_runs(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            own = row[first]
            order = np.lexsort((key, own))
            own, key = own[order], key[order]
            new = np.ones(len(own), bool)
            new[1:] = (own[1:] != own[:-1]) | (key[1:] != key[:-1])
            own, key = own[new], key[new]
            there, at = np.unique(own, return_index=True)
            lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(own)), pa.int32()), pa.array(key))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(a + there)), lists], names=["rk", "keys"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = raw_text(batch.column(2))
        shared = batch.column(3)
        for a, b in slices(offsets, 1_000_000):
            part = raw[offsets[a] : offsets[b]]
            start, end, row, first, count, key = bucket_runs(part, offsets[a : b + 1] - offsets[a])
            begin = np.searchsorted(row, np.arange(b - a))
            own = row[first]
            cut = np.searchsorted(own, np.arange(b - a + 1))
            take = np.zeros(len(first), bool)
            for r in range(b - a):
                take[cut[r] : cut[r + 1]] = np.isin(key[cut[r] : cut[r + 1]], shared[a + r].values.to_numpy())
            first, count, key, own = first[take], count[take], key[take], own[take]
            data = part.tobytes()
            text = [data[i:j] for i, j in zip(start[first].tolist(), end[first + count + WORDS - 2].tolist())]
            rows = pa.array(a + own)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(key), pa.array(first - begin[own]), pa.array(count), pa.array(text, pa.binary())],
                names=["doc", "rk", "key", "pos", "n", "piece"],
            )


def suffix_array(text: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array of text, in which the symbols at ends are unique and smaller than all others.

    Suffixes smaller than their successor are sorted directly, by depth symbols or
    as far as their end; the rest are induced.
    """
    n = len(text)
    smaller = np.zeros(n, bool)  # than the successor; equal symbols take after the next
    smaller[-1] = True
    step = np.sign(np.diff(text))
    at = np.where(step != 0, np.arange(n - 1), n)
    following = np.minimum.accumulate(at[::-1])[::-1]
    smaller[:-1] = np.where(following < n, step[np.minimum(following, n - 2)] > 0, True) if n > 1 else True
    directly = np.flatnonzero(smaller)
    data = text.astype(">u4").tobytes()
    stop = np.minimum(directly + depth, ends[np.searchsorted(ends, directly)] + 1)
    keyed = [data[i:j] for i, j in zip((4 * directly).tolist(), (4 * stop).tolist())]
    direct = directly[sorted(range(len(keyed)), key=keyed.__getitem__)]
    size = int(text.max()) + 1
    first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=size))))[:-1]
    induced = np.bincount(text[~smaller], minlength=size)
    symbol = text[direct]
    lead = np.searchsorted(symbol, symbol)  # direct is in the order of its first symbols
    array = np.full(n, -1, np.int64)
    array[first[symbol] + induced[symbol] + np.arange(len(direct)) - lead] = direct
    out, head, letters, larger = array.tolist(), first.tolist(), text.tolist(), (~smaller).tolist()
    for i in range(n):
        j = out[i] - 1
        if j >= 0 and larger[j]:
            c = letters[j]
            out[head[c]] = j
            head[c] += 1
    return np.array(out, np.int64)


def common_prefixes(text: np.ndarray, array: np.ndarray, limit: int) -> np.ndarray:
    """Symbols, up to limit, that each suffix of the array shares with the one before it."""
    out = np.zeros(len(array), np.int64)
    pair, left, right = np.arange(1, len(array)), array[:-1], array[1:]
    for k in range(limit):
        inside = np.maximum(left, right) + k < len(text)
        pair, left, right = pair[inside], left[inside], right[inside]
        same = text[left + k] == text[right + k]
        pair, left, right = pair[same], left[same], right[same]
        if not len(pair):
            break
        out[pair] = k + 1
    return out


def _classes(pieces: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For distinct pieces with so many starts each: piece, start and class of every start; equal classes begin with the same WORDS words."""
    split = [p.split() for p in pieces]
    size = np.array([len(s) for s in split])
    flat = [w for s in split for w in s]
    rank = {w: k for k, w in enumerate(sorted(set(flat)), len(pieces))}
    ends = np.cumsum(size + 1) - 1
    text = np.zeros(int(ends[-1]) + 1, np.int64)
    word = np.ones(len(text), bool)
    word[ends] = False
    text[word] = [rank[w] for w in flat]
    text[ends] = np.arange(len(pieces))
    array = suffix_array(text, ends, WORDS)
    shared = common_prefixes(text, array, WORDS)
    group = np.cumsum(shared < WORDS)
    piece = np.searchsorted(ends, array)
    start = array - (ends[piece] - size[piece])
    real = start < counts[piece]
    return piece[real], start[real], group[real]


def _passages(key: tuple, rows: pa.Table) -> pa.Table:
    doc, rk = rows.column("doc").combine_chunks(), rows.column("rk").to_numpy()
    pos, n = rows.column("pos").to_numpy(), rows.column("n").to_numpy()
    known: dict[tuple[bytes, int], int] = {}
    which = np.array([known.setdefault(x, len(known)) for x in zip(rows.column("piece").to_pylist(), n.tolist())])
    piece, start, group = _classes([p for p, _ in known], np.array([c for _, c in known]))
    # Rows of equal content are told apart: the i-th that has this key and place.
    same = np.lexsort((pos, rk))
    fresh = np.ones(len(same), bool)
    fresh[1:] = (rk[same][1:] != rk[same][:-1]) | (pos[same][1:] != pos[same][:-1])
    one = np.zeros(len(same), np.int64)
    one[same] = np.arange(len(same)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    # Documents in the order in which the first occurrence counts.
    order = pa.compute.sort_indices(pa.table({"d": doc, "k": rk, "o": one}), sort_keys=[("d", "ascending"), ("k", "ascending"), ("o", "ascending")]).to_numpy()
    ident = np.zeros(len(rk), np.int64)
    change = np.ones(len(rk), bool)
    change[1:] = (rk[order][1:] != rk[order][:-1]) | (one[order][1:] != one[order][:-1])
    ident[order] = np.cumsum(change)
    by_piece = np.argsort(which, kind="stable")
    lead = np.searchsorted(which[by_piece], np.arange(len(known) + 1))
    many = np.diff(lead)[piece]
    # Every (class, row): expand starts by the rows that hold their piece.
    rep = np.repeat(np.arange(len(piece)), many)
    row = by_piece[np.repeat(lead[piece], many) + np.arange(len(rep)) - np.repeat(np.cumsum(many) - many, many)]
    cls, at = group[rep], pos[row] + start[rep]
    pairs = np.lexsort((ident[row], cls))
    c, d = cls[pairs], ident[row][pairs]
    new_class = np.ones(len(c), bool)
    new_class[1:] = c[1:] != c[:-1]
    new_doc = new_class.copy()
    new_doc[1:] |= d[1:] != d[:-1]
    slot = np.cumsum(new_class) - 1
    docs = np.bincount(slot, weights=new_doc).astype(np.int64)[slot]
    later = d != d[np.flatnonzero(new_class)][slot]
    keep = docs > 1
    row, at, docs, later = row[pairs][keep], at[pairs][keep], docs[keep], later[keep]
    order = np.lexsort((at, later, ident[row]))
    row, at, docs, later = row[order], at[order], docs[order], later[order]
    new = np.ones(len(row), bool)
    new[1:] = (ident[row][1:] != ident[row][:-1]) | (later[1:] != later[:-1]) | (at[1:] > at[:-1] + 1)
    lead = np.flatnonzero(new)
    last = np.append(lead[1:], len(row)) - 1
    most = np.maximum.reduceat(docs, lead) if len(lead) else docs
    return pa.table(
        [doc.take(pa.array(row[lead])), pa.array(rk[row[lead]]), pa.array(one[row[lead]]), pa.array(later[lead]), pa.array(at[lead]), pa.array(at[last] + WORDS), pa.array(most)],
        names=["doc", "rk", "row", "later", "first_word", "end_word", "n_docs"],
    )


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, later, first_word, end_word, n_docs) of the passages of WORDS words or more that two documents or more share.

    later: another document, that comes before in the order of doc_id, has the passage too.
    n_docs: most documents that share any WORDS words of it.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    scratch = Scratch(spark, "suffix")
    flat = docs.select(F.col(id_col).alias("doc"), row_key(id_col, text_col).alias("rk"), F.col(text_col).alias("text"))
    keys = scratch.write(flat.select("rk", "text").mapInArrow(_keys, "rk long, keys array<long>"))
    each = keys.select("rk", F.explode("keys").alias("key"))
    shared = scratch.write(each.groupBy("key").count().where("count > 1").select("key"))
    hits = each.join(shared, "key").groupBy("rk").agg(F.collect_set("key").alias("keys"))
    pieces = scratch.write(
        flat.join(hits, "rk").select("doc", "rk", "text", "keys")
        .mapInArrow(_pieces, f"doc {kind}, rk long, key long, pos long, n long, piece binary")
    )
    scratch.drop(keys)
    total = pieces.agg(F.coalesce(F.sum(F.col("n") + (WORDS - 1)), F.lit(0))).first()[0]
    found = (
        pieces.withColumn("bucket", F.pmod("key", F.lit(max(1, -(-total // BUCKET_WORDS)))).cast("long"))
        .groupBy("bucket")
        .applyInArrow(_passages, f"doc {kind}, rk long, row long, later boolean, first_word long, end_word long, n_docs long")
    )
    # The parts of a passage come from several buckets: join those that overlap or touch.
    own = W.partitionBy("rk", "row", "later").orderBy("first_word", "end_word")
    before = F.max("end_word").over(own.rowsBetween(W.unboundedPreceding, -1))
    return (
        found.withColumn("new", F.when(before - (WORDS - 1) >= F.col("first_word"), 0).otherwise(1))
        .withColumn("part", F.sum("new").over(own.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy("rk", "row", "later", "part")
        .agg(F.first("doc").alias(id_col), F.min("first_word").alias("first_word"), F.max("end_word").alias("end_word"), F.max("n_docs").alias("n_docs"))
        .select(id_col, "later", "first_word", "end_word", "n_docs")
    )
