"""Terms of texts counted in Python over Arrow batches: what a row's terms add up to is found beside the row, and not by a shuffle of every term.

Texts are cut into tokens as by functions.text.tokenize() after trim() and lower(), a few megabytes at a time, so memory doesn't
grow with the batch; a longer text is worked on alone. Null texts have no tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import murmur

#: Bytes of text worked on at a time.
SLICE = 1 << 22
#: Repeated keys that are broadcast.
REPEATED = 100_000
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127), 32, 9, 10, 11, 12, 13]] = True


@dataclass(frozen=True)
class Tokens:
    """Of some rows: each token's row and place in it, the number of its term, and the terms."""

    rows: int
    row: np.ndarray
    pos: np.ndarray
    code: np.ndarray
    terms: pa.Array

    def pairs(self) -> np.ndarray:
        """Where a token is followed by another one of its row."""
        return np.flatnonzero(self.row[1:] == self.row[:-1])

    def grams(self, low: int, high: int) -> Tokens:
        """N-grams of low to high tokens in place of tokens; they stand as ngram_strings() has them, shorter ones first."""
        parts, row, code, names = [], self.row, self.code.astype(np.int64), self.terms
        start = np.arange(len(row))
        for n in range(1, high + 1):
            if n > 1:
                some = start[start + n - 1 < len(self.row)]
                some = some[self.row[some] == self.row[some + n - 1]]
                before = np.searchsorted(start, some)
                key = code[before] * len(self.terms) + self.code[some + n - 1]
                both = _distinct(key)[0]
                code = np.searchsorted(both, key)
                names = pc.binary_join_element_wise(names.take(pa.array(both // len(self.terms))), self.terms.take(pa.array(both % len(self.terms))), " ") if len(both) else names[:0]
                start, row = some, self.row[some]
            if n >= low:
                parts.append((row, np.full(len(row), n), self.pos[start], code, names))
        row, order, pos, code = (np.concatenate([p[k] for p in parts]) for k in range(4))
        code = code + np.repeat(np.cumsum([0, *(len(p[4]) for p in parts[:-1])]), [len(p[0]) for p in parts])
        by = np.lexsort((pos, order, row)) if len(parts) > 1 else np.arange(len(row))
        row = row[by]
        place = np.arange(len(row)) - np.searchsorted(row, np.arange(self.rows))[row]
        return Tokens(self.rows, row, place, code[by], pa.concat_arrays([p[4] for p in parts]))

    def counted(self, code: np.ndarray | None = None, row: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, codes (from 0) and how often they occur together."""
        code, row = self.code if code is None else code, self.row if row is None else row
        size = int(code.max()) + 1 if len(code) else 1
        key, n = np.unique(row * size + code, return_counts=True)
        return key // size, key % size, n


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct whole numbers from 0, where each is first, and how often it is there: a plain sort of numbers with their place."""
    if not len(key):
        return key, key, key
    bits = len(key).bit_length()
    if int(key.max()) >> (62 - bits):
        return np.unique(key, return_index=True, return_counts=True)
    both = np.sort(key << bits | np.arange(len(key)))
    value = both >> bits
    begin = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
    return value[begin], both[begin] & ((1 << bits) - 1), np.diff(np.append(begin, len(key)))


def _orders(t: Tokens, low: int, high: int) -> Iterator[tuple[Tokens, np.ndarray]]:
    """Tokens of the n-grams of each length, and for every row the number of shorter ones that stand before them."""
    before = np.zeros(t.rows, np.int64)
    for n in range(low, high + 1):
        g = t if n == 1 else t.grams(n, n)
        yield g, before
        before = before + np.bincount(g.row, minlength=t.rows)


class _Space:
    """Places of a space's n-grams, found among tokens without making strings of theirs."""

    def __init__(self, space: list[tuple[str, int]], low: int, high: int):
        self.low, self.high = low, high
        self.parts = [([g.split(" ") for g, _ in space if g.count(" ") == n - 1], np.array([i for g, i in space if g.count(" ") == n - 1], np.int64)) for n in range(1, high + 1)]
        self.words = [pa.array([w for g in grams for w in g], pa.string()) for grams, _ in self.parts]

    def find(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Rows and places of all tokens' n-grams that are in the space."""
        rows, places = [], []
        for n in range(self.low, self.high + 1):
            grams, idx = self.parts[n - 1]
            at = pc.index_in(self.words[n - 1], value_set=t.terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, n)
            at, to = at[(at >= 0).all(1)], idx[(at >= 0).all(1)] if len(grams) else idx
            start = np.arange(len(t.row))
            # Of n-grams whose beginnings are wanted, those whose next term is.
            key, want = t.code.astype(np.int64), at[:, 0] if len(at) else np.zeros(0, np.int64)
            for k in range(n):
                if k:
                    start = start[start + k < len(t.row)] if len(start) else start
                    key = key[: len(start)]
                    same = t.row[start] == t.row[start + k]
                    start, key = start[same], key[same] * len(t.terms) + t.code[start[same] + k]
                    want = want * len(t.terms) + at[:, k]
                known = np.unique(want)
                held = np.searchsorted(known, key)
                hit = np.flatnonzero(known[np.minimum(held, max(len(known) - 1, 0))] == key) if len(known) else np.zeros(0, np.int64)
                start, key, want = start[hit], held[hit], np.searchsorted(known, want)
            place = np.zeros(len(known), np.int64)
            place[want] = to
            rows.append(t.row[start])
            places.append(place[key])
        return np.concatenate(rows), np.concatenate(places)


def split(raw: np.ndarray, offsets: np.ndarray, null: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row, place and text of every token of lower-case texts, rows of raw[offsets]."""
    n, start, end = len(offsets) - 1, offsets[:-1], offsets[1:]
    solid = np.flatnonzero(raw > 32)
    lo, hi = np.searchsorted(solid, start), np.searchsorted(solid, end)
    some = hi > lo
    first, last = start.copy(), start.copy()
    first[some], last[some] = solid[lo[some]], solid[hi[some] - 1] + 1
    inside = np.zeros(len(raw) + 1, np.int8)
    inside[first[some]] += 1
    np.subtract.at(inside, last[some], 1)
    mask = ~_SEPARATOR[raw] & (np.cumsum(inside[:-1], dtype=np.int8) > 0)
    begin, stop = mask.copy(), mask.copy()
    begin[1:] &= ~mask[:-1]
    stop[:-1] &= ~mask[1:]
    at = first[some]
    begin[at] = mask[at]
    stop[last[some] - 1] = mask[last[some] - 1]
    s, e = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    row = np.searchsorted(offsets, s, side="right") - 1
    many = np.bincount(row, minlength=n)
    # An empty text is one empty token, and so is what stands before a separator at the beginning.
    lead = np.zeros(n, bool)
    lead[some] = _SEPARATOR[raw[first[some]]] & (many[some] > 0)
    extra = np.flatnonzero((lead | ~some) & ~null)
    to = np.searchsorted(row, extra)
    row, size = np.insert(row, to, extra), np.insert(e - s, to, 0)
    data = raw[mask]
    words = pa.StringArray.from_buffers(len(size), pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int32)), pa.py_buffer(data))
    pos = np.arange(len(row)) - np.searchsorted(row, np.arange(n))[row]
    return row, pos, words


def tokens(col: pa.Array) -> Iterator[tuple[int, Tokens]]:
    """(first row, tokens) of a batch of lower-case texts, slice after slice."""
    null = col.is_null().to_numpy(zero_copy_only=False)
    col = pc.fill_null(col, "").cast(pa.large_string())
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(col):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE, side="right")) - 1)
        row, pos, words = split(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], null[a:b])
        known = words.dictionary_encode()
        yield a, Tokens(b - a, row, pos, known.indices.to_numpy(), known.dictionary)
        a = b


def by_rows(df: DataFrame, columns: list[str], text: str, fn: Callable, schema: str) -> DataFrame:
    """What fn makes of the tokens of rows. fn(tokens, columns of those rows) gives rows (or None) and arrays: the columns of the rows, if given, and the arrays."""
    flat = df.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(columns)], F.lower(text).alias("text"))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.columns[:-1]
            for a, t in tokens(batch.column(batch.num_columns - 1)):
                for rows, *arrays in fn(t, [c.slice(a, t.rows) for c in own]):
                    kept = [] if rows is None else [c.take(pa.array(rows + a)) for c in own]
                    yield pa.RecordBatch.from_arrays([*kept, *arrays], names=names)

    return flat.mapInArrow(run, schema)


def _kinds(df: DataFrame, columns: list[str]) -> list[str]:
    return [f"{c} {df.schema[c].dataType.simpleString()}" for c in columns]


def _merged(df: DataFrame, key: str, make: Callable[[DataFrame], DataFrame], count: str) -> DataFrame:
    """make(df), whose rows are counts by key and other columns: rows of keys that occur once are whole, others are added up."""
    again = df.groupBy(key).agg(F.count("*").alias("rows_")).where("rows_ > 1").select(F.col(key).alias("again_"))
    n = again.count()

    def added(rows: DataFrame) -> DataFrame:
        made = make(rows)
        return made.groupBy(*[c for c in made.columns if c != count]).agg(F.sum(count).alias(count))

    if not n:
        return make(df)
    if n > REPEATED:
        return added(df)
    same = F.col(key).eqNullSafe(F.col("again_"))
    return make(df.join(F.broadcast(again), same, "left_anti")).unionByName(added(df.join(F.broadcast(again), same, "left_semi")))


def gram_counts(df: DataFrame, key: str, text: str, low: int, high: int) -> DataFrame:
    """(key, n, ngram, cnt) of each key's distinct n-grams of each length."""

    def fn(t: Tokens, _):
        for n in range(low, high + 1):
            g = t if n == 1 else t.grams(n, n)
            row, code, cnt = g.counted()
            yield row, pa.array(np.full(len(row), n, np.int32)), g.terms.take(pa.array(code)), pa.array(cnt)

    return _merged(df, key, lambda rows: by_rows(rows, [key], text, fn, ", ".join([*_kinds(df, [key]), "n int, ngram string, cnt bigint"])), "cnt")


def frequency(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, n) of each key's distinct terms."""
    return gram_counts(df, key, text, 1, 1).select(key, F.col("ngram").alias("term"), F.col("cnt").alias("n"))


def all_grams(df: DataFrame, text: str, n: int) -> DataFrame:
    """(ngram, cnt) over all rows; each slice adds up its own first."""

    def fn(t: Tokens, _):
        g = t.grams(n, n)
        _, code, cnt = g.counted(row=np.zeros(len(g.row), np.int64))
        yield None, g.terms.take(pa.array(code)), pa.array(cnt)

    return by_rows(df, [], text, fn, "ngram string, cnt bigint").groupBy("ngram").agg(F.sum("cnt").alias("cnt"))


def java_hashes(terms: pa.Array) -> np.ndarray:
    """hashCode of Java strings, over their UTF-16 units, by differences of one running sum."""
    raw = b"".join(b.as_buffer() for b in terms.cast(pa.binary())) if terms.offset else None
    if raw is None:
        _, off, data = terms.cast(pa.string()).buffers()
        offsets = np.frombuffer(off, np.int32)[: len(terms) + 1].astype(np.int64) if len(terms) else np.zeros(1, np.int64)
        raw = bytes(data)[: offsets[-1]] if data is not None else b""
    else:
        offsets = np.append(0, np.cumsum(pc.binary_length(terms).to_numpy(zero_copy_only=False)))
    b = np.frombuffer(raw, np.uint8)
    each = np.where(b < 0x80, 1, np.where(b < 0xC0, 0, np.where(b < 0xF0, 1, 2)))
    at = np.append(0, np.cumsum(each))[offsets]
    units = np.frombuffer(raw.decode("utf-8").encode("utf-16-le"), "<u2").astype(np.uint32)
    up, down = np.full(len(units) + 1, 31, np.uint32), np.full(len(units) + 1, pow(31, -1, 1 << 32), np.uint32)
    up[0] = down[0] = 1
    up, down = np.multiply.accumulate(up, dtype=np.uint32), np.multiply.accumulate(down, dtype=np.uint32)
    total = np.append(np.uint32(0), np.cumsum(units * down[:-1], dtype=np.uint32))
    some = at[1:] > at[:-1]
    return np.where(some, (total[at[1:]] - total[at[:-1]]) * up[np.maximum(at[1:] - 1, 0)], 0).astype(np.uint32).view(np.int32).astype(np.int64)


def hashed_counts(df: DataFrame, key: str, text: str, buckets: int, low: int = 1, high: int = 1, rolled: bool = False) -> DataFrame:
    """(key, bucket, cnt): terms by their Java hash, or with rolled n-grams of low to high terms by murmur mixing of those."""

    def fn(t: Tokens, _):
        h = java_hashes(t.terms)[t.code]
        row, found = t.row, h
        if rolled:
            row, found = murmur.ngram_hashes_of(h, t.row, low, high)
        row, bucket, cnt = t.counted(np.mod(found, buckets), row)
        yield row, pa.array(bucket.astype(np.int32)), pa.array(cnt)

    return _merged(df, key, lambda rows: by_rows(rows, [key], text, fn, ", ".join([*_kinds(df, [key]), "bucket int, cnt bigint"])), "cnt")


def seen(df: DataFrame, key: str, text: str, low: int = 1, high: int = 1) -> DataFrame:
    """(term, count, first) of every n-gram of low to high terms; first: (row, pos) where it appears first."""

    def fn(t: Tokens, columns):
        rank = np.empty(t.rows, np.int64)
        rank[pc.sort_indices(pa.table({"k": columns[0]}), sort_keys=[("k", "ascending")], null_placement="at_start").to_numpy()] = np.arange(t.rows)
        for g, before in _orders(t, low, high):
            at = np.argsort(rank[g.row], kind="stable") if (np.diff(rank) < 0).any() else np.arange(len(g.row))
            code, first, cnt = _distinct(g.code[at].astype(np.int64))
            first = at[first]
            yield g.row[first], g.terms.take(pa.array(code)), pa.array((g.pos[first] + before[g.row[first]]).astype(np.int32)), pa.array(cnt)

    flat = by_rows(df, [key], text, fn, f"row {df.schema[key].dataType.simpleString()}, term string, pos int, n bigint")
    return flat.groupBy("term").agg(F.sum("n").alias("count"), F.min(F.struct("row", "pos")).alias("first"))


def in_space(df: DataFrame, key: str, text: str, space: list[tuple[str, int]]) -> DataFrame:
    """(key, idx, n) of each key's terms that are in the space, a small list of (term, idx)."""
    names, idx = pa.array([t for t, _ in space], pa.string()), np.array([i for _, i in space], np.int64)

    def fn(t: Tokens, _):
        row, code, cnt = t.counted()
        at = pc.index_in(t.terms, value_set=names).fill_null(-1).to_numpy(zero_copy_only=False)[code]
        row, at, cnt = row[at >= 0], at[at >= 0], cnt[at >= 0]
        yield row, pa.array(idx[at].astype(np.int32)), pa.array(cnt)

    return _merged(df, key, lambda rows: by_rows(rows, [key], text, fn, ", ".join([*_kinds(df, [key]), "idx int, n bigint"])), "n")


def vectors(df: DataFrame, columns: list[str], text: str, space: list[tuple[str, int]], low: int = 1, high: int = 1, presence: bool = True, dense: bool = True, name: str = "x") -> DataFrame:
    """columns of every row and its counts (or presence) over the space of n-grams: as a vector, or else as (i, v) of those that are not zero."""
    size, places = max((i for _, i in space), default=-1) + 1, _Space(space, low, high)

    def fn(t: Tokens, _):
        row, to = places.find(t)
        row, to, cnt = t.counted(to, row)
        value = np.ones(len(cnt)) if presence else cnt.astype(np.float64)
        rows = np.arange(t.rows)
        if dense:
            m = np.zeros((t.rows, size))
            m[row, to] = value
            yield rows, pa.ListArray.from_arrays(pa.array(np.arange(t.rows + 1) * size, pa.int32()), pa.array(m.ravel()))
        else:
            ends = pa.array(np.searchsorted(row, np.arange(t.rows + 1)), pa.int32())
            yield rows, pa.ListArray.from_arrays(ends, pa.array(to.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(value))

    made = f"{name} array<double>" if dense else "i array<int>, v array<double>"
    return by_rows(df, columns, text, fn, ", ".join([*_kinds(df, columns), made]))


def class_counts(df: DataFrame, label: str, classes: list, text: str) -> DataFrame:
    """(term, s0, s1 ...): how often each term occurs in the texts of each of a few classes, null where it doesn't. Terms of other classes are kept."""

    def fn(t: Tokens, columns):
        known = columns[0].dictionary_encode()
        own = known.indices.fill_null(len(known.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
        of, code, cnt = t.counted(row=own[t.row])
        yield None, known.dictionary.take(pa.array(of, mask=of == len(known.dictionary))), t.terms.take(pa.array(code)), pa.array(cnt.astype(np.float64))

    flat = by_rows(df, [label], text, fn, f"class {df.schema[label].dataType.simpleString()}, term string, n double")
    return flat.groupBy("term").agg(*[F.sum(F.when(F.col("class") == c, F.col("n"))).alias(f"s{k}") for k, c in enumerate(classes)])


def _weights(names: pa.Array) -> Callable[[Tokens], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of tokens: rows, codes, counts, and the place of the code's term among names, or -1."""

    def of(t: Tokens):
        row, code, cnt = t.counted()
        return row, code, cnt, pc.index_in(t.terms, value_set=names).fill_null(-1).to_numpy(zero_copy_only=False)[code]

    return of


#: Commonest terms whose weights or numbers are in every task; the others are joined.
COMMON = 1 << 16


def weighted_sums(df: DataFrame, key: str, text: str, weights: DataFrame, names: list[str], by: Column, common: int | None = None) -> DataFrame:
    """(key, names ...): for every key, the weights (term, names ...) of its terms times their counts. Terms without weights count for nothing.

    Only the terms that aren't among the common ones, those with the largest by, are shuffled.
    """
    known = weights.orderBy(by.desc()).limit(COMMON if common is None else common).select("term", *names).toArrow().combine_chunks()
    held = known.column("term").combine_chunks().cast(pa.string())
    w = np.stack([known.column(c).to_numpy() for c in names], axis=1)
    find = _weights(held)

    def near(t: Tokens, _):
        row, _, cnt, at = find(t)
        some = at >= 0
        row, part = row[some], w[at[some]] * cnt[some, None]
        yield np.arange(t.rows), *[pa.array(np.bincount(row, part[:, c], t.rows)) for c in range(len(names))]

    def far(t: Tokens, _):
        row, code, cnt, at = find(t)
        yield row[at < 0], t.terms.take(pa.array(code[at < 0])), pa.array(cnt[at < 0])

    kinds = _kinds(df, [key])
    some = by_rows(df, [key], text, near, ", ".join([*kinds, *[f"{c} double" for c in names]]))
    rest = by_rows(df, [key], text, far, ", ".join([*kinds, "term string, n bigint"])).join(weights.select("term", *names), "term")
    both = some.unionByName(rest.select(key, *[(F.col("n") * F.col(c)).alias(c) for c in names]))
    return both.groupBy(key).agg(*[F.sum(c).alias(c) for c in names])


def word_counts(df: DataFrame, own: str, text: str) -> DataFrame:
    """(word, all, count): how often each word occurs, and how often in the rows of which own holds."""

    def fn(t: Tokens, columns):
        mine = columns[0].fill_null(False).to_numpy(zero_copy_only=False)[t.row]
        size = len(t.terms)
        yield None, t.terms, pa.array(np.bincount(t.code, minlength=size)), pa.array(np.bincount(t.code[mine], minlength=size))

    return by_rows(df, [own], text, fn, "word string, all bigint, count bigint").groupBy("word").agg(F.sum("all").alias("all"), F.sum("count").alias("count"))


def encode(df: DataFrame, key: str, text: str, known: list[tuple[str, int]], ranks: DataFrame) -> DataFrame:
    """(key, pos, idx) of every word: those of known, a small list of (word, idx), at once, the others by a join with ranks (word, idx), -1 where they have none."""
    names, idx = pa.array([t for t, _ in known], pa.string()), np.array([i for _, i in known], np.int32)

    def parts(t: Tokens):
        at = pc.index_in(t.terms, value_set=names).fill_null(-1).to_numpy(zero_copy_only=False)[t.code]
        return at, at >= 0

    def near(t: Tokens, _):
        at, some = parts(t)
        yield t.row[some], pa.array(t.pos[some].astype(np.int32)), pa.array(idx[at[some]])

    def far(t: Tokens, _):
        _, some = parts(t)
        yield t.row[~some], pa.array(t.pos[~some].astype(np.int32)), t.terms.take(pa.array(t.code[~some]))

    kinds = _kinds(df, [key])
    found = by_rows(df, [key], text, near, ", ".join([*kinds, "pos int, idx int"]))
    rest = by_rows(df, [key], text, far, ", ".join([*kinds, "pos int, word string"])).join(ranks.select("word", "idx"), "word", "left")
    return found.unionByName(rest.select(key, "pos", F.coalesce("idx", F.lit(-1)).alias("idx")))


#: Ties beyond the size of a space that are looked at on the driver.
TIES = 10_000


def most_common(df: DataFrame, key: str, text: str, size: int, low: int = 1, high: int = 1) -> list[tuple[str, int]]:
    """(term, idx) of the size n-grams that occur most, of equally frequent ones the latest to appear first, as sparse.most_common() of seen().

    Terms are added up by numbers alone, which takes no sort; where in its row a term appears first is found for the candidates, in their rows.
    """

    def fn(t: Tokens, columns):
        rank = np.empty(t.rows, np.int64)
        rank[pc.sort_indices(pa.table({"k": columns[0]}), sort_keys=[("k", "ascending")], null_placement="at_end").to_numpy()] = np.arange(t.rows)
        for g, _ in _orders(t, low, high):
            at = np.argsort(rank[g.row], kind="stable") if (np.diff(rank) < 0).any() else np.arange(len(g.row))
            code, first, cnt = _distinct(g.code[at].astype(np.int64))
            yield g.row[at[first]], g.terms.take(pa.array(code)), pa.array(cnt)

    flat = by_rows(df, [key], text, fn, f"row {df.schema[key].dataType.simpleString()}, term string, n bigint")
    counts = flat.groupBy("term").agg(F.sum("n").alias("n"), F.min("row").alias("row"))
    top = counts.orderBy(F.desc("n"), F.desc_nulls_last("row")).limit(size + TIES).collect() if size else []
    at = lambda r: (r.n, r.row is not None, r.row if r.row is not None else 0)
    if len(top) == size + TIES and at(top[-1]) == at(top[size - 1]):
        first = seen(df, key, text, low, high).orderBy(F.desc("count"), F.desc("first"), "term").limit(size).collect()
        return [(r.term, i) for i, r in enumerate(first)]
    some = [r for r in top if at(r) >= at(top[min(size, len(top)) - 1])]
    rows = {r.row for r in some}
    held = F.col(key).isin([r for r in rows if r is not None])
    found = seen(df.where(held | F.col(key).isNull() if None in rows else held), key, text, low, high).where(F.col("term").isin([r.term for r in some])).collect() if some else []
    pos = {r.term: r.first.pos for r in found}
    best = sorted(sorted(some, key=lambda r: r.term), key=lambda r: (*at(r), pos[r.term]), reverse=True)
    return [(r.term, i) for i, r in enumerate(best[:size])]
