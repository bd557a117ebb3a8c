"""Quality rules: a linear-chain CRF marks each line as content or boilerplate.

A document is the sequence of its lines (cut at line feeds). Each line has
binary features drawn from counts of its characters and words; a CRF
with two states scores a line's state by its features and neighbouring
lines by a reward for staying in the same state. Viterbi decoding finds the best
sequence exactly, for all documents of a batch side by side. The share
of non-blank characters in content lines decides whether the document stays.

Weights are whole numbers, so decoding is exact and the same in SQL. WEIGHTS
were trained by fit() on labelled documents; fit() takes at most max_docs
of them and is the way to train others.

Nulls and empty texts have no content: share 0, rejected. Equal scores are
decided for content. Rows are judged one by one, so ties and repeated rows need
nothing; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import raw_text, slices, span_hashes, words

SYMBOLS = "|#$%&*!<>{}=_~^@\\/+[]"
ENDS = ".!?:;)\"'"
FEATURES = ["bias", "symbols_2pct", "symbols_10pct", "upper_half", "short_20", "short_40", "no_end", "repeats", "digits_20pct"]
#: Score of boilerplate over content, in hundredths, by feature; STAY: reward for the state of the line before; START: of boilerplate in the first line.
WEIGHTS = {"bias": -226, "symbols_2pct": 347, "symbols_10pct": 144, "upper_half": 67, "short_20": 56, "short_40": 68, "no_end": 209, "repeats": 288, "digits_20pct": -19}
STAY, START = 100, -30
#: A document stays if at least this share of its characters is in content lines.
MIN_SHARE = 0.5

_B = np.arange(256)
_LEAD = (_B < 0x80) | (_B >= 0xC0)
_LETTER = np.array([chr(b).isalpha() if b < 128 else b >= 0xC0 for b in _B])
_UPPER = (_B >= 65) & (_B <= 90)
_DIGIT = (_B >= 48) & (_B <= 57)
_SYMBOL = np.isin(_B, [ord(c) for c in SYMBOLS])
_SPACE = np.isin(_B, [9, 10, 11, 12, 13, 32])
_WORD = ~np.isin(_B, [10, 32])


def lines_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines of all rows (an empty row has one empty line), and the first line of each row."""
    feeds = np.flatnonzero(raw == 10)
    starts = np.sort(np.concatenate((offsets[:-1], feeds + 1)), kind="stable")
    ends = np.sort(np.concatenate((feeds, offsets[1:])), kind="stable")
    count = np.searchsorted(feeds, offsets[1:]) - np.searchsorted(feeds, offsets[:-1]) + 1
    return starts, ends, np.concatenate(([0], np.cumsum(count)))


def features(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature matrix (lines x FEATURES, 0 or 1; all 0 for blank lines) and the non-blank characters of each line."""

    def count(table: np.ndarray) -> np.ndarray:
        total = np.zeros(len(raw) + 1, np.int32)
        np.cumsum(table[raw], out=total[1:])
        return (total[ends] - total[starts]).astype(np.int64)

    size, solid = count(_LEAD), count(_LEAD & ~_SPACE)
    letters, upper, digits, symbols = count(_LETTER), count(_UPPER), count(_DIGIT), count(_SYMBOL)
    n = len(starts)
    last = np.zeros(n, np.uint8)
    full = ends > starts
    last[full] = raw[ends[full] - 1]
    begin, end, line = words(raw, starts, _WORD)
    if len(begin):
        h = span_hashes(raw, begin, end)
        same = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
        again = np.bincount(line[1:][same], minlength=n)
        many = np.bincount(line, minlength=n)
    else:
        again = many = np.zeros(n, np.int64)
    f = np.stack([
        np.ones(n, bool), symbols * 50 >= size, symbols * 10 >= size, upper * 2 >= np.maximum(letters, 1),
        size < 20, size < 40, ~np.isin(last, [ord(c) for c in ENDS]), again * 4 >= np.maximum(many, 1), digits * 5 >= size,
    ], axis=1)
    f[solid == 0] = False
    return f, solid


def decode(score: np.ndarray, first: np.ndarray, stay: int = STAY, start: int = START) -> np.ndarray:
    """Viterbi: state of each line (1 boilerplate) given boilerplate's scores over content and the first line of each row."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    back = np.zeros((len(score), 2), np.int8)
    content, boiler = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
    steps = int(size.max(initial=0))
    active = np.searchsorted(-size[order], -np.arange(steps), side="left")
    for t in range(steps):
        rows = order[: active[t]]
        at = first[rows] + t
        if t == 0:
            content[rows], boiler[rows] = 0, start + score[at]
            continue
        c, b = content[rows], boiler[rows]
        back[at, 0], back[at, 1] = b > c + stay, b + stay > c
        content[rows], boiler[rows] = np.maximum(c + stay, b), np.maximum(b + stay, c) + score[at]
    state = np.zeros(len(score), np.int8)
    for t in range(steps - 1, -1, -1):
        rows = order[: active[t]]
        at = first[rows] + t
        ends_here = size[rows] == t + 1
        nxt = np.minimum(at + 1, len(score) - 1)
        state[at] = np.where(ends_here, boiler[rows] > content[rows], back[nxt, state[nxt]])
    return state


def judge(raw: np.ndarray, offsets: np.ndarray, weights: dict[str, int] | None = None, stay: int = STAY, start: int = START) -> np.ndarray:
    """Per row: lines, content lines, non-blank characters, those in content lines."""
    w = np.array([(weights or WEIGHTS)[k] for k in FEATURES], np.int64)
    out = np.zeros((len(offsets) - 1, 4), np.int64)
    for a, b in slices(offsets, 1_000_000):
        part = raw[offsets[a] : offsets[b]]
        starts, ends, first = lines_of(part, offsets[a : b + 1] - offsets[a])
        f, solid = features(part, starts, ends)
        good = decode(f.astype(np.int64) @ w, first, stay, start) == 0
        out[a:b, 0] = np.diff(first)
        for k, x in enumerate((good, solid, solid * good), 1):
            out[a:b, k] = np.add.reduceat(x.astype(np.int64), first[:-1])
    return out


def quality(text: Column, weights: dict[str, int] | None = None, stay: int = STAY, start: int = START) -> Column:
    """Struct of lines, content_lines, chars, content_chars of a text column."""

    @F.arrow_udf("struct<n_lines:long,content_lines:long,chars:long,content_chars:long>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in batches:
            m = judge(*raw_text(x), weights, stay, start)
            yield pa.StructArray.from_arrays([pa.array(m[:, k]) for k in range(4)], ["n_lines", "content_lines", "chars", "content_chars"])

    return run(text)


def _kept(q: str, least: float) -> Column:
    """In whole numbers, so that a share at the bound is decided alike everywhere."""
    return (F.col(f"{q}.chars") > 0) & (F.col(f"{q}.content_chars") * 1000 >= F.col(f"{q}.chars") * int(least * 1000))


def judge_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_share: float = MIN_SHARE, **crf) -> DataFrame:
    """(doc_id, n_lines, content_lines, chars, content_chars, keep) of every row."""
    return docs.select(F.col(id_col), quality(F.col(text_col), **crf).alias("q")).select(id_col, "q.*", _kept("q", min_share).alias("keep"))


def keep_content(docs: DataFrame, text_col: str = "text", min_share: float = MIN_SHARE, **crf) -> DataFrame:
    """The rows of docs whose content share is min_share at least."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), quality(F.col(text_col), **crf).alias("q"))
    return whole.where(_kept("q", min_share)).select("doc.*")


def fit(labelled: DataFrame, max_docs: int = 5000, text_col: str = "text", label_col: str = "quality", rounds: int = 300, l2: float = 1e-3, max_stay: float = 1.0) -> tuple[dict[str, int], int, int]:
    """(weights, stay, start) of the CRF that makes the labels most likely, the lines of a document taking its label (1 good).

    max_docs bounds the labelled rows that are used, the smallest by hash;
    the gradient is that of the conditional log likelihood, by forward-backward.
    max_stay bounds the reward for staying: labels that are inherited from the
    document never change within it, so unbounded it would swamp the lines.
    """
    rows = (
        labelled.where(F.col(text_col).isNotNull() & F.col(label_col).isNotNull())
        .orderBy(F.xxhash64(text_col), text_col).limit(max_docs).select(text_col, F.col(label_col).cast("int").alias("y")).toArrow()
    )
    raw, offsets = raw_text(rows.column(0))
    starts, ends, first = lines_of(raw, offsets)
    x, _ = features(raw, starts, ends)
    x = x.astype(np.float64)
    size = np.diff(first)
    y = np.repeat(1 - np.array(rows.column(1).to_pylist(), np.float64), size)
    balance = np.where(np.repeat(size, size) > 0, 1 / np.repeat(size, size), 0)
    theta, m, v = np.zeros(x.shape[1] + 2), np.zeros(x.shape[1] + 2), np.zeros(x.shape[1] + 2)
    order = np.argsort(-size, kind="stable")
    steps = int(size.max(initial=0))
    active = np.searchsorted(-size[order], -np.arange(steps), side="left")
    for k in range(rounds):
        w, stay, start = theta[:-2], theta[-2], theta[-1]
        s = x @ w
        fwd, bwd = np.zeros((len(s), 2)), np.zeros((len(s), 2))
        for t in range(steps):
            at = first[order[: active[t]]] + t
            emit = np.stack([np.zeros(len(at)), s[at]], 1)
            if t == 0:
                fwd[at] = emit + [0, start]
            else:
                p = fwd[at - 1]
                fwd[at] = emit + np.stack([np.logaddexp(p[:, 0] + stay, p[:, 1]), np.logaddexp(p[:, 0], p[:, 1] + stay)], 1)
        for t in range(steps - 2, -1, -1):
            at = first[order[: active[t + 1]]] + t
            q = bwd[at + 1] + np.stack([np.zeros(len(at)), s[at + 1]], 1)
            bwd[at] = np.stack([np.logaddexp(q[:, 0] + stay, q[:, 1]), np.logaddexp(q[:, 0], q[:, 1] + stay)], 1)
        z = np.logaddexp(*(fwd + bwd).T)
        prob = np.exp(fwd[:, 1] + bwd[:, 1] - z)
        inner = np.setdiff1d(np.arange(len(s)), first[:-1])
        pair = np.exp(fwd[inner - 1, 0] + stay + bwd[inner, 0] - z[inner]) + np.exp(fwd[inner - 1, 1] + stay + s[inner] + bwd[inner, 1] - z[inner])
        heads = first[:-1]
        grad = np.concatenate((x.T @ ((y - prob) * balance), [((1 - pair) * balance[inner]).sum(), ((y - prob)[heads] * balance[heads]).sum()])) / max(1, len(size)) - l2 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + 0.1 * (m / (1 - 0.9 ** (k + 1))) / (np.sqrt(v / (1 - 0.99 ** (k + 1))) + 1e-8)
        theta[-2] = np.clip(theta[-2], 0, max_stay)
    whole = np.rint(theta * 100).astype(int).tolist()
    return dict(zip(FEATURES, whole[:-2])), whole[-2], whole[-1]
