"""Secret scan by token efficiency.

Strings of MIN_CHARS or more of the characters of keys, tokens and passwords are
candidates. A byte-pair vocabulary compresses words and names into few tokens and
random strings hardly at all, so a candidate with few characters per token is
reported, unless it is a known digest (it stands after the name of a digest,
or is among those given) or an identifier (UUIDs, numbers, names made of
words and small numbers; letters count as words if the vocabulary has few tokens for them).

Texts without a candidate never leave the JVM. Nulls and empty texts have no
candidates; texts are scanned whole, very long ones and very long strings too; every occurrence in every row is reported, so
repeated rows repeat. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vocabulary in tiktoken's format. A path that all executors can read.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splits text before byte-pair merging, as this vocabulary was made.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MIN_CHARS = 20
#: Report below so many characters a token.
MAX_RATIO = 2.4

_ALPHABET = "A-Za-z0-9+/=_-"
_CANDIDATE = re.compile(f"(?<![{_ALPHABET}])[{_ALPHABET}]{{{MIN_CHARS},}}")
_DIGEST_NAME = re.compile(r"(?:md5|sha-?\d{0,3}|sha[123]sum|digest|checksum|etag|commit|integrity|fingerprint|blake2[bs]?|crc)\W{0,4}$", re.I)
_DIGEST = re.compile(r"(?:(?:md5|sha\d{1,3})-)?(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}|[A-Za-z0-9+/]{43}=|[A-Za-z0-9+/]{86}==)")
_UUID = re.compile(r"\{?[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}\}?")
_PART = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{2,}|\d{1,4}|\d{6,}|[A-Za-z]")


@cache
def encoding(path: str = VOCABULARY):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("scan", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def identifier(s: str, path: str = VOCABULARY, max_ratio: float = MAX_RATIO) -> bool:
    """A UUID, a number, or parts between separators that are all words or numbers, at most one in four being a single letter.

    The ratio decides what a word is: a part is one if it is one token or has max_ratio characters per token
    or more. At most a quarter of the letters may be in parts that are none, and all letters together must reach max_ratio.
    """
    if _UUID.fullmatch(s) or not re.search("[A-Za-z]", s):
        return True
    parts, singles, letters = 0, 0, []
    for piece in re.split("[-+/=_]+", s.strip("-+/=_")):
        found = _PART.findall(piece)
        if "".join(found) != piece:
            return False
        # Letters and numbers that change places within one piece are no name.
        if sum(x.isdigit() for x in found) > 1:
            return False
        parts, singles = parts + len(found), singles + sum(len(x) == 1 and x.isalpha() for x in found)
        letters += [x for x in found if x.isalpha()]
    if singles * 4 > parts:
        return False
    encode = encoding(path).encode_ordinary
    # A word has its token after a space and in lower case, as a rule.
    n = [min(len(encode(x)), len(encode(" " + x.lower()))) for x in letters]
    total = sum(map(len, letters))
    odd = sum(len(x) for x, k in zip(letters, n) if k > 1 and len(x) < max_ratio * k)
    return odd * 4 <= total and total >= max_ratio * sum(n)


def scan(text: str, path: str = VOCABULARY, max_ratio: float = MAX_RATIO) -> list[tuple[int, str, int]]:
    """Start, string and tokens of every secret of text."""
    found = []
    for m in _CANDIDATE.finditer(text):
        s = m.group(0)
        # A key written as name=value, or the words before it, are no part of the value.
        name, eq, value = s.partition("=")
        start = m.start()
        if eq and len(value.strip("=")) >= MIN_CHARS:
            start, s = start + len(name) + 1, value
        if _DIGEST.fullmatch(s) and _DIGEST_NAME.search(text, max(0, start - 24), start):
            continue
        if identifier(s, path, max_ratio):
            continue
        n = len(encoding(path).encode_ordinary(s))
        if len(s) < max_ratio * n:
            found.append((start, s, n))
    return found


def secrets(docs: DataFrame, path: str = VOCABULARY, max_ratio: float = MAX_RATIO, known_digests: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, value, n_tokens) of every secret; known_digests: a column of strings that are not to be reported."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(i, *x) for i, t in enumerate(batch.column(1)) for x in scan(t.as_py(), path, max_ratio)]
            at, start, value, n = (list(x) for x in zip(*out)) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(start, pa.int64()), pa.array(value, pa.string()), pa.array(n, pa.int64())],
                names=["doc", "start", "value", "n_tokens"],
            )

    some = docs.where(F.col(text_col).rlike(f"[{_ALPHABET}]{{{MIN_CHARS}}}")).select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    found = some.mapInArrow(run, f"doc {kind}, start long, value string, n_tokens long")
    if known_digests is not None:
        found = found.join(known_digests.select(F.col(known_digests.columns[0]).alias("value")), "value", "left_anti").select("doc", "start", "value", "n_tokens")
    return found.withColumnRenamed("doc", id_col)
