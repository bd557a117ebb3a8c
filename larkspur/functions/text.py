"""Text and n-gram functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII punctuation and white space, written out because engines differ on \\s.
SEPARATORS = r"[!-/:-@\[-`{-~ \t\n\x0B\f\r]+"


def trim(text: Column) -> Column:
    """Without the characters up to U+0020 at both ends."""
    return F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def lower(text: Column) -> Column:
    return F.lower(text)


def tokenize(text: Column, separators: str = SEPARATORS) -> Column:
    """Parts between separators: a leading empty one stays, trailing ones go, the empty text gives one empty token."""
    whole = F.regexp_replace(text, f"(?:{separators})$", "")
    return F.when((whole == "") & (text != ""), F.array().cast("array<string>")).otherwise(F.split(whole, separators))


def ngrams(tokens: Column, low: int, high: int) -> Column:
    """All n-grams of low to high tokens, by start and then by length."""
    if low < 1 or high < low:
        raise ValueError("orders must be consecutive and positive")

    def of(words: Column) -> Column:
        n = F.size(words)
        orders = lambda i: F.filter(F.sequence(F.lit(low), F.lit(high)), lambda o: i + o <= n)
        at = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(orders(i), lambda o: F.slice(words, i + 1, o)))
        return F.when(n > 0, F.flatten(at)).otherwise(F.array().cast("array<array<string>>"))

    return let(tokens, of)


def ngram_strings(tokens: Column, low: int, high: int, between: str = " ") -> Column:
    """For each length from low to high an array of the n-grams, joined to strings: shifted arrays side by side, no array for each n-gram.

    tokens is used several times: let it be a plain column.
    """
    if low < 1 or high < low:
        raise ValueError("orders must be consecutive and positive")
    at, grams = tokens, [tokens]
    for n in range(2, high + 1):
        some = F.size(tokens) >= n
        size = F.when(some, F.size(tokens) - n + 1).otherwise(0)
        at = F.zip_with(F.slice(at, F.lit(1), size), F.slice(tokens, F.lit(n), size), lambda a, b: F.concat(a, F.lit(between), b))
        grams.append(at)
    return F.array(*grams[low - 1 :])


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it inside of a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def java_hash(term: Column) -> Column:
    """hashCode of a Java string, over its UTF-16 units, as a signed 32-bit value in a bigint."""
    mask = F.lit(0xFFFFFFFF).cast("bigint")

    def fold(hexed: Column) -> Column:
        at = F.when(F.length(hexed) > 0, F.sequence(F.lit(0), (F.length(hexed) / 4).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
        unit = lambda i: F.conv(F.substr(hexed, i * 4 + 1, F.lit(4)), 16, 10).cast("bigint")
        return F.aggregate(at, F.lit(0).cast("bigint"), lambda acc, i: (acc * 31 + unit(i)).bitwiseAND(mask))

    return let(let(F.hex(F.encode(term, "UTF-16BE")), fold), lambda h: F.when(h >= 2**31, h - 2**32).otherwise(h))


def hash_bucket(term: Column, buckets: int) -> Column:
    return F.pmod(java_hash(term), F.lit(buckets)).cast("int")


_WORD_BITS = 20
_WORD = (1 << _WORD_BITS) - 1


def pack_ngram(words: Column) -> Column:
    """One to three word ids below 2**20 in one bigint: order less one in bits 60-63, words from bit 40 down."""
    n = F.size(words)
    value = F.lit(0).cast("bigint")
    for k in range(3):
        value = value.bitwiseOR(F.shiftleft(F.coalesce(F.get(words, F.lit(k)).cast("bigint"), F.lit(0).cast("bigint")), 40 - 20 * k))
    bad = ~F.forall(words, lambda w: (w >= 0) & (w <= _WORD)) | ~n.between(1, 3)
    return F.when(bad, F.raise_error(F.lit("one to three words below 2**20"))).otherwise(F.shiftleft((n - 1).cast("bigint"), 60).bitwiseOR(value))


def ngram_order(packed: Column) -> Column:
    return (F.shiftrightunsigned(packed, 60) + 1).cast("int")


def unpack_word(packed: Column, pos: int) -> Column:
    return F.shiftrightunsigned(packed, 40 - 20 * pos).bitwiseAND(F.lit(_WORD).cast("bigint")).cast("int")


def remove_farthest_word(packed: Column) -> Column:
    """Without the first word; of two words or more."""
    n = ngram_order(packed)
    rest = F.shiftleft(packed, 20).bitwiseAND(F.lit((1 << 60) - 1).cast("bigint"))
    return F.shiftleft((n - 2).cast("bigint"), 60).bitwiseOR(rest)


def remove_current_word(packed: Column) -> Column:
    """Without the last word; of two words or more."""
    n = ngram_order(packed)
    two = packed.bitwiseAND(F.lit(_WORD << 40).cast("bigint"))
    three = packed.bitwiseAND(F.lit((_WORD << 40) | (_WORD << 20)).cast("bigint"))
    return F.shiftleft((n - 2).cast("bigint"), 60).bitwiseOR(F.when(n == 2, two).otherwise(three))
