"""Sparse features in long form: (row, term) -> (row, idx, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.operators.numbering import number


def term_frequency(df: DataFrame, key: str, terms: Column, weight=lambda n: n) -> DataFrame:
    """(key, term, weight) of each row's distinct terms, the weight being a function of the count."""
    flat = df.select(key, F.explode_outer(terms).alias("term")).where("term IS NOT NULL").groupBy(key, "term").agg(F.count("*").alias("n"))
    return flat.select(key, "term", weight(F.col("n")).cast("double").alias("weight"))


def _seen(df: DataFrame, key: str, terms: Column) -> DataFrame:
    flat = df.select(F.col(key).alias("row"), F.posexplode_outer(terms).alias("pos", "term")).where("term IS NOT NULL")
    return flat.groupBy("term").agg(F.count("*").alias("count"), F.min(F.struct("row", "pos")).alias("first"))


def all_features(df: DataFrame, key: str, terms: Column) -> DataFrame:
    """(term, idx) of every term, in the order of first appearance."""
    return in_order(_seen(df, key, terms))


def in_order(seen: DataFrame) -> DataFrame:
    """all_features() from (term, count, first)."""
    return number(seen, [F.floor(F.col("first.row") / 4096)], [F.col("first"), F.col("term")]).select("term", "idx")


def common_features(df: DataFrame, key: str, terms: Column, size: int, tie: str = "latest") -> DataFrame:
    """(term, idx) of the size terms that occur most; of equally frequent ones the latest (or earliest) to appear first."""
    return most_common(_seen(df, key, terms), size, tie)


def most_common(seen: DataFrame, size: int, tie: str = "latest") -> DataFrame:
    """common_features() from (term, count, first)."""
    first = F.col("first").desc() if tie == "latest" else F.col("first").asc()
    top = seen.orderBy(F.desc("count"), first, "term").limit(size)
    return top.select("term", (F.row_number().over(W.orderBy(F.desc("count"), first, "term")) - 1).alias("idx"))


def vectorize(df: DataFrame, key: str, weighted: Column, space: DataFrame) -> DataFrame:
    """(key, idx, value) of (term, weight) pairs; terms that the space lacks are dropped."""
    flat = df.select(key, F.explode(weighted).alias("t")).select(key, F.col("t.term").alias("term"), F.col("t.weight").alias("value"))
    return in_space(flat, space).select(key, "idx", "value")


#: Terms of a space that are broadcast; a larger one is joined by shuffling.
BROADCAST_TERMS = 1_000_000


def in_space(entries: DataFrame, space: DataFrame, size: int | None = None) -> DataFrame:
    """entries (term ...) whose term is in the space, with its idx; size: a bound of the space that is known."""
    return entries.join(F.broadcast(space) if size is not None and size <= BROADCAST_TERMS else space, "term")


def hashing_counts(df: DataFrame, key: str, buckets: Column) -> DataFrame:
    """(key, bucket, count) of an array of bucket numbers."""
    return df.select(key, F.explode_outer(buckets).alias("bucket")).where("bucket IS NOT NULL").groupBy(key, "bucket").agg(F.count("*").alias("count"))
