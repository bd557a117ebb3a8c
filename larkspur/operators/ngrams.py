"""N-gram counts, word ranks and the stupid-backoff language model.

Arrays are exploded as outer ones and empty ones dropped afterwards: for a plain
explode the optimizer puts a filter on the array's size below it, which
would compute the array, here whole tokenizations, once more. Null elements count for nothing.
"""

from __future__ import annotations

from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators.numbering import number


def counts(df: DataFrame, grams: Column, add: bool = True) -> DataFrame:
    """(ngram, count) of an array of n-grams; without add, those of each partition by itself, and nothing is shuffled.

    A partition's n-grams are sorted for that by Spark, which spills what it can't hold, and their runs counted.
    """
    flat = df.select(F.explode_outer(grams).alias("ngram")).where("ngram IS NOT NULL")
    if add:
        return flat.groupBy("ngram").agg(F.count("*").alias("count"))

    def part(batches):
        """Runs of equal n-grams; the last one may go on in the next batch."""
        last, n = None, 0
        for b in batches:
            grams, many = [], []
            for g, run in groupby(b.column(0).to_pylist()):
                size = sum(1 for _ in run)
                if n and g == last:
                    n += size
                    continue
                if n:
                    grams.append(last)
                    many.append(n)
                last, n = g, size
            if grams:
                yield pa.RecordBatch.from_arrays([pa.array(grams, kind), pa.array(many, pa.int64())], names=["ngram", "count"])
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([last], kind), pa.array([n], pa.int64())], names=["ngram", "count"])

    element = flat.schema["ngram"].dataType.elementType.simpleString()
    kind = pa.list_({"string": pa.string(), "int": pa.int32()}.get(element, pa.int64()))
    return flat.sortWithinPartitions("ngram").mapInArrow(part, f"ngram array<{element}>, count long")


def initial_bigram_partition(ngram: Column, n: int) -> Column:
    """Partition of an n-gram by its first two words, so that it lies with its contexts; 0 for fewer than two."""
    two = F.xxhash64(F.get(ngram, F.lit(0)), F.get(ngram, F.lit(1)))
    return F.when(F.size(ngram) > 1, F.pmod(two, F.lit(n))).otherwise(0).cast("int")


def context(ngram: Column) -> Column:
    """Without the last word."""
    return F.slice(ngram, F.lit(1), F.greatest(F.size(ngram) - 1, F.lit(0)))


def backoff(ngram: Column) -> Column:
    """Without the first word."""
    return F.slice(ngram, F.lit(2), F.greatest(F.size(ngram) - 1, F.lit(0)))


def word_at(ngram: Column, k: int) -> Column:
    return F.get(ngram, F.lit(k))


def ranked(counts: DataFrame) -> DataFrame:
    """(word, idx, count) from (word, count), numbered as by word_ranks()."""
    return number(counts, [-F.col("count"), F.substring("word", 1, 2)], [F.col("word")]).select("word", "idx", "count")


def word_ranks(df: DataFrame, words: Column) -> DataFrame:
    """(word, idx, count): rank by descending count, ties by word; 0 is the most frequent.

    Words are numbered by buckets of equal count and initial letters.
    """
    count = df.select(F.explode_outer(words).alias("word")).where("word IS NOT NULL").groupBy("word").agg(F.count("*").alias("count"))
    return ranked(count)


def encode(df: DataFrame, key: str, words: Column, ranks: DataFrame) -> DataFrame:
    """(key, pos, idx) of every word, -1 where it has no rank."""
    flat = df.select(key, F.posexplode_outer(words).alias("pos", "word")).where("word IS NOT NULL")
    return flat.join(ranks.select("word", "idx"), "word", "left").select(key, "pos", F.coalesce("idx", F.lit(-1)).alias("idx"))


def backoff_scores(ngram_counts: DataFrame, unigrams: DataFrame) -> DataFrame:
    """(ngram, score) of observed n-grams of two words or more: count over that of the n-gram without its last word.

    ngram_counts: (ngram, count) of all orders from 2; unigrams: (word, count).
    """
    contexts = ngram_counts.union(unigrams.select(F.array("word"), "count")).select(F.col("ngram").alias("context"), F.col("count").alias("of"))
    n = F.size("ngram")
    return (
        ngram_counts.where(n >= 2).withColumn("context", context(F.col("ngram")))
        .join(contexts, "context", "left").select("ngram", (F.col("count") / F.col("of")).alias("score"))
    )


def backoff_query(asked: DataFrame, scores: DataFrame, unigrams: DataFrame, order: int, alpha: float = 0.4) -> DataFrame:
    """(ngram, score) of any n-grams of up to order words: of the longest observed suffix, times alpha for each word dropped."""
    total = unigrams.agg(F.sum("count").alias("total"))
    one = unigrams.crossJoin(F.broadcast(total)).select(F.array("word").alias("ngram"), (F.col("count") / F.col("total")).alias("score"))  # one row
    known = scores.unionByName(one).select(F.col("ngram").alias("suffix"), F.col("score").alias("found"))
    tried = asked.select("ngram").distinct().withColumn("drop", F.explode(F.sequence(F.lit(0), F.size("ngram") - 1))).withColumn(
        "suffix", F.slice("ngram", F.col("drop") + 1, F.size("ngram") - F.col("drop"))
    )
    best = tried.join(known, "suffix").groupBy("ngram").agg(F.min(F.struct("drop", "found")).alias("b"))
    return asked.select("ngram").distinct().join(best, "ngram", "left").select(
        "ngram", F.coalesce(F.col("b.found") * F.pow(F.lit(float(alpha)), F.col("b.drop")), F.lit(0.0)).alias("score")
    )
