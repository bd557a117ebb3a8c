"""Consecutive numbers over a whole DataFrame without putting it in one partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def number(df: DataFrame, buckets: list[Column], within: list[Column], name: str = "idx") -> DataFrame:
    """df with numbers from 0 in ascending order of buckets, then of within.

    Rows are numbered inside their bucket; only the sizes of the buckets, one row
    each, are summed in one place.
    """
    keys = [f"bucket{k}_" for k in range(len(buckets))]
    flat = df.withColumns(dict(zip(keys, buckets)))
    sizes = flat.groupBy(*keys).agg(F.count("*").alias("size_"))
    before = sizes.withColumn("before_", F.coalesce(F.sum("size_").over(W.orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("size_")
    inside = flat.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*within)))
    return inside.join(before, keys).withColumn(name, (F.col("before_") + F.col(name) - 1).cast("int")).drop("before_", *keys)


def per_partition(df: DataFrame) -> dict[int, int]:
    """Rows of each partition that has some; a row for each partition reaches the driver."""
    return {r.p: r.n for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()}


def map_partitions_with_index(df: DataFrame, fn, schema: str) -> DataFrame:
    """fn(index, batches) over the Arrow batches of each partition."""
    from pyspark import TaskContext

    return df.mapInArrow(lambda batches: fn(TaskContext.get().partitionId(), batches), schema)


def partition_by(df: DataFrame, partition: Column, n: int) -> DataFrame:
    """df in n partitions, rows of one number (0 to n - 1) together and numbers apart, in as far as they hash apart."""
    return df.repartition(n, F.pmod(partition, F.lit(n)))
