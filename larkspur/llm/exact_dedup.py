"""Exact deduplication by distributed most-significant-digit radix partitioning.

Documents are split by successive digits of their bytes until every group
is a single document or its texts have ended. The byte length belongs to the
first digit, so that all members of a group end together; later digits are
wider than earlier ones, which keeps the number of rounds logarithmic in
the longest text. Only groups of two or more enter the next round, with
the bytes that are left. Equality is decided by the bytes alone.

Nulls: a null text equals no other, so its row stays and belongs to no group;
a null doc_id orders after all others. Empty texts equal each other. Of a
group, the row of the smallest doc_id stays (of rows that share it, any one:
they are repeated rows). An empty table gives an empty result. Columns
besides doc_id and text pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import Scratch, free_name

#: Width in bytes of the first digit; each later digit is GROWTH times as wide.
FIRST_BYTES, GROWTH = 16, 16


def _levels(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame, tuple[str, str]]:
    """Keys of first digits that several rows share; the rows that have them, numbered; row -> group."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "radix")
    size, head, rid = (free_name(docs, c) for c in ("radix_len", "radix_head", "radix_row"))
    keyed = (
        docs.withColumn(size, F.octet_length(text_col))
        .withColumn(head, F.substring(F.col(text_col).cast("binary"), 1, FIRST_BYTES))
    )
    shared = scratch.write(
        keyed.where(F.col(size).isNotNull()).groupBy(size, head).count().where("count > 1").select(size, head)
    )
    rows = scratch.write(
        keyed.join(shared, [size, head], "left_semi").withColumn(rid, F.monotonically_increasing_id())
    )
    tail = F.substring(F.col(text_col).cast("binary"), FIRST_BYTES + 1, 2**31 - 1)
    state = rows.select(
        F.col(rid).alias("rid"), F.col(id_col).alias("doc"), F.col(size).alias("len"),
        F.col(head).alias("digit"), tail.alias("rest"), F.lit(0).cast("long").alias("gid"),
    )
    at, width, ended = FIRST_BYTES, FIRST_BYTES * GROWTH, []
    while True:
        # One round: rows of the same group and digit stay together; single ones leave.
        key = ["gid", "len", "digit"]
        groups = state.groupBy(*key).agg(F.min("rid").alias("next"), F.count("*").alias("n")).where("n > 1")
        split = scratch.write(
            state.join(groups.drop("n"), key).select(
                "rid", "doc", "len", F.col("next").alias("gid"),
                F.expr(f"substring(rest, 1, {width})").alias("digit"),
                F.expr(f"substring(rest, {width + 1})").alias("rest"),
            )
        )
        ended.append(split.where(F.col("len") <= at).select("rid", "doc", "gid"))
        state, at, width = split.where(F.col("len") > at), at + width, width * GROWTH
        if state.isEmpty():
            break
    groups = ended[0]
    for more in ended[1:]:
        groups = groups.union(more)
    return shared, rows, groups, (size, head)


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, copies) of every row whose text occurs in two rows or more."""
    _, _, members, _ = _levels(docs, id_col, text_col)
    groups = members.groupBy("gid").agg(F.min("doc").alias("keep_id"), F.count("*").alias("copies"))
    return members.join(groups, "gid").select(F.col("doc").alias(id_col), "keep_id", "copies")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but one row of each group of equal texts."""
    shared, rows, members, (size, head) = _levels(docs, id_col, text_col)
    rid = rows.columns[-1]
    # The first of each group stays: the smallest (doc_id, row), nulls last.
    first = members.groupBy("gid").agg(
        F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "rid")).getField("rid").alias("kept")
    )
    lost = members.join(first, "gid").where("rid <> kept").select(F.col("rid").alias(rid))
    keyed = docs.withColumn(size, F.octet_length(text_col)).withColumn(
        head, F.substring(F.col(text_col).cast("binary"), 1, FIRST_BYTES)
    )
    alone = keyed.join(shared, [size, head], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    chosen = rows.join(lost, rid, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    return alone.union(chosen)
