"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents, extra ones and those of any name with them.

Null and empty texts have no content, so the first stage rejects them; a null doc_id or source is kept and orders last
or is a source of its own. Very long texts are worked on whole in every stage. Rows that are equal in text, the doc_id being
the same or not, are copies, of which the second stage keeps one. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import exact_dedup, mixing, packing, quality, simhash
from larkspur.llm.common import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose content lines have half of the characters or more; a null, empty or blank text goes."""
    return quality.keep_content(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows of equal text the one of the smallest doc_id; null texts equal nothing and stay."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the row of the smallest doc_id; texts without words stay."""
    return simhash.drop_near_duplicates(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, in files that follow each other in the order of the mix's slots; rows of one slot by doc_id."""
    mixed = mixing.mix(docs)
    # The last two columns are those that mix adds; the files are in the order of the slots.
    return mixed.orderBy(mixed.columns[-1], F.col("doc_id").asc_nulls_last()).select(*[F.col(f"`{c}`") for c in docs.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each row lies, shard after shard in the order of the mix; docs must be read from files."""
    return packing.pack(docs, in_order=True)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_duplicates),
    ("simhash near dedup", near_duplicates),
    ("source mixing", source_mixing),
    ("best-fit packing", best_fit_packing),
]

#: None: SQL can't express the fingerprints and anchors of the third stage nor the packing of the fifth.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
