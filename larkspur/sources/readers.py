"""Sources: dense CSV, JSON reviews, class folders of texts, binary pixels, tars of images, row-labelled features."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def dense_csv(spark: SparkSession, path: str) -> DataFrame:
    """(features) of lines of numbers between commas; a malformed number is an error."""
    return spark.read.text(path).select(F.transform(F.split("value", ","), lambda x: F.trim(x).cast("double")).alias("features"))


def reviews(spark: SparkSession, path: str, threshold: float) -> DataFrame:
    """(label, text) of JSON reviews, 1 from the threshold up."""
    rows = spark.read.schema("overall double, reviewText string").json(path)
    return rows.select((F.col("overall") >= threshold).cast("int").alias("label"), F.col("reviewText").alias("text"))


def class_folders(spark: SparkSession, root: str, classes: list[str]) -> DataFrame:
    """(label, text) of whole files in one folder for each class, the label being the folder's place in classes."""
    rows = spark.read.text([f"{root}/{c}" for c in classes], wholetext=True).select(F.element_at(F.split("_metadata.file_path", "/"), -2).alias("folder"), F.col("value").alias("text"))
    label = F.array_position(F.array(*[F.lit(c) for c in classes]), F.url_decode("folder")) - 1
    return rows.select(label.cast("int").alias("label"), "text")


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "text")


def binary_records(spark: SparkSession, path: str, rows: int = 32, columns: int = 32, channels: int = 3) -> DataFrame:
    """(label, image) of fixed-width records: a label byte and the pixels plane by plane, each row by row."""
    size = rows * columns * channels

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                raw = np.frombuffer(content.as_py(), np.uint8)
                a = raw[: len(raw) // (size + 1) * (size + 1)].reshape(-1, size + 1)
                # Planes of rows: reorder to the channel-major layout.
                pixels = a[:, 1:].reshape(-1, channels, rows, columns).transpose(0, 3, 2, 1).reshape(len(a), size).astype(np.float64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * size, pa.int32()), pa.array(pixels.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(a[:, 0].astype(np.int32)), lists], names=["label", "data"])

    read = spark.read.format("binaryFile").load(path).select("content").mapInArrow(cut, "label int, data array<double>")
    return read.select("label", F.struct(F.lit(rows).alias("x_dim"), F.lit(columns).alias("y_dim"), F.lit(channels).alias("num_channels"), "data").alias("image"))


def row_labelled(features: DataFrame, labels: DataFrame) -> DataFrame:
    """features (row_id from 0, features) with labels (value: "row label" lines, both from 1): (row_id, label, features)."""
    part = F.split(F.trim("value"), "\\s+")
    pairs = labels.select((part[0].cast("long") - 1).alias("row_id"), (part[1].cast("int") - 1).alias("label"))
    return features.join(pairs, "row_id").select("row_id", "label", "features")


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files of a folder; contents aren't read."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def tar_members(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """(archive, name, content) of the files in tar archives whose names begin with prefix; one archive is opened at a time."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, content in zip(b.column(0), b.column(1)):
                with tarfile.open(fileobj=io.BytesIO(content.as_py())) as tar:
                    for m in tar:
                        if m.isfile() and m.name.startswith(prefix):
                            data = tar.extractfile(m)
                            yield pa.RecordBatch.from_arrays([pa.array([at.as_py()]), pa.array([m.name]), pa.array([data.read() if data else b""], pa.binary())], names=["archive", "name", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(expand, "archive string, name string, content binary")


def class_labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members with the label of their first folder; labels has lines "class label". A member without one is dropped."""
    part = F.split(F.trim("value"), "\\s+")
    pairs = labels.select(part[0].alias("folder"), part[1].cast("int").alias("label"))
    return members.withColumn("folder", F.split("name", "/")[0]).join(pairs, "folder").select("name", "label", "content")


def multi_labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members with an array of labels from CSV lines under a header: the file name, in quotes, is column 4, the label from 1 column 1."""
    part = F.split("value", ",")
    pairs = labels.select(F.regexp_replace(part[4], '"', "").alias("file"), F.expr("try_cast(split(value, ',')[1] as int)").alias("label")).where("label is not null")
    grouped = pairs.groupBy("file").agg(F.sort_array(F.collect_set(F.col("label") - 1)).alias("labels"))
    return members.withColumn("file", F.element_at(F.split("name", "/"), -1)).join(grouped, "file").select("name", "labels", "content")


def matrix_csv(path: str) -> np.ndarray:
    """A small matrix of a model, read on the driver."""
    return np.loadtxt(path, delimiter=",", ndmin=2)
