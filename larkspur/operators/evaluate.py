"""Evaluation metrics as aggregates over (label, prediction) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    """a / b, NaN where b is 0."""
    return F.when(b == 0, float("nan")).otherwise(a / F.when(b == 0, 1).otherwise(b))


def contingency(df: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """One row (tp, fp, tn, fn) of boolean columns; rows of several add up to that of all."""
    cell = lambda c, name: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(name)
    return df.agg(cell(predicted & actual, "tp"), cell(predicted & ~actual, "fp"), cell(~predicted & ~actual, "tn"), cell(~predicted & actual, "fn"))


def binary_metrics(cells: DataFrame, beta: float = 1.0) -> DataFrame:
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    n, b = tp + fp + tn + fn, beta * beta
    return cells.select(
        "tp", "fp", "tn", "fn", _ratio(tp + tn, n).alias("accuracy"), _ratio(fp + fn, n).alias("error"), _ratio(tp, tp + fn).alias("recall"),
        _ratio(tp, tp + fp).alias("precision"), _ratio(tn, tn + fp).alias("specificity"), _ratio((1 + b) * tp, (1 + b) * tp + b * fn + fp).alias("f_score"),
    )


def confusion(df: DataFrame, predicted: Column, actual: Column, classes: int) -> DataFrame:
    """(actual, predicted, n) of the whole grid."""
    spark = df.sparkSession
    grid = spark.range(classes).select(F.col("id").cast("int").alias("actual")).crossJoin(spark.range(classes).select(F.col("id").cast("int").alias("predicted")))
    n = df.groupBy(actual.cast("int").alias("actual"), predicted.cast("int").alias("predicted")).agg(F.count("*").alias("n"))
    return grid.join(n, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def class_metrics(matrix: DataFrame) -> DataFrame:
    """(class, tp, fp, fn, tn, precision, recall, f_score) from (actual, predicted, n)."""
    hit = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0))
    row = matrix.groupBy(F.col("actual").alias("class")).agg(hit.alias("tp"), F.sum("n").alias("actuals"))
    col = matrix.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("predictions"))
    total = matrix.agg(F.sum("n").alias("total"))
    tp, a, p = (F.col(c).cast("double") for c in ("tp", "actuals", "predictions"))
    return row.join(col, "class").crossJoin(total).select(
        "class", "tp", (F.col("predictions") - F.col("tp")).alias("fp"), (F.col("actuals") - F.col("tp")).alias("fn"),
        (F.col("total") - F.col("actuals") - F.col("predictions") + F.col("tp")).alias("tn"),
        _ratio(tp, p).alias("precision"), _ratio(tp, a).alias("recall"), _ratio(2 * tp, a + p).alias("f_score"),
    )


def multiclass_metrics(matrix: DataFrame) -> DataFrame:
    """One row of macro, micro and total metrics."""
    c = class_metrics(matrix)
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return c.agg(
        F.avg((F.col("tp") + F.col("tn")) / total).alias("avg_accuracy"), F.avg((F.col("fp") + F.col("fn")) / total).alias("avg_error"),
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f_score").alias("macro_f_score"),
        (F.sum("tp") / F.max(total)).alias("total_accuracy"), (1 - F.sum("tp") / F.max(total)).alias("total_error"),
        (F.sum("tp") / F.sum(F.col("tp") + F.col("fp"))).alias("micro_precision"), (F.sum("tp") / F.sum(F.col("tp") + F.col("fn"))).alias("micro_recall"),
    )


def average_precision(df: DataFrame, key: str, scores: Column, labels: Column) -> DataFrame:
    """(class, ap) by eleven-point interpolation; of equal scores the later row comes first.

    scores: array<double>, one for each class; labels: array of classes.
    """
    flat = df.select(F.col(key).alias("row"), F.posexplode(scores).alias("class", "score"), labels.alias("labels")).withColumn(
        "hit", F.array_contains("labels", F.col("class")).cast("long")
    )
    down = W.partitionBy("class").orderBy(F.desc("score"), F.desc("row")).rowsBetween(W.unboundedPreceding, 0)
    ranked = flat.withColumn("tp", F.sum("hit").over(down)).withColumn("k", F.count("*").over(down)).withColumn("all", F.sum("hit").over(W.partitionBy("class")))
    points = ranked.select("class", (F.col("tp") / F.col("k")).alias("precision"), F.when(F.col("all") > 0, F.col("tp") * 10 / F.col("all")).alias("recall10"))
    best = [F.coalesce(F.max(F.when(F.col("recall10") >= t, F.col("precision"))), F.lit(0.0)) for t in range(11)]
    return points.groupBy("class").agg((sum(best[1:], best[0]) / 11).alias("ap"))


def augmented(df: DataFrame, name: str, scores: Column, classes: int, policy: str = "average") -> DataFrame:
    """(name, class): the class of the best mean score, or Borda count, over the rows of a name; ties to the lower class."""
    ranked = F.array_sort(F.transform(scores, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    if policy == "borda":  # by ascending score, the rank of a class is its place
        flat = df.select(F.col(name).alias("name"), F.posexplode(ranked).alias("score", "p")).select("name", F.col("p.i").alias("class"), F.col("score").cast("double").alias("score"))
    else:
        flat = df.select(F.col(name).alias("name"), F.posexplode(scores).alias("class", "score"))
    total = flat.groupBy("name", "class").agg((F.sum("score") if policy == "borda" else F.avg("score")).alias("s"))
    return total.groupBy("name").agg(F.min(F.struct((-F.col("s")).alias("s"), "class")).getField("class").alias("class"))


def top_k_error(df: DataFrame, top: Column, label: Column) -> DataFrame:
    return df.agg((F.avg((~F.array_contains(top, label)).cast("double")) * 100).alias("error_pct"))


def small_label(k: int) -> str:
    """Letters for a number: digits of base 26, the lowest first."""
    out = ""
    while True:
        out += chr(ord("a") + k % 26)
        k //= 26
        if not k:
            return out


def print_confusion(matrix: DataFrame, classes: int) -> str:
    """The confusion matrix as a table of text."""
    cell = {(r["actual"], r["predicted"]): r["n"] for r in matrix.collect()}
    width = max([5, *(len(str(n)) + 1 for n in cell.values())])
    head = "".join(small_label(k).rjust(width) for k in range(classes)) + "   <- predicted"
    return "\n".join([head, *("".join(str(cell.get((i, j), 0)).rjust(width) for j in range(classes)) + f" | {small_label(i)} = {i}" for i in range(classes))])
