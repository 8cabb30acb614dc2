"""Confusion matrix and per-class metrics.

The confusion matrix is an aggregation (one row per label pair), completed
over the label set with zeros, so a class that is never predicted still
has its column. All metric frames are label-sized.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlab.operators.util import small_list


def label_grid(spark, labels: list, real: str = "real", pred: str = "predict") -> DataFrame:
    """All (real, pred) pairs of the label set, generated by two explodes of
    the label list (k^2 rows, k = number of labels)."""
    arr = F.array(*[F.lit(v) for v in labels])
    return (spark.range(1).select(F.explode(arr).alias(real))
            .select(real, F.explode(arr).alias(pred)))


def confusion(df: DataFrame, real: str, pred: str, labels: list | None = None,
              real_name: str = "real", pred_name: str = "predict") -> DataFrame:
    """(real, predict, n) for every pair of labels, zeros included.

    ``labels`` defaults to the values seen in either column (collected; a
    label set is small). Every row counts: predictions outside the set, nulls
    among them, are the extra rows (real, null, n) where there are any, so row
    sums stay whole. A label outside the set, or a null one, is an error.
    """
    if labels is None:
        seen = df.select(F.col(real).alias("l")).unionByName(df.select(F.col(pred).alias("l")))
        labels = small_list(seen, "l", max_rows=10_000)
    known = F.coalesce(F.col(real).isin(labels), F.lit(False)) if labels else F.lit(False)
    checked = F.when(known, F.col(real)).otherwise(F.raise_error(F.concat(
        F.lit("label outside the label set: "), F.coalesce(F.col(real).cast("string"), F.lit("null")))))
    listed = F.when(F.col(pred).isin(labels), F.col(pred)) if labels else F.lit(None)
    counts = (df.groupBy(checked.alias(real_name), listed.alias(pred_name))
              .agg(F.count(F.lit(1)).alias("n")))
    grid = label_grid(df.sparkSession, labels, real_name, pred_name)
    zeros = grid.withColumn("n", F.lit(0).cast("bigint"))
    return (zeros.unionByName(counts.select(real_name, pred_name, "n"))
            .groupBy(real_name, pred_name).agg(F.sum("n").cast("bigint").alias("n")))


def class_metrics(cm: DataFrame, real: str = "real", pred: str = "predict") -> DataFrame:
    """Per label: tp, predicted (column sum), actual (row sum, with rows whose
    prediction is outside the label set), precision, recall and F1; null where
    a denominator is 0."""
    by_pred = cm.where(F.col(pred).isNotNull()).groupBy(F.col(pred).alias("label")).agg(
        F.sum("n").alias("predicted"),
        F.sum(F.when(F.col(real) == F.col(pred), F.col("n")).otherwise(0)).alias("tp"))
    by_real = cm.groupBy(F.col(real).alias("label")).agg(F.sum("n").alias("actual"))
    m = by_pred.join(by_real, "label", "full")
    p = F.try_divide(F.col("tp").cast("double"), F.when(F.col("predicted") > 0, F.col("predicted")))
    r = F.try_divide(F.col("tp").cast("double"), F.when(F.col("actual") > 0, F.col("actual")))
    return (m.select("label", F.coalesce("tp", F.lit(0)).cast("bigint").alias("tp"),
                     F.coalesce("predicted", F.lit(0)).cast("bigint").alias("predicted"),
                     F.coalesce("actual", F.lit(0)).cast("bigint").alias("actual"),
                     p.alias("precision"), r.alias("recall"))
            .withColumn("f1", f1(F.col("precision"), F.col("recall"))))


def f1(p, r):
    """2PR / (P + R); null when P + R is 0 or either is null."""
    return F.try_divide(2 * p * r, F.when(p + r > 0, p + r))


def matrix_accuracy(cm: DataFrame, real: str = "real", pred: str = "predict") -> DataFrame:
    """Diagonal over total."""
    return cm.agg(F.try_divide(
        F.sum(F.when(F.col(real) == F.col(pred), F.col("n")).otherwise(0)).cast("double"),
        F.sum("n").cast("double")).alias("accuracy"))


def hit_rate(df: DataFrame, real: str, pred: str) -> DataFrame:
    """Mean of equality over rows with a label; a null prediction is a miss."""
    return (df.where(F.col(real).isNotNull())
            .agg(F.avg(F.coalesce(F.col(real) == F.col(pred), F.lit(False)).cast("double")).alias("accuracy")))


def compare_f1(a: DataFrame, b: DataFrame, name_a: str = "a", name_b: str = "b") -> DataFrame:
    """F1 of two models side by side, per label (label-sized join)."""
    return (a.select("label", F.col("f1").alias(f"f1_{name_a}"))
            .join(b.select("label", F.col("f1").alias(f"f1_{name_b}")), "label", "full"))
