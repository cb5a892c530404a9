"""Classification metrics as aggregations over scored rows."""
from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from modelscout.functions.columns import as_column

RANGES = 1_024


def _whole(value: Column, *needed: Column) -> Column:
    """``value``, or an error in a row in which something needed is missing: no row is left out silently."""
    gap = reduce(Column.__or__, [c.isNull() for c in needed])
    return F.when(gap, F.raise_error(F.lit("a row without label, prediction or score"))).otherwise(value)


def _counts(y: str, pred: str) -> dict[str, Column]:
    needed = as_column(y), as_column(pred)
    yes, said = (_whole(c == 1, *needed) for c in needed)
    return {
        "tp": F.count_if(yes & said),
        "fp": F.count_if(~yes & said),
        "tn": F.count_if(~yes & ~said),
        "fn": F.count_if(yes & ~said),
    }


def confusion(df: DataFrame, y: str, pred: str) -> DataFrame:
    """One row: true/false positive/negative counts of class 1. A missing label or prediction is an error."""
    return df.agg(*[c.alias(n) for n, c in _counts(y, pred).items()])


def _rates(counts: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(n).cast("double") for n in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn

    def ratio(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    return counts.select(
        ratio(tp + tn, n).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio((tp + fn) * ratio(tp, tp + fp) + (tn + fp) * ratio(tn, tn + fn), n).alias("weighted_precision"),
        ratio(tp + tn, n).alias("weighted_recall"),
        F.try_divide(F.try_divide(tp, tp + fn) + F.try_divide(tn, tn + fp), F.lit(2.0)).alias("auc_hard"),
    )


def all_metrics(df: DataFrame, y: str, pred: str) -> DataFrame:
    """Every label-based metric from one aggregate row."""
    return _rates(confusion(df, y, pred))


def binary_metrics(df: DataFrame, y: str, pred: str) -> DataFrame:
    """Accuracy, precision and recall of class 1; 0 where a ratio has no rows."""
    return all_metrics(df, y, pred).select("accuracy", "precision", "recall")


def weighted_metrics(df: DataFrame, y: str, pred: str) -> DataFrame:
    """Precision and recall averaged over both classes by class size."""
    return all_metrics(df, y, pred).select("weighted_precision", "weighted_recall", "accuracy")


def auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """One row: area under the ROC curve, exact, ties counted half. NULL when only one class is present. A missing label or
    score (NaN included) is an error.

    Rows are merged per score before anything is ordered. A quantile sketch of the scores (one map-side scan) cuts
    them into ordered ranges; running counts are taken within each range, and only one row per range, at most
    ``RANGES``, is ordered globally.
    """
    x = as_column(score).cast("double")
    x = F.when(~F.isnan(x), x)
    needed = x, as_column(y)
    rows = df.select(_whole(x, *needed).alias("score"), _whole(as_column(y) == 1, *needed).alias("yes"))
    probs = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
    cuts = rows.agg(F.percentile_approx("score", probs, 4 * RANGES)).first()[0] or []
    merged = rows.groupBy("score").agg(
        F.count_if("yes").cast("double").alias("pos"), F.count_if(~F.col("yes")).cast("double").alias("neg")
    )
    splits = [float("-inf"), *sorted(set(cuts) - {float("-inf"), float("inf")}), float("inf")]
    if len(splits) > 2:
        ranged = Bucketizer(splits=splits, inputCol="score", outputCol="range").transform(merged)
        ranged = ranged.withColumn("range", F.col("range").cast("int"))
    else:
        ranged = merged.withColumn("range", F.lit(0))
    before = Window.partitionBy("range").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    per_range = (
        ranged.withColumn("below", F.coalesce(F.sum("neg").over(before), F.lit(0.0)))
        .groupBy("range")
        .agg(
            F.sum("pos").alias("pos"),
            F.sum("neg").alias("neg"),
            F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0)).alias("won"),
        )
    )
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    return per_range.withColumn("earlier", F.coalesce(F.sum("neg").over(earlier), F.lit(0.0))).agg(
        F.try_divide(
            F.sum(F.col("won") + F.col("pos") * F.col("earlier")), F.sum("pos") * F.sum("neg")
        ).alias("auc")
    )
