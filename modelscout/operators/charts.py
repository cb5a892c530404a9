"""Data behind the charts: histogram, box, samples."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from modelscout.functions.columns import row_hash
from modelscout.operators.quantiles import number, quantile_columns


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Equal-width bins over [min, max], the last one closed: (bin, lo, hi, n). Empty bins are absent."""
    values = df.select(number(df, col).alias("x"))
    ends = values.agg(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi")).alias("e")).scalar()
    lo = ends.getField("lo")
    width = (ends.getField("hi") - lo) / bins
    # a constant column has width 0 and one bin
    step = F.coalesce(F.floor(F.try_divide(F.col("x") - lo, width)), F.lit(0))
    spot = F.least(step, F.lit(bins - 1)).cast("int")
    counts = values.filter(F.col("x").isNotNull()).groupBy(spot.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(
        "bin", (lo + width * F.col("bin")).alias("lo"), (lo + width * (F.col("bin") + 1)).alias("hi"), "n"
    )


def box_stats(df: DataFrame, col: str) -> DataFrame:
    """Box plot numbers: extremes, quartiles, whiskers at the furthest points within 1.5 IQR, outlier count."""
    values = df.select(number(df, col).alias("x"))
    q = values.agg(quantile_columns(values, ["x"])["x"].alias("q")).scalar()
    q1, q3 = F.get(q, F.lit(0)), F.get(q, F.lit(2))
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    kept = F.when(F.col("x").between(low, high), F.col("x"))
    return values.agg(
        F.min("x").alias("min"),
        F.first(q1).alias("q1"),
        F.first(F.get(q, F.lit(1))).alias("median"),
        F.first(q3).alias("q3"),
        F.max("x").alias("max"),
        F.min(kept).alias("lower_fence"),
        F.max(kept).alias("upper_fence"),
        (F.count("x") - F.count(kept)).alias("outliers"),
    )


def preview(df: DataFrame, n: int = 10, order: Sequence[str | Column] | None = None) -> DataFrame:
    """The first ``n`` rows, in the given order."""
    return (df.orderBy(*order) if order else df).limit(n)


def sample_about(
    df: DataFrame, n: int, rows: int | None = None, seed: int = 0, key: Sequence[str] | None = None
) -> DataFrame:
    """A Bernoulli sample of about ``n`` rows.

    With ``key`` a row is kept by the hash of its key, so the sample is the same on every run and for every
    partitioning; without it Spark's sampler is used.
    """
    rows = df.count() if rows is None else rows
    share = min(1.0, n / rows) if rows else 1.0
    if share >= 1.0:
        return df
    if key is None:
        return df.sample(fraction=share, seed=seed)
    limit = f"{int(share * 2**32):08x}"
    return df.filter(F.substring(row_hash(key, seed), 1, 8) < limit)
