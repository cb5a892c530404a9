"""Column summaries that can be merged: counts and moments, a quantile sketch and a sketch of the distinct values."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from modelscout.functions.columns import present_sql
from modelscout.operators.profile import NUMERIC, classify
from modelscout.operators.quantiles import QUARTILES, fractions_sql, number_sql

# A rank is off by less than 0.2 % of the rows, a distinct count by 0.7 % (standard error).
QUANTILE_SIZE = 2_000
DISTINCT_BITS = 14


def sketch_columns(df: DataFrame) -> DataFrame:
    """One row per column in one scan: (var_id, var_name, var_type, ds_count, mean, squares, low, high, quantiles, distinct).

    ``squares`` is the sum of squared differences from the mean. Missing values (NULL, NaN) take no part; a column without
    values has count 0 and empty sketches. Sketches are bounded, so a task sends some ten kilobytes per column.
    """
    kinds = classify(df.schema)
    rows = []
    for i, f in enumerate(df.schema.fields):
        own = present_sql(f.name, f.dataType)
        name = f.name.replace("\\", "\\\\").replace("'", "\\'")
        x = "cast(null AS double)"
        if kinds[f.name] == NUMERIC:
            x = number_sql(df, f.name)
        # one zero, as when values are compared
        plain = f"{own} + 0" if f.dataType.typeName() in ("double", "float") else own
        rows.append(
            f"struct({i} AS var_id, '{name}' AS var_name, {kinds[f.name]} AS var_type, count({own}) AS ds_count, "
            f"avg({x}) AS mean, var_pop({x}) * count({x}) AS squares, min({x}) AS low, max({x}) AS high, "
            f"kll_sketch_agg_double({x}, {QUANTILE_SIZE}) AS quantiles, "
            f"hll_sketch_agg(if({own} IS NULL, null, xxhash64({plain})), {DISTINCT_BITS}) AS distinct)"
        )
    return df.agg(F.expr(f"array({', '.join(rows)})").alias("r")).select(F.inline("r"))


def merge_sketches(sketches: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The summary of all parts together, in the layout of :func:`profile`, from the sketches of each part.

    Counts, ends and moments are those of the whole; quartiles are values that occur, and like the distinct counts approximate.
    """
    by = [*keys, "var_id"]
    whole = Window.partitionBy(*by)
    weighted = F.when(F.col("ds_count") > 0, F.col("mean") * F.col("ds_count"))
    centre = F.sum(weighted).over(whole) / F.sum(F.when(F.col("mean").isNotNull(), F.col("ds_count"))).over(whole)
    parts = sketches.withColumn("centre", centre)
    off = F.col("ds_count") * (F.col("mean") - F.col("centre")) * (F.col("mean") - F.col("centre"))
    merged = parts.groupBy(*by, "var_name", "var_type").agg(
        F.sum("ds_count").alias("ds_count"),
        F.max("centre").alias("ds_mean"),
        F.sum(F.col("squares") + off).alias("squares"),
        F.min("low").alias("ds_min"),
        F.max("high").alias("ds_max"),
        F.expr(f"kll_merge_agg_double(quantiles, {QUANTILE_SIZE})").alias("quantiles"),
        F.expr("hll_sketch_estimate(hll_union_agg(distinct))").alias("ds_unique"),
    )
    some = (F.col("ds_count") > 0) & (F.col("var_type") == NUMERIC)
    at = F.expr(f"kll_sketch_get_quantile_double(quantiles, {fractions_sql(QUARTILES)})")
    return merged.withColumn("q", F.when(some, at)).select(
        *keys, "var_id", "var_name", "var_type", "ds_count", "ds_unique", "ds_mean",
        F.when(F.col("ds_count") > 1, F.sqrt(F.col("squares") / (F.col("ds_count") - 1))).alias("ds_std"),
        "ds_min", F.col("q")[0].alias("ds_25"), F.col("q")[1].alias("ds_50"), F.col("q")[2].alias("ds_75"), "ds_max",
    )
