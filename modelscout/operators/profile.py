"""Column profiles: counts, distinct values, moments, quartiles, top values."""
from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from modelscout.functions.columns import present, present_sql
from modelscout.operators.quantiles import QUARTILES, exact_quantiles, fractions_sql, literal_sql, number_sql

NUMERIC, STRING = 1, 2
SKETCH_ACCURACY = 10_000
LONG_TEXT = 20  # bytes; in hexadecimal shorter than a digest, so the two never meet


def classify(schema: T.StructType) -> dict[str, int]:
    """Numeric (1) for every number type, String (2) for all others, booleans and timestamps included."""
    return {f.name: NUMERIC if isinstance(f.dataType, T.NumericType) else STRING for f in schema.fields}


def table_shape(df: DataFrame) -> DataFrame:
    """One row: number of rows and of columns."""
    return df.agg(F.count(F.lit(1)).alias("row_number"), F.lit(len(df.columns)).cast("int").alias("column_number"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows per value of one column, NULL included."""
    return df.groupBy(F.col(f"`{col}`").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def _per_column(
    df: DataFrame,
    cols: Sequence[str],
    aggs: Callable[[str], str],
    digest: bool = False,
) -> DataFrame:
    """Union over the columns of: count per value (value, freq), then one row of aggregates over those counts.

    Each branch reads its own column only, so a columnar table is read once in all, values keep their types, and
    equal values are merged before the shuffle. One wide multi-distinct aggregate would copy each row per column. With
    ``digest`` long texts are told apart by their SHA-256, so that they are not shuffled themselves.
    """
    branches = []
    for i, f in enumerate(df.schema.fields):
        if f.name in cols:
            own = present_sql(f.name, f.dataType)
            if digest and isinstance(f.dataType, (T.StringType, T.BinaryType)):
                own = f"if(octet_length({own}) > {LONG_TEXT}, sha2({own}, 256), hex({own}))"
            values = df.selectExpr(f"{own} AS value")
            counts = values.groupBy("value").agg(F.expr("count(1) AS freq"))
            name = f.name.replace("\\", "\\\\").replace("'", "\\'")
            row = F.expr(f"struct({i} AS var_id, '{name}' AS var_name, {aggs(f.name)})")
            branches.append(counts.agg(row.alias("r")))
    return reduce(DataFrame.union, branches).select("r.*")


def distinct_counts(
    df: DataFrame, cols: Sequence[str] | None = None, count_null: bool = False, exact: bool = True
) -> DataFrame:
    """Distinct values per column: (var_id, var_name, ds_unique). ``count_null`` counts missing as one value."""
    cols = list(df.columns if cols is None else cols)
    if exact:
        kinds = "count(1)" if count_null else "count(value)"
        return _per_column(df, cols, lambda c: f"{kinds} AS ds_unique", digest=True)
    ids = [(i, c, present(c, df.schema[c].dataType)) for i, c in enumerate(df.columns) if c in cols]
    rows = []
    for i, c, v in ids:
        n = F.approx_count_distinct(v)
        if count_null:
            n = n + F.coalesce(F.max(F.when(v.isNull(), 1)), F.lit(0))
        rows.append(F.struct(F.lit(i).alias("var_id"), F.lit(c).alias("var_name"), n.alias("ds_unique")))
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def top_value(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Most frequent value per column as text and its frequency; ties go to the smaller text. String columns only
    unless ``cols`` says otherwise."""
    kinds = classify(df.schema)
    cols = [c for c in df.columns if kinds[c] == STRING] if cols is None else list(cols)
    best = "min(if(value IS NULL, null, struct(-freq AS neg, cast(value AS string) AS top))) AS best"
    found = _per_column(df, cols, lambda c: best)
    return found.select("var_id", "var_name", F.col("best.top").alias("top"), (-F.col("best.neg")).alias("freq"))


def missing_counts(df: DataFrame) -> DataFrame:
    """(var_id, var_name, missing) for every column in one scan."""
    rows = [
        F.struct(
            F.lit(i).alias("var_id"),
            F.lit(f.name).alias("var_name"),
            (F.count(F.lit(1)) - F.count(present(f.name, f.dataType))).alias("missing"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def profile(df: DataFrame, exact: bool = True, count_null: bool = False, quartiles: bool = True) -> DataFrame:
    """One summary row per column, in the layout of the ``dataset_summary`` table.

    Counts and moments of all columns come from one scan, distinct counts from the merged values of each column and
    quartiles from :func:`exact_quantiles`. ``exact=False`` uses sketches for both, and the whole profile is one scan.
    Without ``quartiles`` these are left NULL and cost nothing.
    """
    kinds = classify(df.schema)
    numeric = [c for c in df.columns if kinds[c] == NUMERIC]
    nothing = "cast(null AS double)"
    nowhere = literal_sql([None] * 3)
    if not quartiles:
        found = {}
    elif exact:
        found = {c: literal_sql(v) for c, v in exact_quantiles(df, numeric, QUARTILES).items()}
    else:
        sketch = f"{fractions_sql(QUARTILES)}, {SKETCH_ACCURACY}"
        found = {c: f"percentile_approx({number_sql(df, c)}, {sketch})" for c in numeric}

    summary = []
    for i, f in enumerate(df.schema.fields):
        mean = std = low = high = nothing
        if kinds[f.name] == NUMERIC:
            x = number_sql(df, f.name)
            mean, std, low, high = f"avg({x})", f"stddev_samp({x})", f"min({x})", f"max({x})"
        q = f", {found.get(f.name, nowhere)} AS q"
        summary.append(
            f"struct({i} AS var_id, {kinds[f.name]} AS var_type, count({present_sql(f.name, f.dataType)}) AS ds_count, "
            f"{mean} AS ds_mean, {std} AS ds_std, {low} AS ds_min, {high} AS ds_max{q})"
        )
    moments = df.agg(F.expr(f"array({', '.join(summary)})").alias("r")).select(F.inline("r"))

    values = distinct_counts(df, count_null=count_null, exact=exact)
    return moments.join(values, "var_id").selectExpr(
        "var_id", "var_name", "var_type", "ds_count", "ds_unique", "ds_mean", "ds_std", "ds_min",
        "q[0] AS ds_25", "q[1] AS ds_50", "q[2] AS ds_75", "ds_max",
    )
