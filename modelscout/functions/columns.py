"""Reusable column expressions. All stay inside the JVM."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F, types as T


def as_column(c: Column | str) -> Column:
    return F.col(quoted(c)) if isinstance(c, str) else c


def weighted_mean(x: Column | str, w: Column | str) -> Column:
    """Aggregate: sum(x*w)/sum(w) over the rows where both are present."""
    x, w = as_column(x).cast("double"), as_column(w).cast("double")
    return F.try_divide(F.sum(x * w), F.sum(F.when(x.isNotNull(), w)))


def mean_abs(x: Column | str) -> Column:
    """Aggregate: mean absolute value."""
    return F.avg(F.abs(as_column(x)))


def quoted(name: str) -> str:
    """A column name as SQL text."""
    return "`" + name.replace("`", "``") + "`"


def present_sql(name: str, dtype: T.DataType) -> str:
    """SQL text of a column with NaN shown as NULL, so both count as missing."""
    c = quoted(name)
    return f"if(isnan({c}), null, {c})" if isinstance(dtype, (T.DoubleType, T.FloatType)) else c


def present(name: str, dtype: T.DataType) -> Column:
    return F.expr(present_sql(name, dtype))


def row_hash(keys: Sequence[Column | str], seed: int | str) -> Column:
    """md5 over the key columns and a seed: the same for a row however the table is partitioned."""
    parts = [F.coalesce(as_column(k).cast("string"), F.lit("\\N")) for k in keys]
    return F.md5(F.concat_ws(":", *parts, F.lit(str(seed))))


def dash_if_null(c: Column | str) -> Column:
    return F.coalesce(as_column(c).cast("string"), F.lit("-"))


def type_label(var_type: Column | str) -> Column:
    return F.when(as_column(var_type) == 1, "Numeric").otherwise("String")


def missing_note(missing: Column) -> Column:
    """``missing values(n)`` when n is positive, NULL otherwise."""
    return F.when(missing > 0, F.concat(F.lit("missing values("), missing.cast("string"), F.lit(")")))


def now_pacific() -> Column:
    """Wall-clock time in US/Pacific, as the result tables record it."""
    return F.convert_timezone(F.current_timezone(), F.lit("America/Los_Angeles"), F.current_timestamp().cast("timestamp_ntz"))
