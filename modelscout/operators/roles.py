"""Rules over column summaries: quality notes, suggested roles, the summary as shown."""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from modelscout.functions.columns import dash_if_null, missing_note, type_label


def _missing(row_number: int | Column) -> Column:
    return (F.lit(row_number) if isinstance(row_number, int) else row_number) - F.col("ds_count")


def _too_many_unique() -> Column:
    return (F.col("var_type") == 2) & (F.col("ds_unique") > F.col("ds_count") / 2)


def _notes(row_number: int | Column, outliers: Iterable[str]) -> Column:
    odd = F.col("var_name").isin(list(outliers)) & (F.col("var_type") == 1) & (F.col("ds_unique") > 2)
    return F.concat_ws(
        ", ",
        missing_note(_missing(row_number)),
        F.when(_too_many_unique(), "too many unique"),
        F.when(odd, "might be outliers"),
    )


def _rounded(x: Column, digits: int) -> Column:
    """Plain decimal notation; values beyond the decimal range keep their own form."""
    return F.coalesce(F.round(x, digits).try_cast(f"decimal(38,{digits})").cast("string"), x.cast("string"))


def quality_report(summary: DataFrame, row_number: int | Column, outliers: Iterable[str] = ()) -> DataFrame:
    """Notes per column. ``outliers`` names the columns in which the outlier test found something; that note goes to
    numeric columns of more than two values only."""
    return summary.select(
        "var_id", "var_name", _missing(row_number).alias("missing"), _notes(row_number, outliers).alias("quality")
    )


def suggest_roles(summary: DataFrame) -> DataFrame:
    """Which columns can be the target (two values), are a category (String) or are best left out."""
    return summary.select(
        "var_id",
        "var_name",
        (F.col("ds_unique") == 2).cast("int").alias("target_candidate"),
        (F.col("var_type") == 2).cast("int").alias("category"),
        _too_many_unique().cast("int").alias("unused"),
    )


def variable_summary(
    summary: DataFrame, row_number: int | Column, outliers: Iterable[str] = (), digits: int = 4
) -> DataFrame:
    """The column summary for display: type label, notes, and a dash for statistics that do not apply."""
    shown = {"ds_mean": "mean", "ds_std": "std", "ds_min": "min", "ds_25": "q25", "ds_50": "q50", "ds_75": "q75",
             "ds_max": "max"}
    return summary.select(
        "var_id",
        F.col("var_name").alias("variable"),
        type_label("var_type").alias("type"),
        _notes(row_number, outliers).alias("quality"),
        F.col("ds_count").alias("count"),
        F.col("ds_unique").alias("unique"),
        *[dash_if_null(_rounded(F.col(c), digits)).alias(n) for c, n in shown.items()],
    )
