"""Row and column preparation: selection, filters, flags, splits, dummies."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F, types as T

from modelscout.functions.columns import as_column, present_sql, row_hash, weighted_mean as weighted_mean_of

MAX_LEVELS = 1_000


class Selection(NamedTuple):
    df: DataFrame
    categories: list[str]
    features: list[str]


def select_features(
    df: DataFrame, target: str, categories: Sequence[str] = (), unused: Sequence[str] = ()
) -> Selection:
    """Drop unused columns. A column listed both as category and as unused is dropped; the target is neither a
    category nor a feature. The caller's lists are left alone."""
    gone = set(unused) - {target}
    kept = df.select([as_column(c) for c in df.columns if c not in gone])
    return Selection(
        kept,
        [c for c in categories if c not in gone and c != target],
        [c for c in kept.columns if c != target],
    )


def drop_sentinel(df: DataFrame, cols: Sequence[str], marker: str = "\\N") -> DataFrame:
    """Rows whose columns all differ from the text marker; NULL is dropped too."""
    return df.filter(reduce(Column.__and__, [as_column(c) != marker for c in cols]))


def filter_between(df: DataFrame, col: str, lo, hi) -> DataFrame:
    """Rows with lo <= col <= hi."""
    return df.filter(as_column(col).between(lo, hi))


def cast_columns(df: DataFrame, types: dict[str, str | T.DataType]) -> DataFrame:
    """Change column types; text that does not parse becomes NULL."""
    return df.withColumns({c: as_column(c).try_cast(t) for c, t in types.items()})


def drop_incomplete(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Rows without a missing value in any of the columns."""
    return df.dropna(how="any", subset=list(subset) if subset else None)


def explode_delimited(df: DataFrame, col: str, sep: str = ",") -> DataFrame:
    """One row per item of a delimited text column; the separator is literal text. A missing value stays one row."""
    items = F.split(as_column(col), "\\Q" + sep + "\\E")
    return df.withColumn(col, F.explode_outer(items))


def enrich(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Left outer join on equal keys."""
    return left.join(right, on, "left")


class Mean(NamedTuple):
    """Threshold: the mean of a column over the whole table."""

    col: str


class WeightedMean(NamedTuple):
    """Threshold: the weighted mean of a column (or of a constant) over the whole table."""

    value: str | float
    weight: str


def _threshold(df: DataFrame, threshold: float | Mean | WeightedMean) -> Column:
    if isinstance(threshold, Mean):
        return df.agg(F.avg(as_column(threshold.col)).alias("m")).scalar()
    if isinstance(threshold, WeightedMean):
        value = threshold.value
        x = as_column(value) if isinstance(value, str) else F.lit(float(value))
        return df.agg(weighted_mean_of(x, threshold.weight).alias("m")).scalar()
    return F.lit(threshold)


def flag_at_least(
    df: DataFrame,
    col: str | Column,
    threshold: float | Mean | WeightedMean,
    name: str,
    over: DataFrame | None = None,
) -> DataFrame:
    """Add a 1/0 column: value >= threshold. A missing value gives a missing flag. Mean thresholds are scalar
    subqueries over the table (or ``over``), computed once and shipped as one number."""
    x = as_column(col)
    limit = _threshold(df if over is None else over, threshold)
    return df.withColumn(name, F.when(x >= limit, 1).when(x.isNotNull(), 0))


def weighted_mean(df: DataFrame, x: str, w: str) -> DataFrame:
    """One row: the weighted mean of ``x`` by ``w`` and the plain mean."""
    return df.agg(weighted_mean_of(x, w).alias("weighted_mean"), F.avg(as_column(x)).alias("mean"))


def split(
    df: DataFrame, keys: Sequence[str] | None = None, train: float = 0.8, seed: int = 4000
) -> tuple[DataFrame, DataFrame]:
    """Repeatable train/test split by the hash of the key columns (of all columns when there is no key).

    Both sides are plain filters: no shuffle, and a row stays on its side however the input is partitioned. With
    ``train`` 1 or more every row is on the first side.
    """
    if train >= 1:
        return df, df.limit(0)
    limit = f"{round(train * 0xFFFF):04x}"
    bucket = F.substring(row_hash(list(keys or df.columns), seed), 1, 4)
    return df.filter(bucket < limit), df.filter(bucket >= limit)


def levels(df: DataFrame, cols: Sequence[str], max_levels: int = MAX_LEVELS) -> dict[str, list]:
    """Sorted distinct non-missing values of each column, as text; numbers sort as numbers.

    Raises when a column has more than ``max_levels``: such a column belongs among the unused ones or goes through
    :func:`one_hot_sparse`. At most ``max_levels + 1`` values per column reach the driver.
    """
    cols = list(cols)
    if not cols:
        return {}
    out: dict[str, list] = {c: [] for c in cols}
    branches = []
    for i, c in enumerate(cols):
        text = f"cast({present_sql(c, df.schema[c].dataType)} AS string) AS v"
        values = df.selectExpr(text).filter(F.col("v").isNotNull()).distinct()
        branches.append(values.limit(max_levels + 1).select(F.lit(i).alias("i"), "v"))
    for row in reduce(DataFrame.union, branches).collect():
        out[cols[row["i"]]].append(row["v"])
    for c, found in out.items():
        found.sort(key=float if isinstance(df.schema[c].dataType, T.NumericType) else None)
    wide = [c for c, v in out.items() if len(v) > max_levels]
    if wide:
        raise ValueError(f"more than {max_levels} levels in {wide}: mark these columns unused or raise max_levels")
    return out


def one_hot(
    df: DataFrame,
    cols: Sequence[str],
    drop_first: bool = True,
    levels_of: dict[str, list] | None = None,
    max_levels: int = MAX_LEVELS,
) -> DataFrame:
    """Replace columns by 0/1 columns ``col_value`` in sorted level order, without the first level.

    A missing or unknown value is all zeros. The dummies are plain conditionals inside generated code.
    """
    levels_of = levels(df, cols, max_levels) if levels_of is None else levels_of
    kept = [as_column(c) for c in df.columns if c not in set(cols)]
    dummies = []
    for c in cols:
        text = as_column(c).cast("string")
        for v in levels_of[c][1 if drop_first else 0:]:
            dummies.append(F.when(text == v, 1).otherwise(0).alias(f"{c}_{v}"))
    return df.select(*kept, *dummies)


def one_hot_aligned(
    train: DataFrame, test: DataFrame, cols: Sequence[str], max_levels: int = MAX_LEVELS
) -> tuple[DataFrame, DataFrame]:
    """One-hot each side by its own levels, then keep the columns both sides have. The sides may drop different
    first levels; :func:`one_hot` with the levels of train avoids that."""
    a, b = one_hot(train, cols, max_levels=max_levels), one_hot(test, cols, max_levels=max_levels)
    one_sided = set(a.columns) ^ set(b.columns)
    shared = [c for c in a.columns if c not in one_sided]
    return a.select([as_column(c) for c in shared]), b.select([as_column(c) for c in shared])


def one_hot_sparse(train: DataFrame, *others: DataFrame, col: str, out: str) -> list[DataFrame]:
    """Sparse dummies of one column with many levels, as a vector column; levels come from the first frame.

    Indexing in descending order puts the first level last, where the encoder drops it. A missing or unknown value
    takes that same slot and so becomes the zero vector.
    """
    indexer = StringIndexer(inputCol=col, outputCol="_index", stringOrderType="alphabetDesc", handleInvalid="keep")
    model = indexer.fit(train)
    last = float(max(len(model.labels) - 1, 0))
    indexed = [
        model.transform(df).withColumn("_index", F.least(F.col("_index"), F.lit(last))) for df in (train, *others)
    ]
    encoder = OneHotEncoder(inputCol="_index", outputCol=out, dropLast=True).fit(indexed[0])
    return [encoder.transform(df).drop("_index") for df in indexed]


def columns_to_impute(*frames: DataFrame) -> list[str]:
    """Numeric columns with a missing value in any of the frames; one aggregate per frame."""
    numeric = [f for f in frames[0].schema.fields if isinstance(f.dataType, T.NumericType)]
    if not numeric:
        return []
    gaps = [
        df.agg(*[F.expr(f"count_if({present_sql(f.name, f.dataType)} IS NULL)") for f in numeric]).first()
        for df in frames
    ]
    return [f.name for i, f in enumerate(numeric) if any(g[i] for g in gaps)]


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    """Put numeric columns into one vector column; a missing value raises."""
    return VectorAssembler(inputCols=list(cols), outputCol=out).transform(df)
