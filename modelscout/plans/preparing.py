"""From a table to train and test frames that a model can read."""
from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from modelscout.functions.columns import as_column
from modelscout.operators.impute import KnnImpute
from modelscout.operators.prep import (
    MAX_LEVELS,
    assemble,
    columns_to_impute,
    levels,
    one_hot,
    one_hot_aligned,
    select_features,
    split,
)

LABEL = "label"
ROWS_A_TASK = 500_000  # that training keeps together; what a task reads does not grow with the table


class Prepared(NamedTuple):
    train: DataFrame
    test: DataFrame
    features: list[str]
    columns: list[str]
    label: str


def label_values(df: DataFrame, target: str) -> list:
    """The two values of the target in sort order; anything else is an error."""
    found = [r[0] for r in df.select(as_column(target)).distinct().limit(4).collect()]
    values = sorted(v for v in found if v is not None)
    if len(values) != 2 or len(found) != 2:
        raise ValueError(f"target {target!r} must have exactly two values and no gaps, found {found}")
    return values


def prepare(
    df: DataFrame,
    target: str,
    categories: Sequence[str] = (),
    unused: Sequence[str] = (),
    keys: Sequence[str] | None = None,
    train: float = 0.8,
    seed: int = 4000,
    levels_from: str = "train",
    impute: bool = True,
    max_levels: int = MAX_LEVELS,
) -> Prepared:
    """Drop unused columns, split, encode categories and fill numeric gaps.

    The target becomes ``label``: 0 and 1 for its two values in sort order. ``levels_from`` says where the category
    levels come from: the train side, the whole table ("all"), or each side on its own ("aligned"). ``keys`` are
    the columns that decide the side of a row; they are kept in the frames only if they are features.
    """
    low, high = label_values(df, target)
    chosen = select_features(df, target, categories, unused)
    sides = split(df, keys, train, seed)
    label = F.when(as_column(target) == F.lit(high), 1).when(as_column(target) == F.lit(low), 0)
    a, b = [
        side.select(*[as_column(c) for c in chosen.features], label.alias(LABEL)) for side in sides
    ]
    if chosen.categories:
        if levels_from == "aligned":
            a, b = one_hot_aligned(a, b, chosen.categories, max_levels)
        else:
            known = levels(a if levels_from == "train" else df, chosen.categories, max_levels)
            a, b = (one_hot(side, chosen.categories, levels_of=known) for side in (a, b))
    columns = [c for c in a.columns if c != LABEL]
    if impute and set(columns) & set(chosen.features):
        # the two sides make up the table, so one look at it tells the gaps of both
        gaps = columns_to_impute(chosen.df.select([as_column(c) for c in columns if c in set(chosen.features)]))
        if gaps:
            both = a.withColumn("_test", F.lit(False)).unionByName(b.withColumn("_test", F.lit(True)))
            filled = KnnImpute(gaps).fit(a).transform(both)
            a, b = filled.filter(~F.col("_test")).drop("_test"), filled.filter("_test").drop("_test")
    return Prepared(a, b, chosen.features, columns, LABEL)


def vectors(p: Prepared, partitions: int | None = None, rows_a_task: int = ROWS_A_TASK) -> tuple[DataFrame, DataFrame]:
    """Train and test with the ``features`` vector. ``partitions`` spreads the train side over at least so many tasks, and over
    more where one would have over ``rows_a_task`` rows; leave it unset for tables of many files, which are spread already."""
    train = p.train
    if partitions is not None:
        train = train.repartition(max(partitions, -(-train.count() // rows_a_task)))
    return assemble(train, p.columns), assemble(p.test, p.columns)
