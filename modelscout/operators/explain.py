"""Shapley value explanations of linear and tree models."""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from modelscout.functions.columns import as_column, mean_abs
from modelscout.operators.boosting import HistogramBoostingModel
from modelscout.operators.penalized import PenalizedLogisticModel
from modelscout.sources.scratch import scratch_path

LINEAR_MODELS = (LogisticRegressionModel, PenalizedLogisticModel)
EXACT_FEATURES = 10  # up to so many features all coalitions are gone through
TABLE_FEATURES = 10  # a leaf with up to so many keeps the values of all its cases
CELL_ROOM = 1 << 21  # values of cells of all trees that a task keeps
ORDERS = 500  # in which more features become known, each of them both ways


def linear_shap(weights: dict[str, float], train: DataFrame, test: DataFrame) -> DataFrame:
    """(feature, shap): mean over the test rows of |w * (x - mean of x over the train rows)|.

    Features are taken as independent. The means are one scalar subquery, the result one aggregate.
    """
    names = list(weights)
    means = train.agg(
        F.array(*[F.avg(as_column(c).cast("double")) for c in names]).alias("m")
    ).scalar()
    parts = [
        F.struct(
            F.lit(c).alias("feature"),
            (abs(float(weights[c])) * mean_abs(as_column(c).cast("double") - F.get(F.col("_m"), F.lit(i)))).alias("shap"),
        )
        for i, c in enumerate(names)
    ]
    return test.withColumn("_m", means).agg(F.array(*parts).alias("r")).select(F.inline("r"))


def linear_weights(model: LogisticRegressionModel | PenalizedLogisticModel, columns: Sequence[str]) -> dict[str, float]:
    return dict(zip(columns, np.asarray(model.coefficients).tolist()))


class LinearMap(NamedTuple):
    """The Shapley values of a linear model as a linear map: ``matrix @ (x - mean)``."""

    names: list[str]
    mean: np.ndarray
    matrix: np.ndarray

    def values(self, x: np.ndarray) -> np.ndarray:
        """One row of values per row of ``x``."""
        return (x - self.mean) @ self.matrix.T


def mean_and_covariance(df: DataFrame, names: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Means and covariances of numeric columns without gaps; every task sends one row of products per column."""
    names, d = list(names), len(names)
    first = df.agg(F.count(F.lit(1)).alias("n"), *[F.avg(as_column(c).cast("double")).alias(f"m{i}") for i, c in enumerate(names)]).first()
    mean = np.array([first[f"m{i}"] or 0.0 for i in range(d)])
    rows = df.select(*[as_column(c).cast("double").alias(f"_x{i}") for i, c in enumerate(names)])

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((d, d))
        for pdf in batches:
            x = pdf.to_numpy(dtype=float) - mean
            total += x.T @ x
        yield pd.DataFrame({"i": range(d), "row": list(total)})

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [key[0]], "row": [np.sum(np.stack(pdf["row"].to_numpy()), axis=0)]})

    parts = rows.mapInPandas(products, "i int, row array<double>").groupBy("i").applyInPandas(add, "i int, row array<double>")
    total = {r["i"]: r["row"] for r in parts.collect()}
    return mean, np.array([total[i] for i in range(d)]) / max(first["n"], 1)


class _Given:
    """What is expected of all features when some are known: ``mean + map @ (x - mean)``, and what is left of their covariance."""

    def __init__(self, covariance: np.ndarray):
        self.left, self.map = covariance.copy(), np.zeros_like(covariance)
        self.least = 1e-9 * np.maximum(np.diag(covariance), 1e-300)

    def learn(self, i: int) -> None:
        """Feature ``i`` becomes known; one that follows from those known already tells nothing new."""
        spread = self.left[i, i]
        if spread <= self.least[i]:
            return
        share = self.left[:, i] / spread
        news = -self.map[i]
        news[i] += 1
        self.map += np.outer(share, news)
        self.left -= np.outer(share, self.left[i])

    def copy(self) -> "_Given":
        other = object.__new__(_Given)
        other.left, other.map, other.least = self.left.copy(), self.map.copy(), self.least
        return other


def correlated_matrix(weights: np.ndarray, covariance: np.ndarray, exact: int = EXACT_FEATURES, orders: int = ORDERS, seed: int = 0) -> np.ndarray:
    """Shapley values of ``weights @ x`` where a feature left out has its mean given those known, as a matrix for ``x - mean``.

    All coalitions are gone through with up to ``exact`` features, beyond that seeded orders, each with its reverse. A row's
    values add up to its score minus the mean score in either case.
    """
    d = len(weights)
    out = np.zeros((d, d))
    if d <= exact:
        worth = np.zeros((1 << d, d))
        todo = [(0, 0, _Given(covariance))]
        while todo:
            known, first, given = todo.pop()
            worth[known] = weights @ given.map
            for i in range(first, d):
                more = given.copy()
                more.learn(i)
                todo.append((known | 1 << i, i + 1, more))
        share = [math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d) for k in range(d)]
        for known in range(1 << d):
            for i in range(d):
                if not known >> i & 1:
                    out[i] += share[known.bit_count()] * (worth[known | 1 << i] - worth[known])
        return out
    draw = np.random.default_rng(seed)
    for _ in range(orders):
        order = draw.permutation(d)
        for way in (order, order[::-1]):
            given, before = _Given(covariance), np.zeros(d)
            for i in way:
                given.learn(i)
                after = weights @ given.map
                out[i] += (after - before) / (2 * orders)
                before = after
    return out


def linear_map(weights: dict[str, float], train: DataFrame, correlated: bool = True) -> LinearMap:
    """The map of a linear model: with ``correlated`` a feature left out has its mean given the known ones (as in a normal
    distribution with the train rows' covariances), without it the plain mean of the train rows."""
    names, w = list(weights), np.array([float(v) for v in weights.values()])
    if not correlated:
        first = train.agg(*[F.avg(as_column(c).cast("double")).alias(f"m{i}") for i, c in enumerate(names)]).first()
        return LinearMap(names, np.array([first[i] for i in range(len(names))], dtype=float), np.diag(w))
    mean, covariance = mean_and_covariance(train, names)
    return LinearMap(names, mean, correlated_matrix(w, covariance))


def mean_abs_values(values: Callable[[np.ndarray], np.ndarray], df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, shap): mean absolute value per feature. Each task returns one partial sum per feature, so next to nothing is shuffled."""
    columns = list(columns)
    rows = df.select(*[as_column(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(len(columns)), 0
        for pdf in batches:
            total += np.abs(values(pdf.to_numpy(dtype=float))).sum(axis=0)
            n += len(pdf)
        if n:
            yield pd.DataFrame({"feature": columns, "total": total, "n": n})

    parts = rows.mapInPandas(run, "feature string, total double, n bigint")
    return parts.groupBy("feature").agg((F.sum("total") / F.sum("n")).alias("shap"))


def values_per_row(values: Callable[[np.ndarray], np.ndarray], df: DataFrame, columns: Sequence[str], key: Sequence[str]) -> DataFrame:
    """(key..., feature, value) for every row and feature."""
    columns, key = list(columns), list(key)
    rows = df.select(*[as_column(k) for k in key], *[as_column(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)])
    spec = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in key)
    names = np.array(columns, dtype=object)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = values(pdf.iloc[:, len(key):].to_numpy(dtype=float))
            out = pdf.iloc[:, : len(key)].loc[pdf.index.repeat(len(names))].reset_index(drop=True)
            out["feature"] = np.tile(names, len(pdf))
            out["value"] = found.ravel()
            yield out

    return rows.mapInPandas(run, f"{spec}, feature string, value double")


def linear_shap_correlated(weights: dict[str, float], train: DataFrame, test: DataFrame) -> DataFrame:
    """(feature, shap): mean over the test rows of the absolute values of :func:`linear_map`."""
    return mean_abs_values(linear_map(weights, train).values, test, list(weights))


def linear_values(
    weights: dict[str, float], train: DataFrame, df: DataFrame, key: Sequence[str], correlated: bool = True
) -> DataFrame:
    """(key..., feature, value) for every row and feature of a linear model. The values of a row add up to its score minus
    the mean score of the train rows; without ``correlated`` a value is ``weight * (x - mean)``."""
    return values_per_row(linear_map(weights, train, correlated).values, df, list(weights), key)


class Leaf:
    """A leaf seen from its features: what each must satisfy and how likely that is.

    A feature out of a coalition meets its condition with the share of training rows that did. So the payoff of a coalition is
    the leaf's value times one factor per feature, and the weighted sum over all coalitions is the integral over t in [0, 1] of
    the product of (1 - t) * share + t * met over the other features, a polynomial that Gauss's rule integrates exactly with
    half as many points as there are features.
    """

    def __init__(self, value: float, path: dict[int, tuple[float, float, float]]):
        self.value = value
        self.features = np.array(sorted(path), dtype=int)
        self.low = np.array([path[f][0] for f in self.features])
        self.high = np.array([path[f][1] for f in self.features])
        self.cover = np.array([path[f][2] for f in self.features])
        m = len(self.features)
        at, weight = np.polynomial.legendre.leggauss((m + 1) // 2)
        self.points, self.weights = (at + 1) / 2, weight / 2
        self.table = self.of((np.arange(1 << m)[:, None] >> np.arange(m) & 1).astype(float)) if m <= TABLE_FEATURES else None

    def of(self, met: np.ndarray) -> np.ndarray:
        """The values of rows that meet (1) or miss (0) the condition on each feature."""
        total = np.zeros_like(met)
        for t, w in zip(self.points, self.weights):
            factors = (1 - t) * self.cover + t * met  # never 0, as t < 1
            total += w * factors.prod(axis=1, keepdims=True) / factors
        return self.value * (met - self.cover) * total

    def values(self, x: np.ndarray) -> np.ndarray:
        met = (x[:, self.features] > self.low) & (x[:, self.features] <= self.high)
        if self.table is not None:
            return self.table[met @ (1 << np.arange(met.shape[1]))]
        kinds, which = np.unique(met, axis=0, return_inverse=True)
        return self.of(kinds.astype(float))[which.ravel()]


class TreeNode(NamedTuple):
    """A node as the explanation sees it; ``left`` is negative for a leaf."""

    rows: float
    value: float
    feature: int
    cut: float
    left: int
    right: int


def stored_trees(model: Model) -> tuple[list[dict[int, TreeNode]], list[float]]:
    """Trees and their weights of a forest or boosted model.

    MLlib's trees are read from the saved form of the model, the only place that has the row counts per node. Forests
    explain the probability of class 1, boosted trees the log-odds.
    """
    if isinstance(model, HistogramBoostingModel):
        return [{i: TreeNode(n.rows, n.value, n.feature, n.cut, n.left, n.right) for i, n in enumerate(t.nodes)} for t in model.trees], [1.0] * len(model.trees)
    spark = SparkSession.active()
    path = scratch_path(spark, "model")
    model.write().save(path)
    # bounded by the number and depth of trees in the catalogue
    rows = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()
    boosted = isinstance(model, GBTClassificationModel)
    trees: dict[int, dict[int, TreeNode]] = {}
    for r in rows:
        leaf = r["leftChild"] < 0
        value = r["prediction"] if boosted else r["impurityStats"][1] / sum(r["impurityStats"])
        cut = math.nan if leaf else r["split"]["leftCategoriesOrThreshold"][0]
        trees.setdefault(r["treeID"], {})[r["id"]] = TreeNode(r["rawCount"], value, r["split"]["featureIndex"], cut, r["leftChild"], r["rightChild"])
    weights = [2.0 * w for w in model.treeWeights] if boosted else [1.0 / len(model.trees)] * len(model.trees)
    return [trees[k] for k in sorted(trees)], [weights[k] for k in sorted(trees)]


def leaves_by_tree(model: Model) -> tuple[list[list[Leaf]], float]:
    """Leaves of every tree of a forest or boosted model and the mean output over the training rows."""
    groups, base = [], model.start if isinstance(model, HistogramBoostingModel) else 0.0
    for nodes, weight in zip(*stored_trees(model)):
        leaves: list[Leaf] = []
        work: list[tuple[int, dict]] = [(0, {})]
        while work:
            at, path = work.pop()
            node = nodes[at]
            if node.left < 0:
                base += weight * node.value * node.rows / nodes[0].rows
                if path:
                    leaves.append(Leaf(weight * node.value, path))
                continue
            for child, is_left in ((node.left, True), (node.right, False)):
                low, high, share = path.get(node.feature, (-math.inf, math.inf, 1.0))
                low, high = (low, min(high, node.cut)) if is_left else (max(low, node.cut), high)
                work.append((child, {**path, node.feature: (low, high, share * nodes[child].rows / node.rows)}))
        groups.append(leaves)
    return groups, base


def tree_leaves(model: Model) -> tuple[list[Leaf], float]:
    """Leaves of all trees of a forest or boosted model and the mean output over the training rows."""
    groups, base = leaves_by_tree(model)
    return [leaf for leaves in groups for leaf in leaves], base


def tree_values(leaves: list[Leaf], x: np.ndarray) -> np.ndarray:
    """Shapley values of a batch of rows, one column per feature."""
    out = np.zeros_like(x, dtype=float)
    for leaf in leaves:
        out[:, leaf.features] += leaf.values(x)
    return out


class TreeValues:
    """Shapley values of batches of rows. The bounds of a tree cut the rows into cells; rows of one cell meet the same conditions
    and have the same values, which are worked out once and kept within ``CELL_ROOM``."""

    def __init__(self, groups: Sequence[Sequence[Leaf]], d: int):
        self.groups = [list(leaves) for leaves in groups if leaves]
        own = [self._bounds(leaves, d) for leaves in self.groups]
        self.bounds = [np.unique(np.concatenate([b[f] for b in own])) if own else np.zeros(0) for f in range(d)]
        self.parts = [self._parts(b) for b in own]
        self.known = [(np.zeros(0, dtype=np.int64), np.zeros((0, d))) for _ in own]
        self.room = max(1_024, CELL_ROOM // max(1, d * len(own)))

    @staticmethod
    def _bounds(leaves: list[Leaf], d: int) -> list[np.ndarray]:
        found: list[set] = [set() for _ in range(d)]
        for leaf in leaves:
            for f, low, high in zip(leaf.features, leaf.low, leaf.high):
                found[f] |= {v for v in (low, high) if math.isfinite(v)}
        return [np.array(sorted(v), dtype=float) for v in found]

    def _parts(self, own: list[np.ndarray]) -> list[tuple[int, np.ndarray]] | None:
        """What every feature's interval among all bounds adds to the number of a tree's cell; None if there are too many cells."""
        parts, cells = [], 1
        for f, b in enumerate(own):
            if len(b):
                parts.append((f, cells * np.append(np.searchsorted(b, self.bounds[f], side="left"), len(b)).astype(np.int64)))
                cells *= len(b) + 1
                if cells >= 1 << 62:
                    return None
        return parts

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(x.shape)
        gaps = np.isnan(x).any(axis=1)  # meet no condition on what is missing
        if gaps.any():
            for leaves in self.groups:
                out[gaps] += tree_values(leaves, x[gaps])
            x = x[~gaps]
        at = [np.searchsorted(b, x[:, f], side="left") if len(b) else None for f, b in enumerate(self.bounds)]
        total = np.zeros(x.shape)
        for k, (leaves, parts) in enumerate(zip(self.groups, self.parts)):
            if parts is None:
                total += tree_values(leaves, x)
            elif len(x):
                total += self._of_cells(k, leaves, sum(part[at[f]] for f, part in parts), x)
        out[~gaps] = total
        return out

    def _of_cells(self, k: int, leaves: list[Leaf], cells: np.ndarray, x: np.ndarray) -> np.ndarray:
        known, table = self.known[k]
        place = np.searchsorted(known, cells)
        new = np.ones(len(cells), dtype=bool)
        inside = place < len(known)
        new[inside] = known[place[inside]] != cells[inside]
        if new.any():
            missed = np.flatnonzero(new)
            more, first = np.unique(cells[missed], return_index=True)
            rows = tree_values(leaves, x[missed[first]])
            if len(known) + len(more) > self.room:
                # what this batch has, and nothing older
                kept = np.unique(place[~new])
                known, table = known[kept], table[kept]
            known, table = np.concatenate([known, more]), np.concatenate([table, rows])
            order = np.argsort(known)
            known, table = known[order], table[order]
            place = np.searchsorted(known, cells)
            self.known[k] = known, table
        return table[place]


def shap_values(
    model: Model, df: DataFrame, columns: Sequence[str], key: Sequence[str], train: DataFrame | None = None, correlated: bool = True
) -> DataFrame:
    """(key..., feature, value) for every row and feature of any model of the catalogue.

    The values of a row add up to its raw output minus the mean output. A linear model needs the rows it was trained on, or
    takes ``df`` for them.
    """
    if isinstance(model, LINEAR_MODELS):
        return linear_values(linear_weights(model, columns), df if train is None else train, df, key, correlated)
    return values_per_row(TreeValues(leaves_by_tree(model)[0], len(columns)), df, columns, key)


def tree_shap(model: Model, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, shap): mean absolute Shapley value per feature of a tree model."""
    return mean_abs_values(TreeValues(leaves_by_tree(model)[0], len(columns)), df, columns)


def explain(model: Model, train: DataFrame, test: DataFrame, columns: Sequence[str], correlated: bool = True) -> DataFrame:
    """(feature, shap) for any model of the catalogue. ``correlated=False`` takes the features of linear models as independent."""
    if isinstance(model, LINEAR_MODELS):
        weights = linear_weights(model, columns)
        return linear_shap_correlated(weights, train, test) if correlated else linear_shap(weights, train, test)
    return tree_shap(model, test, columns)
