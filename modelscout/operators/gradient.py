"""MLlib's gradient boosting, trained on merged rows.

The trees are those of MLlib's estimator up to rounding, which may choose between splits of equal gain: its own candidate splits,
from its own sample of the rows, variance as impurity, splits level by level, and pseudo-residuals of the log loss. MLlib reads
every row once a level and tree. Here rows are binned by the candidate splits once, rows with equal bins and labels, which stay
equal in every round, are merged into one that knows how many they are, and what is left is kept in blocks of arrays. Few merged
rows are trained on by one task, without a job a level.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from modelscout.operators.boosting import BLOCK, WRITTEN, Node, Tree, _binned, _blocks, _rescored, _unpacked, _written, block_histogram, histograms
from modelscout.sources.scratch import materialize

LOCAL_CELLS = 1 << 21  # merged rows times features that one task may train on
EPSILON = float(np.finfo(float).eps)


@dataclass
class Grown(Node):
    """A node with what MLlib keeps of it: [rows, sum, sum of squares] of the residuals, impurity and gain."""

    sums: tuple = (0.0, 0.0, 0.0)
    impurity: float = 0.0
    gain: float = math.nan


def labels_as_signs(y: np.ndarray, n: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """The first tree's [sum, sum of squares, rows] of merged rows."""
    t = 2 * y - 1
    return np.column_stack([n * t, n * t * t, n])


def residuals(y: np.ndarray, n: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """The [sum, sum of squares, rows] of merged rows, whose residuals are those of the log loss."""
    sign = 2 * y - 1
    t = 4 * sign / (1 + np.exp(np.minimum(2 * sign * raw, 700)))
    return np.column_stack([n * t, n * t * t, n])


def _impurity(s: np.ndarray) -> np.ndarray:
    """The variance of [sum, sum of squares, rows]."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return (s[..., 1] - s[..., 0] * s[..., 0] / s[..., 2]) / s[..., 2]


def _grown(s: np.ndarray) -> Grown:
    return Grown(float(s[2]), float(s[0] / s[2]), sums=(float(s[2]), float(s[0]), float(s[1])), impurity=float(_impurity(s)))


def split(tree: Tree, i: int, h: np.ndarray, cuts: list[np.ndarray], min_rows: int, min_gain: float) -> None:
    """Split node ``i`` by its histogram (feature, bin, sums) at the largest gain, the first of equal ones, or leave it a leaf."""
    left = np.cumsum(h, axis=1)
    right = left[:, -1:] - left[:, :-1]
    left = left[:, :-1]
    real = np.arange(left.shape[1]) < np.array([len(c) for c in cuts])[:, None]
    if i == 0:
        first = int(np.flatnonzero(real.any(axis=1))[0])
        tree.nodes.append(_grown(left[first, 0] + right[first, 0]))
    node = tree.nodes[i]
    rows = left[..., 2] + right[..., 2]
    with np.errstate(invalid="ignore"):
        gain = node.impurity - left[..., 2] / rows * _impurity(left) - right[..., 2] / rows * _impurity(right)
        allowed = real & (np.minimum(left[..., 2], right[..., 2]) >= min_rows) & (gain >= min_gain)
    gain = np.where(allowed, gain, -np.inf)
    f, b = divmod(int(np.argmax(gain)), gain.shape[1])
    if not gain[f, b] > 0:
        if gain[f, b] == -np.inf:
            node.impurity = -1.0  # as MLlib marks a leaf that has no split at all
        return
    node.feature, node.bin, node.cut, node.gain = f, b, float(cuts[f][b]), float(gain[f, b])
    node.left, node.right = len(tree.nodes), len(tree.nodes) + 1
    tree.nodes += [_grown(left[f, b]), _grown(right[f, b])]


def grow(found: Callable[[Tree, list[int]], np.ndarray], cuts: list[np.ndarray], depth: int, min_rows: int, min_gain: float) -> Tree:
    """A tree of at most ``depth`` levels of splits; ``found`` gives the histograms of some of its nodes."""
    tree, level = Tree(), [0]
    for k in range(depth):
        if not level:
            break
        for i, h in zip(level, found(tree, level)):
            split(tree, i, h, cuts, min_rows, min_gain)
        below = [c for i in level if tree.nodes[i].left >= 0 for c in (tree.nodes[i].left, tree.nodes[i].right)]
        level = [c for c in below if abs(tree.nodes[c].impurity) >= EPSILON]
    return tree


def _weighted(tree: Tree, weight: float) -> Tree:
    """The tree whose values count ``weight`` times."""
    return Tree([Node(n.rows, weight * n.value, n.feature, n.bin, n.cut, n.left, n.right) for n in tree.nodes])


def grow_in_task(blocks: Iterator[tuple], cuts: list[np.ndarray], trees: int, rate: float, bins: int, **limits) -> Iterator[list[dict]]:
    """All trees of the merged rows of one task, each as the fields of its nodes."""
    b, y, n, raw = (np.concatenate(parts) for parts in zip(*blocks))
    for k in range(trees):
        sums = residuals if k else labels_as_signs
        of_all = sums(y, n, raw)
        tree = grow(lambda t, wanted: block_histogram(t, wanted, b, lambda use: of_all[use], bins), cuts, **limits)
        raw = raw + _weighted(tree, rate if k else 1.0).values(b, binned=True)
        yield [vars(node) for node in tree.nodes]


def grow_spread(state: RDD, spark, cuts: list[np.ndarray], trees: int, rate: float, bins: int, **limits) -> Iterator[Tree]:
    """All trees of merged rows that lie in blocks in many tasks, one scan a level."""
    held = [state]
    try:
        for k in range(trees):
            sums = residuals if k else labels_as_signs
            tree = grow(lambda t, wanted: histograms(held[-1], t, wanted, len(cuts), bins, sums), cuts, **limits)
            for old in held[:-1]:  # the scores have been worked out by now
                old.unpersist()
            held = held[-1:]
            yield tree
            state = _rescored(held[-1], _weighted(tree, rate if k else 1.0))
            if (k + 1) % WRITTEN == 0:
                packed = state.map(lambda block: tuple(bytearray(a.tobytes()) for a in block))
                state = _written(spark.createDataFrame(packed, BLOCK))
            held.append(state.persist(StorageLevel.MEMORY_AND_DISK))
    finally:
        for old in held:
            old.unpersist()


def _module(package, name: str):
    """A Scala object of the JVM."""
    return getattr(getattr(package, f"{name}$"), "MODULE$")


class GradientBoosting(GBTClassifier):
    """MLlib's estimator and model. What merged rows cannot give (weights of rows, samples of rows or features, categories, a
    validation column) is left to MLlib's own training."""

    def _fit_java(self, dataset: DataFrame):
        self._transfer_params_to_java()
        jvm, ours = dataset.sparkSession.sparkContext._jvm, self._java_obj
        field = dataset._jdf.schema().apply(self.getFeaturesCol())
        categories = jvm.org.apache.spark.ml.util.MetadataUtils.getCategoricalFeatures(field)
        plain = (
            categories.isEmpty()
            and self.getSubsamplingRate() == 1.0
            and self.getFeatureSubsetStrategy() in ("all", "auto")
            and self.getMinWeightFractionPerNode() == 0.0
            and self.getMaxDepth() > 0
            and self.getMaxBins() <= 256
            and not any(self.isDefined(p) and self.getOrDefault(p) for p in (self.weightCol, self.validationIndicatorCol, self.thresholds))
        )
        if not plain:
            return super()._fit_java(dataset)
        cuts = self._candidates(dataset, categories)
        if cuts is None:
            return super()._fit_java(dataset)
        rows = dataset.select(vector_to_array(self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("double").alias("y"))
        trees = self._trees(_binned(rows, cuts), cuts)
        gateway, ml = dataset.sparkSession.sparkContext._gateway, jvm.org.apache.spark.ml
        builder, one = _Builder(gateway), ml.regression.DecisionTreeRegressionModel
        grown, weights = gateway.new_array(one, len(trees)), gateway.new_array(jvm.double, len(trees))
        for k, tree in enumerate(trees):
            grown[k], weights[k] = one(builder.of(tree)[0], len(cuts)), self.getStepSize() if k else 1.0
        model = ml.classification.GBTClassificationModel(self.uid, grown, weights, len(cuts))
        return ours.copyValues(model.setParent(ours), ml.param.ParamMap.empty())

    def _candidates(self, dataset: DataFrame, categories) -> list[np.ndarray] | None:
        """MLlib's candidate splits of every feature, by its own code and so from its own sample; None if there are none."""
        jvm, ours = dataset.sparkSession.sparkContext._jvm, self._java_obj
        tree = jvm.org.apache.spark.mllib.tree
        tools = _module(jvm.org.apache.spark.ml.util, "DatasetUtils")
        instances = tools.extractInstances(ours, dataset._jdf, jvm.scala.Some(2))
        strategy = ours.getOldBoostingStrategy(categories, tree.configuration.Algo.Classification()).treeStrategy()
        strategy.setAlgo("Regression")
        strategy.setImpurity(_module(tree.impurity, "Variance"))
        impl = jvm.org.apache.spark.ml.tree.impl
        metadata = impl.DecisionTreeMetadata.buildMetadata(instances, strategy, 1, self.getFeatureSubsetStrategy())
        found = _module(impl, "RandomForest").findSplits(instances, metadata, self.getSeed())
        cuts = [np.array([s.threshold() for s in splits], dtype=float) for splits in found]
        return cuts if any(len(c) for c in cuts) else None

    def _trees(self, merged: DataFrame, cuts: list[np.ndarray]) -> list[Tree]:
        rules = {
            "cuts": cuts, "trees": self.getMaxIter(), "rate": self.getStepSize(), "bins": max(len(c) for c in cuts) + 1,
            "depth": self.getMaxDepth(), "min_rows": self.getMinInstancesPerNode(), "min_gain": self.getMinInfoGain(),
        }
        merged = materialize(merged, "merged-rows")
        if merged.count() * len(cuts) <= LOCAL_CELLS:
            told = _blocks(merged.coalesce(1), 0.0).rdd.map(_unpacked).mapPartitions(lambda blocks: grow_in_task(blocks, **rules)).collect()
            return [Tree([Grown(**node) for node in nodes]) for nodes in told]
        state = _written(_blocks(merged, 0.0)).persist(StorageLevel.MEMORY_AND_DISK)
        return list(grow_spread(state, merged.sparkSession, **rules))


class _Builder:
    """Makes MLlib's nodes of ours. Its classes are looked up once, as every look-up asks the JVM."""

    def __init__(self, gateway):
        self.gateway, tree = gateway, gateway.jvm.org.apache.spark.ml.tree
        self.double, self.leaf, self.inner, self.cut = gateway.jvm.double, tree.LeafNode, tree.InternalNode, tree.ContinuousSplit
        self.stats = gateway.jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator

    def of(self, tree: Tree, i: int = 0):
        """(MLlib's node, its prediction if it is a leaf). Two leaves of one prediction become one, as in MLlib."""
        node = tree.nodes[i]
        sums = self.gateway.new_array(self.double, 3)
        for k, value in enumerate(node.sums):
            sums[k] = value
        stats = self.stats(sums, int(node.rows))
        if node.left >= 0:
            (left, one), (right, other) = (self.of(tree, c) for c in (node.left, node.right))
            if one is None or one != other:
                return self.inner(node.value, node.impurity, node.gain, left, right, self.cut(node.feature, node.cut), stats), None
            return self.leaf(one, node.impurity, stats), one
        return self.leaf(node.value, node.impurity, stats), node.value
