"""Gradient boosting on binned features, with trees that grow leaf by leaf.

Features are cut into bins by their quantiles once, and a row then is one byte per feature. Rows with equal bins and labels have equal
scores in every round, so they are merged into one that knows how many they are. Rows are kept in blocks of arrays, so that a
scan costs a task some array operations and no work per row. A leaf is known by a histogram of its rows'
gradients and Hessians per feature and bin, which tasks add up locally and which are added up over tasks. Of the two
children of a split only the smaller one is counted, the other one is what is left of the parent. The open leaf with the
largest gain is split next. A scan counts the children of every leaf that may still be split, and once all of these have few
enough rows, each is grown to its end by one task, which has all of them; the order of splits is that of a scan per split in either case.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Collection, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from modelscout.sources.scratch import materialize

MAX_BINS = 255
ACCURACY = 10_000  # of the quantiles that are the bounds of bins
LOCAL_ROWS = 1 << 16  # rows of a leaf that one task may have
BLOCK_ROWS = 10_000
PARTS_AT_ONCE = 64  # tasks whose histograms the driver adds up itself; those of more are added up by tasks first
BLOCK = "bins binary, y binary, n binary, raw binary"
WRITTEN = 10  # trees after which the rows' scores are written out, so that a lost executor costs few of them


@dataclass
class Node:
    """A node of a tree: its rows, and what splits it (rows at or below the cut go left) or its value."""

    rows: float
    value: float
    feature: int = -1
    bin: int = -1
    cut: float = math.nan
    left: int = -1
    right: int = -1


@dataclass
class Split:
    """The best split of a leaf."""

    gain: float
    feature: int
    bin: int
    left_rows: float


@dataclass
class Tree:
    nodes: list[Node] = field(default_factory=list)

    def rows_of(self, x: np.ndarray, wanted: Collection[int], binned: bool) -> Iterator[tuple[int, np.ndarray]]:
        """The leaves ``wanted`` with the places of their rows in ``x``, bins or values. Branches without such a leaf are not gone into."""
        on_way, todo = set(), list(enumerate(self.nodes))
        for i, node in reversed(todo):  # children come after their parents
            if i in wanted or node.left in on_way or node.right in on_way:
                on_way.add(i)
        open_: list[tuple[int, np.ndarray | None]] = [(0, None)] if 0 in on_way else []
        while open_:
            i, rows = open_.pop()
            node = self.nodes[i]
            if node.left < 0:
                yield i, np.arange(len(x)) if rows is None else rows
                continue
            column = x[:, node.feature]
            low = (column if rows is None else column[rows]) <= (node.bin if binned else node.cut)
            for child, side in ((node.right, ~low), (node.left, low)):
                if child in on_way:
                    open_.append((child, np.flatnonzero(side) if rows is None else rows[side]))

    def leaf_of(self, x: np.ndarray, binned: bool) -> np.ndarray:
        """The leaf of every row of ``x``, bins or values."""
        at = np.zeros(len(x), dtype=np.int64)
        for i, rows in self.rows_of(x, {i for i, n in enumerate(self.nodes) if n.left < 0}, binned):
            at[rows] = i
        return at

    def values(self, x: np.ndarray, binned: bool) -> np.ndarray:
        return np.array([n.value for n in self.nodes])[self.leaf_of(x, binned)]


def best_split(h: np.ndarray, min_rows: int, min_hessian: float, l2: float) -> Split | None:
    """The split of a histogram (feature, bin, [gradient, Hessian, rows]) with the largest gain; the first of equal ones."""
    total = h[0].sum(axis=0)
    left = np.cumsum(h, axis=1)[:, :-1]
    right = total - left
    with np.errstate(divide="ignore", invalid="ignore"):
        score = lambda s: s[..., 0] ** 2 / (s[..., 1] + l2)
        gain = score(left) + score(right) - score(total)
    allowed = (np.minimum(left[..., 2], right[..., 2]) >= min_rows) & (np.minimum(left[..., 1], right[..., 1]) >= min_hessian)
    gain = np.where(allowed, gain, -np.inf)
    if not gain.size:
        return None
    at = int(np.argmax(gain))
    f, b = divmod(at, gain.shape[1])
    return Split(float(gain[f, b]), f, b, float(left[f, b, 2])) if gain[f, b] > 1e-12 else None


class HistogramBoostingModel:
    """Trees whose values add up to the log odds; ``transform`` adds ``probability`` and ``prediction`` as MLlib's models do."""

    def __init__(self, start: float, trees: list[Tree], features: str):
        self.start, self.trees, self.features = start, trees, features

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for tree in self.trees:
            out += tree.values(x, binned=False)
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for x in batches:
                yield pd.Series(self.raw(np.stack(x.to_numpy())) if len(x) else np.zeros(0))

        score.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        raw = F.pandas_udf(score, "double")(vector_to_array(self.features))
        out = df.withColumn("_raw", raw).withColumn("_chance", 1 / (1 + F.exp(-F.col("_raw"))))
        out = out.withColumn("probability", array_to_vector(F.array(1 - F.col("_chance"), F.col("_chance"))))
        return out.withColumn("prediction", (F.col("_raw") > 0).cast("double")).drop("_raw", "_chance")


class HistogramBoosting:
    """An estimator for labels 0 and 1 and the log loss. Rows must have no gaps."""

    def __init__(
        self, featuresCol: str = "features", labelCol: str = "label", numTrees: int = 100, numLeaves: int = 31, stepSize: float = 0.1,
        maxBins: int = MAX_BINS, minRows: int = 20, minHessian: float = 1e-3, l2: float = 0.0,
        localRows: int = LOCAL_ROWS,
    ):
        if not 2 <= maxBins <= MAX_BINS + 1:
            raise ValueError(f"between 2 and {MAX_BINS + 1} bins fit into a byte")
        self.features, self.label, self.n_trees, self.n_leaves, self.rate = featuresCol, labelCol, numTrees, numLeaves, stepSize
        self.local_rows = localRows
        self.bins, self.min_rows, self.min_hessian, self.l2 = maxBins, minRows, minHessian, l2

    def fit(self, df: DataFrame) -> HistogramBoostingModel:
        rows = df.select(vector_to_array(self.features).alias("x"), F.col(self.label).cast("double").alias("y"))
        first = rows.agg(F.max(F.size("x")).alias("d"), F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones")).first()
        d, n, ones = first["d"] or 0, first["n"], first["ones"] or 0.0
        if not n or not d or ones in (0, n):
            share = min(max((ones + 0.5) / (n + 1), 1e-15), 1 - 1e-15)
            return HistogramBoostingModel(math.log(share / (1 - share)), [], self.features)
        cuts = bin_bounds(rows, d, self.bins)
        start = math.log(ones / (n - ones))
        spark = df.sparkSession
        state = _written(_blocks(_binned(rows, cuts), start)).persist(StorageLevel.MEMORY_AND_DISK)
        trees: list[Tree] = []
        held = [state]  # what the current scores are read from
        try:
            kinds = state.map(lambda block: len(block[1])).sum()
            for k in range(self.n_trees):
                tree = self._grow(state, cuts, kinds)
                for old in held[:-1]:  # the scores have been worked out by now
                    old.unpersist()
                held = held[-1:]
                trees.append(tree)
                if len(tree.nodes) == 1:
                    break
                state = _rescored(state, tree)
                if (k + 1) % WRITTEN == 0:
                    packed = state.map(lambda block: tuple(bytearray(a.tobytes()) for a in block))
                    state = _written(spark.createDataFrame(packed, BLOCK))
                state = state.persist(StorageLevel.MEMORY_AND_DISK)
                held.append(state)
        finally:
            for old in held:
                old.unpersist()
        return HistogramBoostingModel(start, trees, self.features)

    def _grow(self, state: RDD, cuts: list[np.ndarray], kinds: int) -> Tree:
        """The next tree. ``kinds`` is the number of rows once equal ones are merged."""
        tree = Tree()
        histogram: dict[int, np.ndarray] = {}
        splits: dict[int, Split | None] = {}
        children: dict[int, tuple[int, int]] = {}  # of leaves whose split has been looked at from below
        if kinds <= self.local_rows:
            tree.nodes.append(Node(0, 0.0))
            self._finish(state, tree, [0], splits, children, len(cuts))
        else:
            histogram[0] = histograms(state, tree, [0], len(cuts), self.bins)[0]
            tree.nodes.append(self._node(histogram[0]))
            splits[0] = self._split(histogram[0])
        leaves = {0}
        while len(leaves) < self.n_leaves:
            open_ = sorted((i for i in leaves if splits[i]), key=lambda i: (-splits[i].gain, i))
            if not open_:
                break
            if open_[0] not in children:
                # of the leaves that may still be split, all that nothing is known of below
                wanted = [i for i in open_[: self.n_leaves - len(leaves)] if i not in children]
                # leaves below one that was grown to its end have no histogram, and are grown again if wanted first
                counted = [i for i in wanted if i in histogram]
                if open_[0] in histogram and any(tree.nodes[i].rows > self.local_rows for i in counted):
                    self._count(state, tree, counted, splits, histogram, children, len(cuts))
                else:
                    small = [i for i in wanted if i not in histogram or tree.nodes[i].rows <= self.local_rows]
                    self._finish(state, tree, small, splits, children, len(cuts))
            i = open_[0]
            node, split = tree.nodes[i], splits[i]
            node.left, node.right = children[i]
            node.feature, node.bin, node.cut = split.feature, split.bin, float(cuts[split.feature][split.bin])
            leaves.remove(i)
            leaves |= set(children[i])
        return _compact(tree)

    def _finish(self, state: RDD, tree: Tree, wanted: list[int], splits: dict, children: dict, d: int) -> None:
        """Everything that may be split below the small leaves ``wanted``, each in one task."""
        slot = {i: k for k, i in enumerate(wanted)}

        def rows(part: int, blocks: Iterator[tuple]) -> Iterator[tuple]:
            for k, (b, y, n, raw) in enumerate(blocks):
                for i, use in tree.rows_of(b, slot, binned=True):
                    if len(use):
                        yield slot[i], (part, k, b[use], _sums(y[use], n[use], raw[use]))

        def grow(group: tuple) -> list[tuple]:
            parts = sorted(group[1], key=lambda p: p[:2])
            found = self._below(np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts]), d)
            return [(wanted[group[0]], *r) for r in found]

        names = ("leaf", "number", "rows", "value", "gain", "feature", "bin", "left_rows", "left")
        tasks = min(len(wanted), state.context.defaultParallelism)
        grown = state.mapPartitionsWithIndex(rows).groupByKey(tasks, lambda leaf: leaf).flatMap(grow).collect()
        by_leaf: dict[int, list] = {}
        for r in grown:
            by_leaf.setdefault(r[0], []).append(dict(zip(names, r)))
        for leaf, found in by_leaf.items():
            found.sort(key=lambda r: r["number"])
            at = [leaf, *range(len(tree.nodes), len(tree.nodes) + len(found) - 1)]
            for i, r in zip(at, found):
                if i == leaf:
                    tree.nodes[i].rows, tree.nodes[i].value = r["rows"], r["value"]
                else:
                    tree.nodes.append(Node(r["rows"], r["value"]))
                splits[i] = Split(r["gain"], r["feature"], r["bin"], r["left_rows"]) if r["feature"] >= 0 else None
                if r["left"] >= 0:
                    children[i] = at[r["left"]], at[r["left"] + 1]

    def _below(self, b: np.ndarray, sums: np.ndarray, d: int) -> list[tuple]:
        """(number, rows, value, gain, feature, bin, rows to the left, left child) of a leaf and what it may be split into.

        Splits are made in the order of their gains, as many as a whole tree may have. Children have consecutive numbers.
        """
        out: list[list] = []
        rows_of, histogram_of, splits = [], [], []

        def add(rows: np.ndarray, histogram: np.ndarray) -> None:
            node, split = self._node(histogram), self._split(histogram)
            rows_of.append(rows)
            histogram_of.append(histogram)
            splits.append(split)
            told = (split.gain, split.feature, split.bin, split.left_rows) if split else (0.0, -1, -1, 0.0)
            out.append([len(out), node.rows, node.value, *told, -1])

        add(np.arange(len(b)), _local_histogram(b, sums, self.bins))
        open_ = {0}
        for _ in range(self.n_leaves - 1):
            some = [i for i in open_ if splits[i]]
            if not some:
                break
            i = min(some, key=lambda i: (-splits[i].gain, i))
            open_.remove(i)
            left = b[rows_of[i], splits[i].feature] <= splits[i].bin
            sides = rows_of[i][left], rows_of[i][~left]
            smaller = 0 if len(sides[0]) * 2 <= len(rows_of[i]) else 1
            counted = _local_histogram(b[sides[smaller]], sums[sides[smaller]], self.bins)
            pair = (counted, histogram_of[i] - counted) if smaller == 0 else (histogram_of[i] - counted, counted)
            out[i][-1] = len(out)
            for rows, histogram in zip(sides, pair):
                open_.add(len(out))
                add(rows, histogram)
            rows_of[i] = histogram_of[i] = None
        return [tuple(r) for r in out]

    def _count(self, state: RDD, tree: Tree, wanted: list[int], splits: dict, histogram: dict, children: dict, d: int) -> None:
        """Histograms and best splits of the children of the leaves ``wanted``, in one scan."""
        trial = Tree([Node(**vars(n)) for n in tree.nodes])
        counted = []
        for i in wanted:
            s, node = splits[i], trial.nodes[i]
            node.feature, node.bin, node.left, node.right = s.feature, s.bin, len(trial.nodes), len(trial.nodes) + 1
            smaller_left = s.left_rows * 2 <= node.rows
            counted.append(node.left if smaller_left else node.right)
            trial.nodes += [Node(0, 0), Node(0, 0)]
        found = histograms(state, trial, counted, d, self.bins)
        for i, c, h in zip(wanted, counted, found):
            node = trial.nodes[i]
            other = histogram[i] - h
            pair = (h, other) if c == node.left else (other, h)
            numbers = []
            for part in pair:
                numbers.append(len(tree.nodes))
                tree.nodes.append(self._node(part))
                histogram[numbers[-1]], splits[numbers[-1]] = part, self._split(part)
            children[i] = tuple(numbers)

    def _split(self, h: np.ndarray) -> Split | None:
        return best_split(h, self.min_rows, self.min_hessian, self.l2)

    def _node(self, h: np.ndarray) -> Node:
        g, s, n = h[0].sum(axis=0)
        return Node(float(n), float(-self.rate * g / (s + self.l2)) if s + self.l2 > 0 else 0.0)


def _compact(tree: Tree) -> Tree:
    """The tree without nodes that were counted and not used, the root first."""
    out, number, todo = [], {}, [0]
    while todo:
        i = todo.pop(0)
        number[i] = len(out)
        out.append(Node(**vars(tree.nodes[i])))
        if tree.nodes[i].left >= 0:
            todo += [tree.nodes[i].left, tree.nodes[i].right]
    for node in out:
        if node.left >= 0:
            node.left, node.right = number[node.left], number[node.right]
    return Tree(out)


def bin_bounds(rows: DataFrame, d: int, bins: int) -> list[np.ndarray]:
    """The upper bounds of all bins but the last of every feature: quantiles, each once. One scan for all features."""
    shares = [k / bins for k in range(1, bins)]
    wanted = [F.percentile_approx(F.col("x")[i], shares, ACCURACY).alias(f"q{i}") for i in range(d)]
    found = rows.agg(*wanted, *[F.max(F.col("x")[i]).alias(f"m{i}") for i in range(d)]).first()
    # a bound that nothing lies above splits nothing
    return [np.array([q for q in np.unique(found[f"q{i}"]) if q < found[f"m{i}"]] or [found[f"m{i}"]]) for i in range(d)]


def _binned(rows: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """(bins, y, n): a byte per feature, the label and the number of rows that have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(cuts)
        for batch in batches:
            n, x = len(batch), batch.column(0)
            flat = x.flatten().to_numpy(zero_copy_only=False)
            if x.null_count or len(flat) != n * d:
                raise ValueError(f"a row without its {d} features")
            flat = flat.reshape(n, d)
            b = np.empty((n, d), dtype=np.uint8)
            for i, c in enumerate(cuts):
                b[:, i] = np.searchsorted(c, flat[:, i], side="left")
            ends = np.arange(n + 1, dtype=np.int32) * d
            packed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(b)])
            yield pa.RecordBatch.from_arrays([packed, batch.column(1)], names=["bins", "y"])

    return rows.select("x", "y").mapInArrow(run, "bins binary, y double").groupBy("bins", "y").agg(F.count(F.lit(1)).alias("n"))


def _blocks(rows: DataFrame, start: float) -> DataFrame:
    """Up to ``BLOCK_ROWS`` rows as one: their bins, labels, numbers and log odds so far, each as the bytes of an array."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), BLOCK_ROWS):
                part = pdf.iloc[at : at + BLOCK_ROWS]
                numbers = [part[c].to_numpy(dtype=float) for c in ("y", "n")]
                packed = [b"".join(part["bins"]), *[a.tobytes() for a in (*numbers, np.full(len(part), start))]]
                yield pd.DataFrame({name: [value] for name, value in zip(("bins", "y", "n", "raw"), packed)})

    return rows.mapInPandas(run, BLOCK)


def _written(blocks: DataFrame) -> RDD:
    """The blocks as (bins, y, n, raw) of arrays, read from files to which they are written once."""

    return materialize(blocks, "boosting-rows").rdd.map(_unpacked)


def _unpacked(row: tuple) -> tuple:
    y, n, raw = (np.frombuffer(value, dtype=float) for value in row[1:])
    return np.frombuffer(row[0], dtype=np.uint8).reshape(len(y), -1), y, n, raw


def _sums(y: np.ndarray, n: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """[gradient, Hessian, rows] of merged rows."""
    p = 1 / (1 + np.exp(-raw))
    return np.column_stack([(p - y) * n, p * (1 - p) * n, n])


def _rescored(state: RDD, tree: Tree) -> RDD:
    return state.map(lambda block: (*block[:3], block[3] + tree.values(block[0], binned=True)))


def _local_histogram(b: np.ndarray, sums: np.ndarray, bins: int) -> np.ndarray:
    """(feature, bin, [gradient, Hessian, rows]) of some rows."""
    d = b.shape[1]
    at = (np.arange(d) * bins + b).ravel()
    columns = [np.bincount(at, weights=np.repeat(s, d), minlength=d * bins) for s in sums.T]
    return np.stack(columns, axis=1).reshape(d, bins, 3)


def block_histogram(tree: Tree, wanted: list[int], b: np.ndarray, sums: Callable[[np.ndarray], np.ndarray], bins: int) -> np.ndarray:
    """(wanted, feature, bin, sums) of the rows of a block in the nodes ``wanted``; ``sums`` gives a column per sum for some rows. A tree
    without nodes is its root."""
    slot = {i: k for k, i in enumerate(wanted)}
    some = sorted(tree.rows_of(b, slot, binned=True)) if tree.nodes else [(0, np.arange(len(b)))]
    use = np.concatenate([rows for _, rows in some])
    first = np.repeat([slot[i] * bins for i, _ in some], [len(rows) for _, rows in some])
    columns = np.ascontiguousarray(sums(use).T)
    of_feature = np.ascontiguousarray(b[use].T)
    d, size = b.shape[1], len(wanted) * bins
    out = np.empty((len(wanted), d, bins, len(columns)))
    for f in range(d):
        at = first + of_feature[f]
        for k, column in enumerate(columns):
            out[:, f, :, k] = np.bincount(at, weights=column, minlength=size).reshape(-1, bins)
    return out


def histograms(
    state: RDD, tree: Tree, wanted: list[int], d: int, bins: int, sums: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] = _sums
) -> np.ndarray:
    """(wanted, feature, bin, sums) of the rows in the nodes ``wanted``; a tree without nodes is its root. ``sums`` gives the sums of
    merged rows by label, number and score, by default [gradient, Hessian, rows]; the last of them tells empty bins."""
    size = len(wanted) * d * bins

    def run(blocks: Iterator[tuple]) -> Iterator[tuple]:
        total = np.zeros((size, 3))
        for b, y, n, raw in blocks:
            total += block_histogram(tree, wanted, b, lambda use: sums(y[use], n[use], raw[use]), bins).reshape(size, 3)
        some = np.flatnonzero(total[:, 2])
        yield some, total[some]

    def add(one: tuple, other: tuple) -> tuple:
        some, at = np.unique(np.concatenate([one[0], other[0]]), return_inverse=True)
        both = np.concatenate([one[1], other[1]])
        return some, np.column_stack([np.bincount(at, weights=column, minlength=len(some)) for column in both.T])

    parts = state.mapPartitions(run)
    # as many rows as leaves, features and bins have combinations at most
    found = parts.collect() if parts.getNumPartitions() <= PARTS_AT_ONCE else [parts.treeReduce(add)]
    out = np.zeros((size, 3))
    for some, sums in found:
        out[some] += sums
    return out.reshape(len(wanted), d, bins, 3)
