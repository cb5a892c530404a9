"""Logistic regression whose intercept is penalised like every other weight, by proximal Newton steps.

The objective is the penalty of all weights, the intercept's included, plus C times the summed log loss. In a step the cluster adds up
gradient and Hessian, the quadratic model with the penalty is solved on the driver, which has the square of the number of
features to look at and no rows, and the step is shortened until the objective falls enough.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

PENALTIES = ("l1", "l2")
STEPS = 30  # halvings of a step that are tried at once
ENOUGH = 1e-4  # of the fall that the model promises
ROUNDING = 1e-14  # of the objective, within which a fall cannot be told


class PenalizedLogisticModel:
    """Weights and intercept; ``transform`` adds ``probability`` and ``prediction`` as MLlib's models do."""

    def __init__(self, coefficients: np.ndarray, intercept: float, features: str, violation: float):
        self.weights, self.intercept, self.features = coefficients, intercept, features
        self.violation = violation  # by how much the optimality conditions are missed

    @property
    def coefficients(self) -> np.ndarray:
        return self.weights

    def transform(self, df: DataFrame) -> DataFrame:
        weights = F.array(*[F.lit(float(w)) for w in self.weights]).cast("array<double>")
        products = F.zip_with(vector_to_array(self.features), weights, lambda x, w: x * w)
        margin = F.aggregate(products, F.lit(float(self.intercept)), lambda s, x: s + x)
        chance = 1 / (1 + F.exp(-margin))
        out = df.withColumn("probability", array_to_vector(F.array(1 - chance, chance)))
        return out.withColumn("prediction", (margin > 0).cast("double"))


class PenalizedLogisticRegression:
    """An estimator for labels 0 and 1. The optimality conditions hold up to ``tol`` when it ends before ``maxIter`` steps."""

    def __init__(self, featuresCol: str = "features", labelCol: str = "label", C: float = 1.0, penalty: str = "l2", maxIter: int = 100, tol: float = 1e-7):
        if penalty not in PENALTIES:
            raise ValueError(f"unknown penalty {penalty!r}")
        self.features, self.label, self.C, self.penalty, self.max_iter, self.tol = featuresCol, labelCol, C, penalty, maxIter, tol

    def fit(self, df: DataFrame) -> PenalizedLogisticModel:
        rows = df.select(vector_to_array(self.features).alias("x"), F.col(self.label).cast("double").alias("y"))
        first = rows.select(F.size("x")).first()
        d = (first[0] if first else 0) + 1
        w = np.zeros(d)
        loss, gradient, hessian = derivatives(rows, w, self.C)
        for _ in range(self.max_iter):
            if violation(w, gradient, self.penalty) <= self.tol:
                break
            step = newton_step(w, gradient, hessian, self.penalty)
            promise = gradient @ step + self._size(w + step) - self._size(w)
            there = derivatives(rows, w + step, self.C)
            if -promise <= ROUNDING * (loss + self._size(w)):
                # only the conditions can tell whether the step is one to the better
                if violation(w + step, there[1], self.penalty) > violation(w, gradient, self.penalty) / 2:
                    break
            elif there[0] + self._size(w + step) > loss + self._size(w) + ENOUGH * promise:
                share = self._shortened(rows, w, step, loss, promise)
                if share is None:  # no step falls any more: the objective's own rounding is reached
                    break
                step = share * step
                there = derivatives(rows, w + step, self.C)
            w, (loss, gradient, hessian) = w + step, there
        return PenalizedLogisticModel(w[:-1], float(w[-1]), self.features, violation(w, gradient, self.penalty))

    def _size(self, w: np.ndarray) -> float:
        return float(np.abs(w).sum() if self.penalty == "l1" else w @ w / 2)

    def _shortened(self, rows: DataFrame, w: np.ndarray, step: np.ndarray, loss: float, promise: float) -> float | None:
        shares = 0.5 ** np.arange(1, STEPS + 1)
        losses = losses_along(rows, w, step, shares, self.C)
        for share, value in zip(shares, losses):
            if value + self._size(w + share * step) <= loss + self._size(w) + ENOUGH * share * promise:
                return float(share)
        return None


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    """The rows' features and a one for the intercept."""
    x = np.stack(pdf["x"].to_numpy()) if len(pdf) else np.zeros((0, 0))
    return np.column_stack([x, np.ones(len(x))])


def derivatives(rows: DataFrame, w: np.ndarray, c: float) -> tuple[float, np.ndarray, np.ndarray]:
    """(loss, gradient, Hessian) of the summed log loss; every task sends one row per feature, which the shuffle adds up."""
    d = len(w)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((d, d + 2))
        for pdf in batches:
            if len(pdf):
                x, y = _matrix(pdf), pdf["y"].to_numpy()
                z = x @ w
                p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                total[:, :d] += (x * (p * (1 - p))[:, None]).T @ x
                total[:, d] += x.T @ (p - y)
                total[:, d + 1] += np.logaddexp(0, np.where(y > 0, -z, z)).sum()
        yield pd.DataFrame({"i": range(d), "row": list(total)})

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [key[0]], "row": [np.sum(np.stack(pdf["row"].to_numpy()), axis=0)]})

    kind = "i int, row array<double>"
    found = {r["i"]: r["row"] for r in rows.mapInPandas(run, kind).groupBy("i").applyInPandas(add, kind).collect()}
    total = c * np.array([found.get(i, [0.0] * (d + 2)) for i in range(d)])
    return float(total[0, d + 1]), total[:, d], total[:, :d]


def losses_along(rows: DataFrame, w: np.ndarray, step: np.ndarray, shares: np.ndarray, c: float) -> np.ndarray:
    """The summed log loss at ``w + share * step`` for every share, in one scan."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(shares))
        for pdf in batches:
            if len(pdf):
                x, sign = _matrix(pdf), np.where(pdf["y"].to_numpy() > 0, -1.0, 1.0)
                z = (x @ w)[:, None] + (x @ step)[:, None] * shares
                total += np.logaddexp(0, sign[:, None] * z).sum(axis=0)
        yield pd.DataFrame({"k": range(len(shares)), "loss": total})

    found = rows.mapInPandas(run, "k int, loss double").groupBy("k").agg(F.sum("loss").alias("loss")).collect()
    by = {r["k"]: r["loss"] for r in found}
    return c * np.array([by[k] for k in range(len(shares))])


def violation(w: np.ndarray, gradient: np.ndarray, penalty: str) -> float:
    """The largest entry of the smallest subgradient of the objective."""
    if penalty == "l2":
        return float(np.abs(gradient + w).max())
    away = np.where(w != 0, np.abs(gradient + np.sign(w)), np.maximum(np.abs(gradient) - 1, 0))
    return float(away.max())


def newton_step(w: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, penalty: str, sweeps: int = 2000) -> np.ndarray:
    """The step that minimises the quadratic model of the loss with the penalty; for l1 by coordinate descent."""
    if penalty == "l2":
        return np.linalg.solve(hessian + np.eye(len(w)), -(gradient + w))
    # in proportion to every feature's own scale, as a share of the largest would slow down the small ones
    curve = hessian + 1e-10 * np.diag(np.maximum(np.diag(hessian), 1e-10))
    step, slope = np.zeros(len(w)), gradient.copy()
    for _ in range(sweeps):
        most = 0.0
        for j in range(len(w)):
            now = w[j] + step[j]
            free = now - slope[j] / curve[j, j]
            new = np.sign(free) * max(abs(free) - 1 / curve[j, j], 0.0)
            if new != now:
                slope += (new - now) * curve[:, j]
                step[j] += new - now
                most = max(most, abs(new - now) * curve[j, j])
        if most <= 1e-10:
            break
    return step
